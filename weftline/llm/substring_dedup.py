"""Removal of long repeated strings, found by external induced suffix sorting in shards.

The unit is the byte of the UTF-8 text, or the word: then texts are compared by words, A-Z lower-cased, whatever white
space parts them. Each window of length units has an anchor (see anchors.py), and equal windows share the hash at
theirs; so only the segments of anchors whose hash occurs twice can hold a repeated window.

1. One pass over the texts lists every anchor with its window range and a digest of its segment's bytes. Texts that
   are wholly equal count once; such a text is repeated throughout.
2. Anchors whose hash occurs once go. Segments with one digest are counted, with partial sums in the map tasks: a
   segment found twice is repeated throughout, whether twice or in a third of all texts. One copy of each distinct
   segment goes on if its anchor's hash has several.
3. A hash with more than HOT distinct segments is split: the segments are cut into blocks of window offsets, keyed by
   the bytes that all windows of the block share, and counted and grouped anew; first in wide blocks of offsets, at
   last in single windows. No group of any size is held in one task.
4. The remaining groups are packed into shards, each sorted by induced.py with queues on disk; neighbours in suffix
   order whose common prefix, carried through the induction, covers a window are repeated.
5. Repeated windows go back to all places of their segments, and each text loses what they cover.

Nulls count as empty. Texts of fewer units than length lose nothing. Repeated rows are copies of each other. Ids are
carried only; texts with one id are told apart by their digests. Other columns are ignored or, in deduplicate, passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, release, small_or_not, trimmed, unused

#: Units of a window, units of the runs whose hashes make anchors, and widths of offset blocks; in bytes and in words.
LENGTH, PASSAGE = 400, 51
GRAM = {False: 96, True: 12}
BLOCKS = {False: (32, 4, 1), True: (8, 1)}
#: Distinct segments of a hash that go into one shard, bytes of a shard, memory for queues and for a shard's text.
HOT, SHARD_BYTES, BUDGET = 512, 3_000_000, 32 << 20
#: A table of texts' needs is broadcast if its rows were counted and hold at most so many segments.
BROADCAST_NEEDS = 500_000

LISTED = "tid bigint, doc_id {id}, sha binary, n_bytes bigint, units bigint, anchors array<struct<h: bigint, seg: bigint, lo: int, hi: int, off: int>>"
PIECES = "h bigint, seg bigint, key bigint, piece bigint, rel int, off int, wins int, bytes binary"
FOUND = "key bigint, piece bigint, lo int, hi int"
STRIPPED = "sha binary, n_removed bigint, n_spans bigint, kept string"


class Units:
    """Texts as sequences of bytes, or of words in a form with one space after each word."""

    def __init__(self, texts: list[bytes], words: bool) -> None:
        from .tokens import TextWords

        self.words = words
        if not words:
            self.texts, self.sizes = texts, np.array([len(t) for t in texts], np.int64)
            self.values = np.frombuffer(b"".join(texts), np.uint8)
            return
        self.texts = [b" ".join(t.lower().split()) + b" " for t in texts]
        w = TextWords(self.texts, lower=False)
        self.values, self.sizes = w.h1, np.diff(np.append(w.starts, len(w.h1)))
        self.starts, self.edges = w.starts, np.append(w.begin, 0) - np.append(w.offsets[w.text], 0)

    def cut(self, text: int, lo: int, hi: int) -> bytes:
        """Units lo to hi of a text."""
        if not self.words:
            return self.texts[text][lo:hi]
        a = self.starts[text]
        return self.texts[text][self.edges[a + lo] : self.edges[a + hi] if hi < self.sizes[text] else None]


def unit_bounds(data: bytes, words: bool) -> np.ndarray | range:
    """Where the units of data begin, and its end."""
    if not words:
        return range(len(data) + 1)
    return np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1])


def _list(length: int, words: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .anchors import digest64, segments
        from .common import blocks
        from .tokens import encoded

        kind = pa.struct([("h", pa.int64()), ("seg", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("off", pa.int32())])
        tid = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [encoded(t) for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts, 1 << 20):
                part = texts[a:b]
                u = Units(part, words)
                text, lo, hi, off, h = segments(u.values, np.cumsum(u.sizes), length, GRAM[words])
                seg = [digest64(u.cut(i, x, y + length)) for i, x, y in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                items = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(seg, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(off, pa.int32())], fields=list(kind))
                cut = np.searchsorted(text, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), items).cast(pa.list_(kind))
                shas = [hashlib.sha256(t).digest() for t in part]
                cols = [pa.array(range(tid, tid + b - a), pa.int64()), batch.column(0).slice(a, b - a), pa.array(shas, pa.binary()), pa.array([len(t) for t in part], pa.int64()), pa.array(u.sizes), lists]
                tid += b - a
                yield pa.RecordBatch.from_arrays(cols, names=["tid", "doc_id", "sha", "n_bytes", "units", "anchors"])

    return run


def _fetch(docs: DataFrame, wanted: DataFrame, column: str, repeated: bool) -> DataFrame:
    """Rows (sha, bytes, column) for wanted (doc_id, sha, column: an array): only rows with a wanted id are read on.

    repeated: some rows agree in id and text, so texts are first made single.
    """
    ids = small_or_not(wanted.select("doc_id").distinct())
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select(docs["doc_id"], F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("bytes", 256)))
    if repeated:
        rows = rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("bytes").alias("bytes"))
        return rows.join(wanted.select("sha", column), "sha").select("sha", "bytes", column)
    size = wanted.agg(F.sum(F.size(column)), F.count("*")).first()
    side = wanted.select(F.col("doc_id").alias("_want"), "sha", column)
    side = F.broadcast(side) if (size[0] or 0) <= BROADCAST_NEEDS and size[1] <= BROADCAST_NEEDS else side
    return rows.join(side, (rows["sha"] == side["sha"]) & rows["doc_id"].eqNullSafe(F.col("_want"))).select(rows["sha"], "bytes", column)


def _cut(length: int, words: bool):
    """Segments cut out of their texts: rows (bytes, needs)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            held = 0
            for data, needs in zip(batch.column(0), batch.column(1), strict=True):
                u = Units([data.as_py()], words)
                for x in needs.as_py():
                    piece = u.cut(0, x["lo"], x["hi"] + length)
                    out.append((x["h"], x["seg"], x["h"], x["seg"], 0, x["off"], x["hi"] - x["lo"] + 1, piece))
                    held += len(piece)
                if held > 4 << 20:
                    yield _pieces(pa, out)
                    out, held = [], 0
            if out:
                yield _pieces(pa, out)

    return run


def _pieces(pa, rows: list[tuple]):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def split_piece(key: int, off: int, wins: int, data: bytes, block: int, length: int, words: bool = False) -> Iterator[tuple[int, int, int, int, bytes]]:
    """A piece cut by blocks of anchor offsets: (key, first window, offset, windows, bytes) of each part.

    The windows of a block share the units from the start of the block's first window to the end of its last; with
    the group's key and the block's number these make the part's key.
    """
    from .anchors import digest64

    at_unit = unit_bounds(data, words)
    units = len(at_unit) - 1

    def cut(a: int, b: int) -> bytes:
        return data[at_unit[min(max(0, a), units)] : at_unit[min(max(0, b), units)]]

    first = 0
    while first < wins:
        at = off - first  # the offset of the anchor in window first; it falls as windows go on
        number = at // block
        n = min(wins - first, at - number * block + 1)
        core_start = off - number * block  # the last window start that the block allows
        core_end = off - (number * block + block - 1) + length
        core = cut(core_start, core_end)
        yield digest64(b"%d,%d,%b" % (key, number, core)), first, at, n, cut(first, first + n - 1 + length)
        first += n


def _split(block: int, length: int, words: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .anchors import digest64

        for batch in batches:
            out: list[tuple] = []
            held = 0
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                h, seg, key, _, rel, off, wins, data = r
                for k, first, at, n, part in split_piece(key, off, wins, data, block, length, words):
                    out.append((h, seg, k, digest64(part), rel + first, at, n, part if block > 1 else b""))
                    held += len(part) + 60
                if held > 4 << 20:
                    yield _pieces(pa, out)
                    out, held = [], 0
            if out:
                yield _pieces(pa, out)

    return run


def needs_of(data: np.ndarray, starts: np.ndarray, wins: np.ndarray, length: int, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """For pieces laid end to end: the bytes of the window at each of its starts (0 elsewhere), and where units begin."""
    if not words:
        valid = np.zeros(len(data) + 1, np.int32)
        np.add.at(valid, starts, length)
        np.add.at(valid, starts + wins, -length)
        return np.cumsum(valid[:-1], dtype=np.int32), np.arange(len(data))
    edge = np.concatenate([[0], np.flatnonzero(data == 32) + 1])  # every piece ends with a space
    begin = edge[:-1]
    first = np.searchsorted(begin, starts)
    owner = np.searchsorted(starts, begin, side="right") - 1
    pick = np.flatnonzero(np.arange(len(begin)) - first[owner] < wins[owner])
    need = np.zeros(len(data), np.int32)
    need[begin[pick]] = edge[pick + length] - begin[pick]
    return need, begin


def _sorted_shard(length: int, words: bool, budget: int):
    """The pieces (key, piece, wins, bytes) of a partition, one shard, as their repeated windows (FOUND)."""

    def run(batches: Iterator) -> Iterator:
        import tempfile

        import pyarrow as pa

        from .induced import repeated_starts

        keys, pieces, wins, sizes = [], [], [], []
        with tempfile.SpooledTemporaryFile(max_size=budget) as store:
            for batch in batches:
                data = batch.column(3).to_pylist()
                store.write(b"".join(data))
                sizes.append(np.array([len(x) for x in data], np.int64))
                for held, col in ((keys, 0), (pieces, 1), (wins, 2)):
                    held.append(batch.column(col).to_numpy())
            if not sizes or not sum(map(len, sizes)):
                return
            n = store.tell()
            store.write(b"\0" * 16)
            if n > budget:
                store.rollover()
                store.flush()
                text = np.memmap(store._file, np.uint8, "r")
            else:
                text = np.frombuffer(store._file.getbuffer(), np.uint8)
            size = np.concatenate(sizes)
            starts = np.cumsum(size) - size
            need, begin = needs_of(text[:n], starts, np.concatenate(wins), length, words)
            unit = np.flatnonzero(repeated_starts(text, need, budget)[begin])  # all bytes are units, or the words' first
            del text
            release()
        if not len(unit):
            return
        owner = np.searchsorted(starts, begin[unit], side="right") - 1
        fresh = np.concatenate([[True], (unit[1:] != unit[:-1] + 1) | (owner[1:] != owner[:-1])])
        f = np.flatnonzero(fresh)
        e = np.append(f[1:], len(unit)) - 1
        o = owner[f]
        zero = np.searchsorted(begin, starts[o])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)[o]), pa.array(np.concatenate(pieces)[o]), pa.array(unit[f] - zero, pa.int32()), pa.array(unit[e] - zero, pa.int32())], names=["key", "piece", "lo", "hi"])

    return run


def _in_shards(pieces: DataFrame, length: int, words: bool, budget: int) -> DataFrame:
    """Repeated windows (key, piece, lo, hi) among distinct pieces, in shards that hold whole groups."""
    total = pieces.select(F.sum(F.octet_length("bytes"))).first()[0] or 0
    dealt = pieces.select("key", "piece", "wins", "bytes").repartition(int(total // SHARD_BYTES) + 1, "key")
    return dealt.mapInArrow(trimmed(_sorted_shard(length, words, budget)), FOUND)


def _repeated_windows(pieces: DataFrame, length: int, words: bool, hot: int, budget: int) -> DataFrame:
    """(h, seg, lo, hi): windows of distinct segments that another segment with the same anchor hash also holds."""
    results, blocks = [], BLOCKS[words]
    for level in range(len(blocks) + 1):
        mine = pieces
        if level:  # pieces that several segments share are repeated throughout; at the first level all are distinct
            whole = pieces.groupBy("key", "piece").agg(F.count("*").alias("n"))
            whole = keep(whole, "op5-whole")
            twice = small_or_not(whole.where("n > 1").select("key", "piece"))
            results.append(keep(pieces.select("h", "seg", "key", "piece", "rel", "wins").join(twice, ["key", "piece"]).select("h", "seg", F.col("rel").alias("lo"), (F.col("rel") + F.col("wins") - 1).alias("hi")), "op5-twice"))
            if level == len(blocks):
                break
            sizes = keep(whole.groupBy("key").agg(F.count("*").alias("pieces")).where("pieces > 1"), "op5-groups")
            mine = pieces.join(small_or_not(sizes.select("key")), "key")
        else:
            sizes = keep(pieces.groupBy("key").agg(F.count("*").alias("pieces")), "op5-groups")
        busy = sizes.where(F.col("pieces") > hot).select("key")
        none = busy.isEmpty()
        calm = mine if none else mine.join(small_or_not(busy), "key", "left_anti")
        if level:
            distinct = keep(calm.select("key", "piece", "wins", "bytes").dropDuplicates(["key", "piece"]), "op5-distinct")
            found = small_or_not(keep(_in_shards(distinct, length, words, budget), "op5-found"))
            ranges = calm.select("h", "seg", "key", "piece", "rel").join(found, ["key", "piece"]).select("h", "seg", (F.col("rel") + F.col("lo")).alias("lo"), (F.col("rel") + F.col("hi")).alias("hi"))
        else:  # a segment is its own piece
            ranges = _in_shards(calm, length, words, budget).select(F.col("key").alias("h"), F.col("piece").alias("seg"), "lo", "hi")
        results.append(keep(ranges, "op5-ranges"))
        if none:
            break
        pieces = keep(mine.join(small_or_not(busy), "key").select(*[x.split()[0] for x in PIECES.split(", ")]).mapInArrow(trimmed(_split(blocks[level], length, words)), PIECES), "op5-split")
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return out


def spans_of(text: bytes, ranges: list[tuple[int, int]], words: bool) -> list[list[int]]:
    """The bytes of a text that ranges of units cover, as maximal runs; a word takes the white space after it along."""
    out: list[list[int]] = []
    for x, y in sorted(ranges):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    if words:
        from .tokens import _FRONT, TextWords

        begin = np.append(TextWords([text], lower=False).begin - _FRONT, len(text))
        out = [[int(begin[x]), int(begin[y])] for x, y in out]
    return out


def _strip(length: int, words: bool, texts: bool):
    """Texts without the bytes that their repeated windows cover: rows (sha, bytes, ranges)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for sha, data, ranges in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text, kept, at, removed = data.as_py(), [], 0, 0
                spans = spans_of(text, [(r["lo"], r["hi"] + length) for r in ranges.as_py()], words)
                for lo, hi in spans:
                    kept.append(text[at:lo])
                    at = hi
                    removed += hi - lo
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((sha.as_py(), removed, len(spans), left.decode("utf-8", "ignore") if texts else hashlib.sha256(left).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["sha", "n_removed", "n_spans", "kept"])

    return run


def _analysed(docs: DataFrame, length: int, words: bool, hot: int, budget: int, texts: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, sha, n_bytes) and, for each text that loses bytes, (sha, n_removed, n_spans, kept)."""
    listed = keep(docs.mapInArrow(trimmed(_list(length, words)), LISTED.format(id=docs.schema["doc_id"].dataType.simpleString())), "op5-listed")
    rows = listed.select("tid", "doc_id", "sha", "n_bytes")
    once = listed.groupBy("sha").agg(F.min("tid").alias("lead"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("units").alias("units"))
    copied = keep(once.where("copies > 1"), "op5-copied")
    again = small_or_not(rows.join(small_or_not(copied.select("sha", "lead")), "sha").where("tid <> lead").select("tid"))
    repeated = not rows.groupBy("doc_id", "sha").count().where("count > 1").isEmpty()
    # Anchors of one row for each distinct text, and of these the ones whose hash is not alone.
    anchors = listed.join(again, "tid", "left_anti").select("tid", F.inline("anchors"))
    shared = keep(anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("seg").alias("x"), F.max("seg").alias("y")).where("n > 1").select("h", (F.col("x") != F.col("y")).alias("several")), "op5-shared")
    places = keep(anchors.join(small_or_not(shared), "h").select("tid", "h", "seg", "lo", "hi", "off", "several"), "op5-places")
    segs = keep(places.groupBy("h", "seg", "several").agg(F.count("*").alias("n"), F.min(F.struct("tid", "lo", "hi", "off")).alias("at")), "op5-segments")
    lead = segs.where("several").select(F.col("at.tid").alias("tid"), F.struct("h", "seg", "at.lo", "at.hi", "at.off").alias("need"))
    needs = keep(lead.groupBy("tid").agg(F.collect_list("need").alias("needs")).join(rows, "tid").select("doc_id", "sha", "needs"), "op5-needs")
    pieces = keep(_fetch(docs, needs, "needs", repeated).select("bytes", "needs").mapInArrow(trimmed(_cut(length, words)), PIECES), "op5-pieces")
    windows = keep(_repeated_windows(pieces, length, words, hot, budget).select("h", "seg", F.col("lo").alias("a"), F.col("hi").alias("b")), "op5-windows")
    # Ranges of windows at every place: whole segments that stand twice, and what the shards found in the others.
    whole = places.join(small_or_not(segs.where("n > 1").select("h", "seg")), ["h", "seg"]).select("tid", "lo", "hi")
    inner = places.join(small_or_not(windows), ["h", "seg"]).select("tid", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"))
    ranges = whole.union(inner).groupBy("tid").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    ranges = ranges.join(rows, "tid").join(small_or_not(copied.select("sha")), "sha", "left_anti")
    ranges = keep(ranges.select("doc_id", "sha", "ranges"), "op5-covered")
    lost = _fetch(docs, ranges, "ranges", repeated).mapInArrow(trimmed(_strip(length, words, texts)), STRIPPED)
    gone = copied.where(F.col("units") >= length)
    empty = F.lit("" if texts else hashlib.sha256(b"").hexdigest())
    return rows.drop("tid"), lost.union(gone.select("sha", "n_bytes", F.lit(1).cast("long"), empty))


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: bool = False, hot: int = HOT, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document; length in bytes, or in words if so asked."""
    rows, lost = _analysed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), length, words, hot, budget, False)
    out = rows.join(lost, "sha", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", F.lower(F.hex("sha"))).alias("kept_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", length: int = PASSAGE, words: bool = True) -> DataFrame:
    """The documents with the remaining text, all rows and columns kept; chars_col is set to its code points.

    Without further arguments passages of over 50 words go that stand elsewhere, too. Bytes of a character that was
    cut in two are left out with it.
    """
    _, lost = _analysed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), length, words, HOT, BUDGET, True)
    sha, kept = unused(docs, "sha", "kept")
    lost = keep(lost.select(F.col("sha").alias(sha), F.col("kept").alias(kept)), "op5-lost")
    rows = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))
    same = rows.join(small_or_not(lost.select(sha)), sha, "left_anti").drop(sha)
    new = rows.drop(text_col).join(lost, sha).withColumn(text_col, F.col(kept))
    if chars_col and chars_col in docs.columns:
        new = new.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType))
    return same.unionByName(new.select(*same.columns)).select(*docs.columns)
