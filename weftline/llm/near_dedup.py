"""Near-duplicate groups by b-bit MinHash.

Documents with equal shingle sets are one node. Nodes get 128 minima; 32 bands of four minima give candidate
buckets, the low four bits of each minimum are packed in eight words, and the collision-corrected likeness of a
candidate pair comes from bit counts of their difference. Pairs whose estimate is not far below the threshold are
confirmed on the full sets, and the links' connected components are the groups. Two sets at the threshold 0.75
share no band with probability (1 - 0.75^4)^32 = 5e-6; the estimate's margin is four standard deviations.

No bucket emits all its pairs. In a first round its members' packed signatures are compared in blocks, and only a
forest of the likeliest pairs is emitted to be confirmed: what those links join needs no further pair. In a second
round, over all pairs of blocks, the members that still have a likely partner in another component meet with their
full sets, whose intersections are all counted at once, and a forest of the true links is emitted. So no link
between components is dropped, and what is emitted grows with the members. A pair that shares several buckets is
looked at in the one of its first band. Before blocks of a bucket of more than BIG members meet in pairs, it is split
exactly: each member goes to the buckets of its rarest shingles, as many as two linked sets must share one of (what
all members of a template have in common is rare in none), so that only members that may be linked meet.

Texts without words (null, empty, white space) have an empty set, are linked with nothing and are kept. A repeated
row is linked with its copies. Null ids come last: a group's id is null only if all its ids are. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, small_or_not, trimmed, unused
from .graphs import components, merged
from .shingles import BITS, HASHES

#: How far below the threshold an estimate may lie before its pair is dropped unseen: four standard deviations.
MARGIN = 0.16
#: Members of a bucket that are compared in one piece.
BLOCK = 1024
#: Members beyond which a bucket that is still open is split by its members' rarest shingles.
BIG = 16 * BLOCK

SIGNED = "doc_id {id}, n_shingles bigint, node binary, bands array<bigint>, sig array<bigint>"
SETS = "node binary, items array<bigint>"


def _sign(batches: Iterator) -> Iterator:
    import pyarrow as pa

    from . import shingles as S

    words = S.Words()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            n, nodes, bands, sigs = [], [], [], []
            for t in part.column(1).to_pylist():
                s = S.shingle_set(words(t))
                n.append(len(s))
                nodes.append(S.set_key(s))
                m = S.minima(s) if len(s) else None
                bands.append(None if m is None else S.bands(m))
                sigs.append(None if m is None else S.packed(m))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "bands", "sig"])


def _sets(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    from . import shingles as S

    words = S.Words()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            nodes, items = [], []
            for t in batch.slice(start, 256).column(1).to_pylist():
                s = S.shingle_set(words(t))
                if len(s):
                    nodes.append(S.set_key(s))
                    items.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(items, pa.list_(pa.int64()))], names=["node", "items"])


def estimate(a: Column, b: Column) -> Column:
    """Likeness from two packed signatures: the share of equal lanes, corrected for lanes equal by chance."""
    lanes = int("1" * (64 // BITS), 16)
    lanes = lanes - (1 << 64) if lanes >> 63 else lanes

    def unequal(x: Column) -> Column:
        for s in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        return F.bit_count(x.bitwiseAND(F.lit(lanes)))

    off = sum((unequal(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(HASHES * BITS // 64)), F.lit(0))
    chance = 2.0**-BITS
    return ((1 - off / HASHES) - chance) / (1 - chance)


class _Linker:
    """Holds documents and nodes; confirms candidate pairs on full sets."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, percent: int) -> None:
        self.docs, self.nodes, self.percent = docs, nodes, percent

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, items) for the nodes wanted: their sets, from one document each."""
        ids = small_or_not(wanted.distinct().join(self.nodes, "node").select(F.col("first").alias("doc_id")).distinct())
        texts = self.docs.join(ids, self.docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("doc_id", "text")
        return keep(texts.mapInArrow(trimmed(_sets), SETS).groupBy("node").agg(F.first("items").alias("items")), "op8-sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that are links."""
        side = lambda c: self.nodes.select(F.col("node").alias(c), F.col("sig").alias(f"{c}_sig"), F.col("n_shingles").alias(f"{c}_n"))
        near = pairs.join(side("a"), "a").join(side("b"), "b")
        near = near.where((100 * F.least("a_n", "b_n") >= self.percent * F.greatest("a_n", "b_n")) & (estimate(F.col("a_sig"), F.col("b_sig")) >= self.percent / 100 - MARGIN))
        near = keep(near.select("a", "b", "a_n", "b_n"), "op8-near")
        sets = self.sets(near.select(F.col("a").alias("node")).union(near.select("b")))
        of = lambda c: sets.select(F.col("node").alias(c), F.col("items").alias(f"{c}_items"))
        both = near.join(of("a"), "a").join(of("b"), "b")
        met = F.size(F.array_intersect("a_items", "b_items"))
        both = both.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("total"), met.cast("long").alias("met"))
        return both.where(100 * F.col("met") >= self.percent * (F.col("total") - F.col("met"))).select("a", "b")

    def links_within(self, asked: DataFrame) -> DataFrame:
        """A forest of the links between components among the members (key, node, comp) of each key."""
        sets = self.sets(asked.select("node"))
        rows = asked.join(sets, "node").select("key", "node", "comp", "items")
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_meet(self.percent)), "a binary, b binary").distinct()


def likely_pairs(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, lanes that agree) of members of different components that may be links.

    sig: packed signatures; n: set sizes; side: where given, only pairs of different sides are compared.
    """
    lanes = np.uint64(int("1" * (64 // BITS), 16))
    chance = 2.0**-BITS
    least = ((percent / 100 - MARGIN) * (1 - chance) + chance) * HASHES
    out = []
    step = max(1, (1 << 18) // max(1, len(sig)))
    for a in range(0, len(sig) - 1, step):
        b = min(a + step, len(sig))
        x = sig[a:b, None, :] ^ sig[None, a:, :]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        x &= lanes
        agree = HASHES - np.bitwise_count(x).sum(axis=2, dtype=np.int64)
        ok = (agree >= least) & (comp[a:b, None] != comp[None, a:]) & (100 * np.minimum(n[a:b, None], n[None, a:]) >= percent * np.maximum(n[a:b, None], n[None, a:]))
        ok &= np.arange(a, b)[:, None] < np.arange(a, len(sig))[None, :]
        if side is not None:
            ok &= side[a:b, None] != side[None, a:]
        i, j = np.nonzero(ok)
        out.append((i + a, j + a, agree[i, j]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def forest(i: np.ndarray, j: np.ndarray, order: np.ndarray, comp: np.ndarray) -> list[int]:
    """Of pairs (i, j), in order, those that join components (numbers) not yet joined."""
    top = list(range(int(comp.max(initial=-1)) + 1))

    def root(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    out = []
    for k in order.tolist():
        a, b = root(int(comp[i[k]])), root(int(comp[j[k]]))
        if a != b:
            top[a] = b
            out.append(k)
    return out


def _by_key(batches: Iterator, lists: dict[str, int]) -> Iterator[tuple[int, dict]]:
    """Rows sorted by their first column, key by key: lists of values by column name; lists: array columns and their place."""
    key, held = None, None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        names = batch.schema.names[1:]
        cols = {c: batch.column(k + 1).to_pylist() for k, c in enumerate(names) if c not in lists}
        for c in lists:
            col = batch.column(names.index(c) + 1)
            flat, off = col.values.to_numpy(), col.offsets.to_numpy()
            cols[c] = [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
            if held is None or keys[a] != key:
                if held is not None and len(held["node"]) > 1:
                    yield key, held
                key, held = keys[a], {c: [] for c in names}
            for c in names:
                held[c] += cols[c][a:b]
    if held is not None and len(held["node"]) > 1:
        yield key, held


def _numbers(values: list) -> np.ndarray:
    seen: dict = {}
    return np.array([seen.setdefault(v, len(seen)) for v in values])


def _compare(ask: bool, percent: int):
    """Members sorted by key: a forest of likely pairs (a, b), or, to ask further, the members (key, node, comp) that have any."""

    def likely(rows: dict) -> tuple:
        comp, side = _numbers(rows["comp"]), np.array(rows["side"])
        sig = np.stack(rows["sig"]).view(np.uint64)
        i, j, agree = likely_pairs(sig, np.array(rows["n"]), comp, side if len(np.unique(side)) > 1 and ask else None, percent)
        if len(i):
            bands = np.stack(rows["bands"])
            same = bands[i] == bands[j]
            mine = bands[i, same.argmax(axis=1)] == rows["bucket"][0]
            i, j, agree = i[mine], j[mine], agree[mine]
        return i, j, agree, comp

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []
        for key, rows in _by_key(batches, {"sig": 0, "bands": 0}):
            i, j, agree, comp = likely(rows)
            node = rows["node"]
            if ask:
                out += [(int(key), node[k], rows["comp"][k]) for k in np.union1d(i, j).tolist()]
            else:
                out += [tuple(sorted((node[i[k]], node[j[k]]))) for k in forest(i, j, np.argsort(-agree, kind="stable"), comp)]
            if len(out) > 10_000:
                yield made(pa, out)
                out = []
        if out:
            yield made(pa, out)

    def made(pa, out: list[tuple]):
        cols = list(zip(*out, strict=True))
        if ask:
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["key", "node", "comp"])
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in cols], names=["a", "b"])

    return run


def true_links(sets: list[np.ndarray], comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between members of different components, from products of their incidence matrix."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    item = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    met = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for a in range(0, int(item[-1]) + 1, width):
        lo, hi = np.searchsorted(item, [a, a + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[lo:hi], item[lo:hi] - a] = 1
        met += x @ x.T
    met = np.rint(met).astype(np.int64)
    i, j = np.nonzero((100 * met >= percent * (n[:, None] + n[None] - met)) & (comp[:, None] != comp[None]))
    i, j = i[i < j], j[i < j]
    return [(int(i[k]), int(j[k])) for k in forest(i, j, np.arange(len(i)), comp)]


def _meet(percent: int):
    """Members (key, node, comp, items) sorted by key: links (a, b)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, rows in _by_key(batches, {"items": 0}):
            out = [tuple(sorted((rows["node"][a], rows["node"][b]))) for a, b in true_links(rows["items"], _numbers(rows["comp"]), percent)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in zip(*out, strict=True)], names=["a", "b"])

    return run


def _compared(members: DataFrame, ask: bool, percent: int) -> DataFrame:
    """What _compare finds among bucket members (bucket, size, head, node, comp, n_shingles, sig, bands, part).

    Buckets (or parts of them) of more than BLOCK members are dealt in blocks by a hash of the node. The head goes to
    every block of its bucket; when asking further, every two blocks meet.
    """
    k = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.hash("node"), k)
    if ask:
        other = F.transform(F.sequence(F.lit(0), k - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
        dealt = members.withColumn("to", F.explode(other))
    else:
        every = F.transform(F.sequence(F.lit(0), k - 1), lambda x: F.struct(x.alias("i"), x.alias("j")))
        dealt = members.withColumn("to", F.explode(F.when(F.col("node") == F.col("head"), every).otherwise(F.array(F.struct(own.alias("i"), own.alias("j"))))))
    part = F.col("part") if "part" in members.columns else F.lit(0).cast("bigint")
    rows = dealt.select(F.xxhash64("bucket", part, "to.i", "to.j").alias("key"), own.alias("side"), "bucket", "node", "comp", F.col("n_shingles").alias("n"), "sig", "bands")
    sorted_ = rows.repartition("key").sortWithinPartitions("key")
    if ask:
        return sorted_.mapInArrow(trimmed(_compare(True, percent)), "key bigint, node binary, comp binary")
    return sorted_.mapInArrow(trimmed(_compare(False, percent)), "a binary, b binary").distinct()


def _parted(members: DataFrame, linker: _Linker, big: int) -> DataFrame:
    """members with part: 0 in buckets of at most big members; the others once for each of their rarest shingles.

    Of two sets of which percent of the union is shared, each holds percent of the other's size at least, so in any
    one order of shingles the first n - ceil(n * percent / 100) + 1 of either have one in common. The order is by how
    many members of the bucket hold a shingle. A shingle that one member holds brings nobody together.
    """
    calm = members.where(F.col("size") <= big).withColumn("part", F.lit(0).cast("bigint"))
    large = members.where(F.col("size") > big)
    if large.isEmpty():
        return calm
    sets = linker.sets(large.select("node"))
    items = keep(large.select("bucket", "node", "n_shingles").join(sets, "node").select("bucket", "node", "n_shingles", F.explode("items").alias("part")), "op8-items")
    held = keep(items.groupBy("bucket", "part").agg(F.count("*").alias("held")), "op8-held")
    first = Window.partitionBy("bucket", "node").orderBy("held", "part")
    need = F.col("n_shingles") - F.ceil(F.col("n_shingles") * linker.percent / 100) + 1
    rare = items.join(held, ["bucket", "part"]).withColumn("rank", F.row_number().over(first)).where((F.col("rank") <= need) & (F.col("held") > 1)).select("bucket", "node", "part")
    rare = keep(rare, "op8-rare")
    sizes = rare.groupBy("bucket", "part").agg(F.count("*").alias("size")).where("size > 1")
    parts = rare.join(sizes, ["bucket", "part"]).join(large.drop("size"), ["bucket", "node"])
    return calm.unionByName(parts.select(*calm.columns))


def _open(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, with these."""
    tagged = members.drop("comp").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tagged = keep(tagged.select(*members.columns), "op8-tagged")
    several = tagged.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    return tagged.join(several, "bucket").select(*members.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document; links need 100 * |both| >= percent * |either|."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = keep(docs.mapInArrow(trimmed(_sign), SIGNED.format(id=docs.schema["doc_id"].dataType.simpleString())), "op8-signed")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = keep(nodes, "op8-nodes")
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = keep(dealt.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("tail"), F.count("*").alias("size")).where("size > 1"), "op8-buckets")
    large = buckets.where("size > 2").select("bucket", "head", "size")
    members = dealt.join(large, "bucket").join(nodes.select("node", "n_shingles", "sig", "bands"), "node")
    members = keep(members.withColumn("comp", F.col("node")), "op8-members")
    linker = _Linker(docs, nodes, percent)
    twos = buckets.where("size = 2").select(F.col("head").alias("a"), F.col("tail").alias("b"))
    pairs = keep(twos.union(_compared(members, False, percent)).distinct(), "op8-pairs")
    groups = components(linker.links(pairs))
    asked = keep(_compared(_parted(_open(members, groups), linker, BIG), True, percent), "op8-asked")
    if not asked.isEmpty():
        groups = merged(groups, keep(linker.links_within(asked), "op8-links"))
    named = nodes.select("node", "first").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = named.join(named.groupBy("comp").agg(F.min("first").alias("component")), "comp").select("node", "component")
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    comp = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that near_duplicates keeps, with all their columns; of rows with one id and group only one.

    Documents without words are in no group and stay.
    """
    judged = keep(near_duplicates(docs, id_col, text_col), "op8-judged")
    key, n = unused(docs, "_id", "_n")
    gone = small_or_not(judged.where("not kept").select(F.col("doc_id").alias(key)).distinct())
    same = F.col(id_col).eqNullSafe(F.col(key))
    rows = docs.join(gone, same, "left_anti")
    again = judged.where("kept and n_shingles > 0").groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key)
    again = keep(again, "op8-again")
    if again.isEmpty():
        return rows
    again = small_or_not(again)
    # Columns of kinds that have no order, such as maps, are ordered as text.
    w = Window.partitionBy(id_col).orderBy(*[F.col(c) if docs.schema[c].dataType.typeName() not in ("map", "variant") else F.col(c).cast("string") for c in docs.columns])
    first = rows.join(again, same, "left_semi").withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)
    return rows.join(again, same, "left_anti").unionByName(first)
