"""Scoring texts with a hashed maximum-entropy language model.

Tokens are the words of a text, A-Z lower-cased, and one end mark. A token's class is a path of DEPTH steps through a
tree with FAN ways at each node: the most frequent tokens have a leaf each in the first half of the tree, the others
go by hashes of their last bytes, two at the first step and more below, into the second half. Every step is a softmax
over the FAN ways, given the node and the two words before: the sum of four rows of weights, the node's bias (the
shares of the training tokens) and rows hashed from the node with the previous word, with the word before that (a skip
feature) and with both (n-gram features of two and three words). So the context decides the class and, within it, the class below. Within a leaf a
token's share is (c + 0.1) / (N + 0.1 * (V + 1)) over the leaf's tokens, so each leaf keeps room for one unseen token
and the probabilities sum to one.

Training passes over every training document once, in ROUNDS parts. In each part every partition starts from the
current weights, makes gradient updates on minibatches of its tokens and sends its rows of weights with the numbers
of decisions seen; a reduction tree averages them by these numbers. Since partitions train on their own, scores
depend a little on how the table is dealt. The number of rows grows with the training tokens, from LEAST_ROWS to
MOST_ROWS for each kind of feature, which bounds what workers are sent at 12 MB. Counts cover all training tokens and
grow with the words. The most frequent tokens' counts, at most HEAD, go to the workers; those of all other tokens are
joined by token, after each document's tokens were counted.

A word stands for itself by 128 bits of its hash (a frequent one by 64 of them). Null texts count as empty: one end
mark. A null id is held out. Repeated rows are documents of their own. With no training tokens the base probability
is 1 / (0.1 * 1) * 0.1 = 1, so base scores are 0, and every leaf is as likely as the others. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, trimmed
from .tokens import END1, END2, TextWords, encoded

SMOOTH = 0.1
FAN, DEPTH, KINDS = 16, 2, 3
LEAVES = FAN**DEPTH
SINGLE = LEAVES // 2
NODES = sum(FAN**k for k in range(DEPTH))
#: Rows of weights for each kind of feature: one for so many training tokens, within the bounds.
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 64, 1 << 10, 1 << 16
BLOCK_ROWS, FAN_IN = 512, 32
#: Training tokens for each row that a partition sends: KINDS packed rows of 36 bytes each for about 100 bytes of text.
TOKENS_A_PART = 16
ROUNDS, BATCH, RATE, CEILING = 2, 8192, 0.5, 60.0
HEAD, BLOCK = 65536, 1 << 18
_U = np.uint32


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


class Tokens:
    """The tokens of texts: words with an end mark after each text's last."""

    def __init__(self, texts: list[bytes]) -> None:
        w = self.words = TextWords(texts)
        n = len(w.h1)
        self.at = np.arange(n) + w.text  # of each word among the tokens
        self.counts = np.diff(np.append(w.starts, n)) + 1
        self.starts = np.cumsum(self.counts) - self.counts
        self.ends = self.starts + self.counts - 1
        self.h1 = np.full(n + len(texts), END1, np.uint64)
        self.h1[self.at] = w.h1

    def suffix_leaves(self) -> np.ndarray:
        """The leaf of each token if it isn't one of the most frequent, by its last bytes."""
        w = self.words
        leaf = np.zeros(len(w.h1), np.int64)
        for k, x in enumerate(w.last(*range(2, DEPTH + 2))):
            x *= np.uint64(0x9E3779B97F4A7C15)
            step = (x >> np.uint64(50)).astype(np.int64)
            leaf = leaf * FAN + (step & (FAN - 1) if k else FAN // 2 + (step & (FAN // 2 - 1)))
        out = np.full(len(self.h1), LEAVES - 1, np.int64)
        out[self.at] = leaf
        return out

    def second(self, tokens: np.ndarray) -> np.ndarray:
        """The second numbers of some tokens' hashes; tokens: their places, ascending."""
        out = np.full(len(tokens), END2, np.uint64)
        text = np.searchsorted(self.starts, tokens, side="right") - 1
        word = tokens != self.ends[text]
        out[word] = self.words.second((tokens - text)[word])
        return out


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, int, Tokens]]:
    from .common import blocks

    for a, b in blocks(texts, BLOCK):
        yield a, b, Tokens([encoded(t) for t in texts[a:b]])


def _count(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held: list[tuple] = []

    def added(parts: list[tuple]) -> tuple:
        """Rows (h1, h2, leaf, c) with the counts of equal tokens added."""
        h1, h2, leaf, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((h2, h1))
        h1, h2, leaf, c = h1[order], h2[order], leaf[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        return h1[first], h2[first], leaf[first], np.add.reduceat(c, first)

    def flushed() -> pa.RecordBatch:
        h1, h2, leaf, c = added(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(leaf.astype(np.int16)), pa.array(c)], names=["h1", "h2", "leaf", "c"])

    for batch in batches:
        for _, _, t in batches_of(batch.column(0).to_pylist()):
            order = np.argsort(t.h1)
            s = t.h1[order]
            fresh = np.concatenate([[True], s[1:] != s[:-1]])
            first = np.flatnonzero(fresh)
            some = np.sort(order[first])
            h2, leaf = t.second(some), t.suffix_leaves()
            place = np.empty(len(s), np.int64)
            place[some] = np.arange(len(some))
            c = np.empty(len(some), np.int64)
            c[place[order[first]]] = np.diff(np.append(first, len(s)))
            held.append((t.h1[some], h2, leaf[some], c))
            if sum(len(x[0]) for x in held) > 600_000:
                held[:] = [added(held)]
                if len(held[0][0]) > 400_000:
                    yield flushed()
    if held:
        yield flushed()


class Lexicon:
    """The head: for a token's hash its leaf (or -1: by its last bytes) and log10(c + SMOOTH), NaN outside the head.

    A word stands in one of two slots, frequent ones first; the few that find both taken count as any other word.
    """

    def __init__(self, h1: np.ndarray, c: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(h1)).bit_length())
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.log = np.full(1 << self.bits, np.nan)
        self.leaf = np.full(1 << self.bits, -1, np.int16)
        self.place = np.full(len(h1), -1)
        used = np.zeros(1 << self.bits, bool)
        for slot in self._slots(h1):
            left = np.flatnonzero(self.place < 0)
            left = left[~used[slot[left]]]
            at, first = np.unique(slot[left], return_index=True)
            i = left[first]
            used[at], self.place[i] = True, at
            self.key[at], self.log[at] = h1[i], np.log10(c[i] + SMOOTH)

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64), (h & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __call__(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The leaf and the logarithm of each token."""
        a, b = self._slots(t.h1)
        at = np.where(self.key.take(a) == t.h1, a, b)
        found = self.key.take(at) == t.h1
        log = np.where(found, self.log.take(at), np.nan)
        own = np.where(found, self.leaf.take(at), -1).astype(np.int64)
        return np.where(own >= 0, own, t.suffix_leaves()), log


def decisions(t: Tokens, leaf: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token and step: node, way taken, and in the first axis the rows of the KINDS hashed features."""
    h = (t.h1 >> np.uint64(32)).astype(_U) | _U(1)
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:] = h[:-1]
    one[t.starts] = 0
    two[1:] = one[:-1]
    two[t.starts] = 0
    kinds = np.stack([one * _U(0x9E3779B1), two * _U(0x85EBCA6B) + _U(1), one * _U(0xC2B2AE35) + two * _U(0x27D4EB2F) + _U(2)])
    node = np.empty((len(h), DEPTH), np.int64)
    way = np.empty((len(h), DEPTH), np.int64)
    row = np.empty((KINDS, len(h), DEPTH), np.int64)
    above, base = np.zeros(len(h), np.int64), 0
    for k in range(DEPTH):
        below = leaf // FAN ** (DEPTH - 1 - k)
        node[:, k], way[:, k] = base + above, below % FAN
        x = kinds + (node[:, k].astype(_U) * _U(0x632BE5AB))
        x ^= x >> _U(15)
        x *= _U(0x2C1B3C6D)
        x ^= x >> _U(13)
        row[:, :, k] = x & _U(rows - 1)
        above, base = below, base + FAN**k
    return node.ravel(), way.ravel(), row.reshape(KINDS, -1)


def logits(w: np.ndarray, bias: np.ndarray, node: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Logits of the ways of some decisions, at most CEILING, so that none overflows."""
    z = bias.take(node, axis=0)
    for k in range(KINDS):
        z += w[k].take(row[k], axis=0)
    return np.minimum(z, CEILING, out=z)


def train_block(w: np.ndarray, power: np.ndarray, seen: np.ndarray, bias: np.ndarray, node: np.ndarray, way: np.ndarray, row: np.ndarray) -> None:
    """Gradient updates of w on one block of decisions, by minibatches; power: summed squares of gradients by row."""
    ones = np.ones(FAN, np.float32)
    for a in range(0, len(node), BATCH):
        b = min(a + BATCH, len(node))
        z = logits(w, bias, node[a:b], row[:, a:b])
        np.exp(z, out=z)
        z /= (z @ ones)[:, None]
        z[np.arange(b - a), way[a:b]] -= 1
        for k in range(KINDS):
            order = np.argsort(row[k, a:b].astype(np.uint16), kind="stable")
            s = row[k, a:b].take(order)
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            # Two gradients are added at a time, as the parts of a complex number.
            g = np.add.reduceat(z.take(order, axis=0).view(np.complex64), at, axis=0).view(np.float32)
            u = s[at]
            p = power[k].take(u) + np.einsum("ij,ij->i", g, g)
            power[k][u] = p
            g *= (RATE / np.sqrt(p + 1.0))[:, None]
            w[k][u] -= g
    for k in range(KINDS):
        seen[k] += np.bincount(row[k], minlength=len(seen[k]))


def log_paths(w: np.ndarray, bias: np.ndarray, node: np.ndarray, way: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The natural logarithm of each decision's probability."""
    ones = np.ones(FAN, np.float32)
    p = np.empty(len(node))
    for a in range(0, len(node), BATCH):
        b = min(a + BATCH, len(node))
        z = logits(w, bias, node[a:b], row[:, a:b])
        own = z[np.arange(b - a), way[a:b]].astype(np.float64)
        np.exp(z, out=z)
        p[a:b] = own - np.log((z @ ones).astype(np.float64))
    return p


def _fit_part(docs: DataFrame, lexicon, state, out: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        w, bias = state.value
        w, rows = w.copy(), w.shape[1]
        power, seen = np.zeros((KINDS, rows), np.float32), np.zeros((KINDS, rows), np.float32)
        lex = lexicon.value
        for batch in batches:
            for _, _, t in batches_of(batch.column(0).to_pylist()):
                train_block(w, power, seen, bias, *decisions(t, lex(t)[0], rows))
        if seen.any():
            w = w.reshape(-1, BLOCK_ROWS, FAN)
            seen = seen.reshape(-1, BLOCK_ROWS)
            w[seen == 0] = 0  # weighs nothing in the average, and packs well
            pid = TaskContext.get().partitionId()
            for i in range(0, len(w), 64):
                n = len(w[i : i + 64])
                yield pa.RecordBatch.from_arrays([pa.array([pid] * n, pa.int64()), pa.array(range(i, i + n), pa.int32()), pa.array([x.tobytes() for x in seen[i : i + n]], pa.binary()), pa.array([x.astype(np.float16).tobytes() for x in w[i : i + n]], pa.binary())], names=["part", "block", "seen", "w"])

    return docs.mapInArrow(trimmed(run), out)


def _averaged(pdf):
    """Rows of weights averaged by the numbers of decisions that they saw."""
    total, mean = 0.0, 0.0
    for seen, w in zip(pdf["seen"], pdf["w"], strict=True):
        n = np.frombuffer(seen, np.float32).astype(np.float64)
        total, mean = total + n, mean + n[:, None] * np.frombuffer(w, np.float16).reshape(BLOCK_ROWS, FAN)
    mean = mean / np.maximum(total, 1)[:, None]
    return pdf.head(1).assign(seen=[total.astype(np.float32).tobytes()], w=[mean.astype(np.float16).tobytes()])


def fit_weights(train: DataFrame, lexicon, bias: np.ndarray, rows: int, rounds: int = ROUNDS, parts: int | None = None) -> np.ndarray:
    """The weights after one pass over the texts of train (doc_id, text): rows of them for each kind of feature.

    parts: the most partitions that train on their own, each of which sends all its rows; all of train's by default.
    """
    sc = train.sparkSession.sparkContext
    w = np.zeros((KINDS, rows, FAN), np.float32)
    schema = "part bigint, block int, seen binary, w binary"
    for r in range(rounds):
        part = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r)
        part = part if parts is None else part.coalesce(parts)
        state = sc.broadcast((w, bias))
        sent = _fit_part(part.select("text"), lexicon, state, schema)  # shuffled to the first average, no copy in the shared folder
        while True:
            sent = keep(sent.groupBy(F.floor(F.col("part") / FAN_IN).alias("part"), "block").applyInPandas(lambda pdf: _averaged(pdf).assign(part=pdf["part"].iloc[0] // FAN_IN), schema), "op6-weights")
            if (sent.agg(F.max("part")).first()[0] or 0) == 0:
                break
        w = w.reshape(-1, BLOCK_ROWS, FAN)
        for row in sent.toLocalIterator():  # KINDS * rows / BLOCK_ROWS rows
            seen = np.frombuffer(row["seen"], np.float32) > 0
            w[row["block"]][seen] = np.frombuffer(row["w"], np.float16).astype(np.float32).reshape(BLOCK_ROWS, FAN)[seen]
        w = w.reshape(KINDS, rows, FAN)
        state.unpersist()
    return w


SCORED = "row bigint, doc_id {id}, n_tokens bigint, n_head bigint, log_head double, log_path double, tail array<struct<h1: bigint, h2: bigint, n: int>>"


def _score(docs: DataFrame, lexicon, state, out: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        w, bias, less = state.value  # less: log10 of each leaf's N + SMOOTH * (V + 1)
        lex = lexicon.value
        row = TaskContext.get().partitionId() << 33
        kind = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32())]))
        for batch in batches:
            for a, b, t in batches_of(batch.column(1).to_pylist()):
                leaf, log = lex(t)
                p = log_paths(w, bias, *decisions(t, leaf, w.shape[1])).reshape(-1, DEPTH).sum(axis=1) / math.log(10) - less[leaf]
                inside = ~np.isnan(log)
                sums = lambda x: np.add.reduceat(x, t.starts)
                out = np.flatnonzero(~inside)
                h1, h2, doc = t.h1[out], t.second(out), np.searchsorted(t.starts, out, side="right") - 1
                order = np.lexsort((h2, h1, doc))
                h1, h2, doc = h1[order], h2[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1])])) if len(out) else out
                items = pa.StructArray.from_arrays([pa.array(h1[first].view(np.int64)), pa.array(h2[first].view(np.int64)), pa.array(np.diff(np.append(first, len(out))), pa.int32())], names=["h1", "h2", "n"])
                tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[first], np.arange(b - a + 1)), pa.int32()), items)
                cols = [pa.array(range(row, row + b - a), pa.int64()), batch.column(0).slice(a, b - a), pa.array(t.counts, pa.int64()), pa.array(sums(inside.astype(np.int64))), pa.array(sums(np.where(inside, log, 0.0))), pa.array(sums(p)), tails.cast(kind)]
                row += b - a
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_tokens", "n_head", "log_head", "log_path", "tail"])

    return docs.mapInArrow(trimmed(run), out)


def _head(counts: DataFrame) -> list:
    """Rows (h1, h2, leaf, c) of the most frequent tokens: all those above a count, at most HEAD of them, most frequent first."""
    step = F.floor(F.log2("c") * 32)
    found = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 2048 rows at most
    held, cut = 0, None
    for s, n in found:
        if held + n > HEAD:
            break
        held, cut = held + n, s
    return [] if cut is None else sorted(counts.where(step >= cut).collect(), key=lambda r: (-r["c"], r["h1"], r["h2"]))


def leaf_counts(counts: DataFrame, head: list, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Tokens N and distinct ones V of each leaf, after the most frequent tokens of lex got leaves of their own."""
    n, v = np.zeros(LEAVES), np.zeros(LEAVES)
    for r in counts.groupBy("leaf").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # a row for each leaf
        n[r["leaf"]], v[r["leaf"]] = r["n"], r["v"]
    order = [i for i in range(len(head)) if lex.place[i] >= 0][:SINGLE]
    for i in order:
        n[head[i]["leaf"]] -= head[i]["c"]
        v[head[i]["leaf"]] -= 1
    for k, i in enumerate(order):
        n[k], v[k] = head[i]["c"], 1
        lex.leaf[lex.place[i]] = k
    return n, v


def biases(n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The logarithm of each way's share at each node, by the training tokens below it."""
    mass, out = n + SMOOTH * (v + 1), []
    for _ in range(DEPTH):
        mass = mass.reshape(-1, FAN)
        out.append(np.log(mass / mass.sum(axis=1, keepdims=True)))
        mass = mass.sum(axis=1)
    return np.concatenate(out[::-1]).astype(np.float32)


def rows_for(tokens: int) -> int:
    return 1 << min(max(-(-tokens // TOKENS_A_ROW), LEAST_ROWS) - 1, MOST_ROWS - 1).bit_length()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = docs.where(~held_out(F.col("doc_id")))
    counted = train.select("text").mapInArrow(trimmed(_count), "h1 bigint, h2 bigint, leaf smallint, c bigint")
    counts = keep(counted.groupBy("h1", "h2").agg(F.first("leaf").alias("leaf"), F.sum("c").alias("c")), "op6-counts")
    head = _head(counts)
    lex = Lexicon(np.array([r["h1"] for r in head], np.int64).view(np.uint64), np.array([r["c"] for r in head], np.float64))
    n, v = leaf_counts(counts, head, lex)
    total, distinct = int(n.sum()), int(v.sum())
    less, bias = np.log10(n + SMOOTH * (v + 1)), biases(n, v)
    lexicon = sc.broadcast(lex)
    w = fit_weights(train, lexicon, bias, rows_for(total), rounds, max(1, total // (TOKENS_A_PART * rows_for(total))))
    state = sc.broadcast((w, bias, less))
    scored = keep(_score(docs, lexicon, state, SCORED.format(id=docs.schema["doc_id"].dataType.simpleString())), "op6-scored")
    tail = scored.select("row", F.inline("tail"))
    got = tail.join(counts.select("h1", "h2", "c"), ["h1", "h2"], "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    got = got.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + SMOOTH)).alias("log_tail"))
    out = scored.drop("tail").join(got, "row", "left")
    log = F.col("log_head") + F.coalesce("log_tail", F.lit(0.0))
    base = math.log10(total + SMOOTH * (distinct + 1))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (log - F.col("n_tokens") * base).alias("base_score"), (log + F.col("log_path")).alias("score"))
