"""Mixing sources to target weights by pivotal dependent rounding.

Sources get weights 5, 2, 1, repeating in code point order of their names (null last), which share all words of the
table; a target stops at CAP times its source's words and the excess is shared out again by weight. A document of a
source is wanted target / source words times: the whole part is taken at once, the fraction is rounded dependently.
Pairs of fractional documents pass word mass between each other, in a random direction that keeps each expectation,
until one is whole; so all but one document of a group become whole and the words taken keep their sum. Documents
far larger than the rest come first and are made whole by trading with all smaller ones in equal shares. The one
left over goes on to the next level of a reduction tree, and the last of a source is rounded by its own fraction. At
the root what that leaves is settled: documents there, the largest first, change sides as long as that brings the
words taken nearer to the target. A document's copies stay the whole numbers next to what is wanted of it.

Groups are (source, chunk) with about CHUNK documents, chunks dealt by a hash of the row, so a source with most rows
is many groups. Every random number is a hash of the documents paired, so reruns agree. Texts that are null or hold no
words have size 0 and are taken 0 times. Repeated rows are documents of their own. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, keep, small_or_not, unused

WEIGHTS, CAP, CHUNK, SEED = (5, 2, 1), 3.0, 4096, 20240301
#: A document of more than LARGE times its group's middle size trades mass with all smaller ones at once.
LARGE = 6


def targets(sizes: dict, weights: tuple = WEIGHTS, cap: float = CAP) -> dict:
    """Target words of each source, from the words it has."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = float(sum(sizes.values()))
    out: dict = {}
    free = set(order)
    while free:
        w = sum(weight[s] for s in free)
        share = {s: total * weight[s] / w for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            total -= out[s]
        free -= over
    return out


def _unit(*keys: int) -> float:
    x = SEED
    for k in keys:
        x = (x ^ k) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
        x = x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 32
    return (x >> 11) / 9007199254740992.0


def pair_off(keys: list[int], sizes: list[int], shares: list[float]) -> list[float]:
    """Shares in [0, 1] after pairing one document with the next: all but at most one become 0 or 1.

    Documents come from the largest down; those of size 0 have share 0.
    """
    eps = 1e-9
    shares = [0.0 if p < eps else 1.0 if p > 1 - eps else p for p in shares]
    part = [i for i, p in enumerate(shares) if p not in (0.0, 1.0)]
    if part:
        middle = sorted(sizes[i] for i in part)[len(part) // 2]
        rest, low, high, shift = sum(sizes[i] for i in part), min(shares[i] for i in part), max(shares[i] for i in part), 0.0
        for at, i in enumerate(part):
            if sizes[i] <= LARGE * middle:
                break
            p, others = shares[i] + shift, rest - sizes[i]
            take = _unit(keys[i]) < p
            moved = shift - sizes[i] * ((1.0 if take else 0.0) - p) / max(1, others)
            if not (low + moved > 0.0 and high + moved < 1.0):
                break
            shares[i], shift, rest = 1.0 if take else 0.0, moved, others
            at += 1
        else:
            at = len(part)
        for i in part[at:]:
            shares[i] += shift
    held = -1
    for i, p in enumerate(shares):
        if p in (0.0, 1.0):
            continue
        if held < 0:
            held = i
            continue
        a, b = sizes[held], sizes[i]
        p = shares[held]
        q = shares[i]
        up = min(a * (1 - p), b * q)  # words that may go from i to held
        down = min(a * p, b * (1 - q))  # and back
        move = up if _unit(keys[held], keys[i]) * (up + down) < down else -down
        p, q = p + move / a, q - move / b
        p = 0.0 if p < eps else 1.0 if p > 1 - eps else p
        q = 0.0 if q < eps else 1.0 if q > 1 - eps else q
        shares[held], shares[i] = p, q
        if p in (0.0, 1.0):
            held = i if q not in (0.0, 1.0) else -1
    return shares


def settle(keys: list[int], sizes: list[int], before: list[float], after: list[float]) -> list[float]:
    """Shares of a tree's root, all whole: the last fraction is rounded by itself, and what that leaves is settled.

    Documents whose share was a fraction before change sides, the largest first, as long as the words taken come
    nearer to their sum; so what is left is about half of a small document.
    """
    after = [(1.0 if _unit(k, 1) < p else 0.0) if p not in (0.0, 1.0) else p for k, p in zip(keys, after, strict=True)]
    rest = sum(s * (q - p) for s, p, q in zip(sizes, before, after, strict=True))
    for i in sorted(range(len(keys)), key=lambda i: (-sizes[i], keys[i])):
        if 1e-9 < before[i] < 1 - 1e-9 and sizes[i]:
            turned = rest + sizes[i] * (1 - 2 * after[i])
            if abs(turned) < abs(rest):
                after[i], rest = 1 - after[i], turned
    return after


def _level(pdf):
    """One group of the tree, paired off from the largest document down, so that the one left over tends to be small."""
    pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
    keys, sizes, shares = [k & 0xFFFFFFFFFFFFFFFF for k in pdf["key"].tolist()], pdf["size"].tolist(), pdf["share"].tolist()
    after = pair_off(keys, sizes, shares)
    return pdf.assign(share=settle(keys, sizes, shares, after) if pdf["chunks"].iloc[0] <= 1 else after)


def _final(share: Column) -> Column:
    return share.isin(0.0, 1.0)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies * size) for each document."""
    size = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text_col), F.lit(WORD))).cast("long")
    key = F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col))
    rows = keep(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")), "op3-sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row for each source
    want = targets({r["source"]: r["size"] for r in found}, weights, cap)
    spark = docs.sparkSession
    schema = f"source {docs.schema[source_col].dataType.simpleString()}, source_size bigint, target double, chunks bigint"
    plan = spark.createDataFrame([(r["source"], r["size"], float(want[r["source"]]), math.ceil(r["n"] / CHUNK)) for r in found], schema)
    # One row for each source; its size is that of the list just read, so it is small.
    plan = F.broadcast(plan) if len(found) <= 100_000 else plan
    p = plan.withColumnRenamed("source", "_s")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(p, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("wanted", F.when(F.col("size") > 0, wanted).otherwise(0.0))
    base = F.floor(F.col("wanted") + 1e-12)
    rows = rows.withColumn("base", base).withColumn("share", F.greatest(F.col("wanted") - F.col("base"), F.lit(0.0)))
    part = rows.select("doc_id", "source", "size", "key", "source_size", "target", "base", "share", "chunks", F.pmod("key", "chunks").alias("chunk"))
    most = max((math.ceil(r["n"] / CHUNK) for r in found), default=0)
    done = None
    while True:
        part = keep(part.groupBy("source", "chunk").applyInPandas(_level, part.schema), "op3-level")
        if most <= 1:
            break
        whole = part.where(_final(F.col("share")))
        done = whole if done is None else done.unionByName(whole)
        most = math.ceil(most / CHUNK)
        chunks = F.ceil(F.col("chunks") / CHUNK)
        part = part.where(~_final(F.col("share"))).withColumn("chunks", chunks).withColumn("chunk", F.pmod("key", "chunks"))
    out = part if done is None else done.unionByName(part)
    copies = (F.col("base") + F.col("share")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents as the mix takes them: each row as often as its copies say, with all its columns.

    Rows that share an id get their copies in the order of their sizes.
    """
    key, plan_col, n, i = unused(docs, "_id", "_plan", "_n", "_i")
    plan = mix_documents(docs, id_col, source_col, text_col).groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("size", "copies"))).alias(plan_col))
    once = plan.where(F.size(plan_col) == 1).select(key, F.col(plan_col)[0]["copies"].alias(n)).where(F.col(n) > 0)
    single = docs.join(small_or_not(keep(once, "op3-copies")), F.col(id_col).eqNullSafe(F.col(key))).drop(key)
    more = keep(plan.where(F.size(plan_col) > 1), "op3-repeated")
    if more.isEmpty():
        rows = single
    else:
        from pyspark.sql import Window

        size = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text_col), F.lit(WORD)))
        w = Window.partitionBy(id_col).orderBy(size, text_col, source_col)
        many = docs.join(more, F.col(id_col).eqNullSafe(F.col(key))).withColumn(n, F.get(plan_col, F.row_number().over(w) - 1)["copies"])
        rows = single.unionByName(many.where(F.col(n) > 0).drop(key, plan_col))
    return rows.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(i, n)
