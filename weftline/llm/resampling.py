"""Quality selection by importance resampling.

Two bags of hashed one- and two-word features are counted: of the target (labelled good documents) and of the raw
text (all documents). A document's log weight is the sum over its features of the log ratio of their shares, smoothed towards equal ones.
Documents are drawn without replacement in proportion to their weights by the Gumbel trick: log weight plus a Gumbel
number, the k largest kept. k is the share of good ones among labelled documents, times all documents.

Gumbel numbers are hashes of id and text, so reruns agree and equal rows are kept together; rows that tie with the
k-th are all kept. Words are split at ASCII white space, A-Z lower-cased. Null and empty texts have no features and
log weight 0. Repeated labels count once; a document with different labels counts as bad, as does a toxic one; null
labels are left out. Without labels nothing tells documents apart, and all are kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, small_or_not, trimmed

#: Buckets of features, all of which count: there is no least number of features (LEAST), thin ones are only smoothed.
BUCKETS, SMOOTH, LEAST, SEED = 1 << 18, 1.0, 0, 20240302
#: The k-th score is found by histograms of STEPS bins until at most EXACT rows are left in its bin.
STEPS, EXACT = 4096, 50_000


def _features(words, text: str | None) -> np.ndarray:
    from .shingles import mix

    h = words(text)
    if not len(h):
        return np.zeros(0, np.int64)
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    return (mix(np.concatenate([h, two])) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator) -> Iterator:
    import pyarrow as pa

    from .shingles import Words

    words = Words()
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            good = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            found = [_features(words, t) for t in part.column(0).to_pylist()]
            total[0] += np.bincount(np.concatenate(found), minlength=BUCKETS)
            if good.any():
                total[1] += np.bincount(np.concatenate([f for f, g in zip(found, good, strict=True) if g]), minlength=BUCKETS)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "target"])


def _weigh(ratio, id_type: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .shingles import Words

        words = Words()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [_features(words, t) for t in part.column(2).to_pylist()]
                weight = [float(ratio.value[f].sum()) for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(f) for f in found], pa.int64()), pa.array(weight, pa.float64())], names=["doc_id", "u", "n_features", "log_weight"])

    return run


def kth_largest(scores: DataFrame, k: int) -> float:
    """The k-th largest of column score (k from 1), from histograms; at most EXACT scores come to the driver, unless they tie."""
    lo, hi = scores.agg(F.min("score"), F.max("score")).first()
    left = k
    while lo < hi:
        width = (hi - lo) / STEPS
        slot = F.least(F.floor((F.col("score") - lo) / width), F.lit(STEPS - 1)).cast("long") if width > 0 else F.lit(0)
        inside = scores.where((F.col("score") >= lo) & (F.col("score") <= hi))
        counts = sorted(((r["s"], r["n"], r["a"], r["b"]) for r in inside.groupBy(slot.alias("s")).agg(F.count("*").alias("n"), F.min("score").alias("a"), F.max("score").alias("b")).collect()), reverse=True)
        for _, n, a, b in counts:
            if left <= n:
                lo, hi = a, b
                break
            left -= n
        if n <= EXACT and lo < hi:
            rest = scores.where((F.col("score") >= lo) & (F.col("score") <= hi)).select("score").collect()
            return sorted((r[0] for r in rest), reverse=True)[left - 1]
    return lo


def resample_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """doc_id, n_features, log_weight, score and kept of each document; share: kept documents of all, else from the labels."""
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(((F.min("quality") > 0) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("_good"))
    marks = keep(marks, "op7-labels")
    if share is None:
        share = marks.agg(F.avg(F.col("_good").cast("double"))).first()[0]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    good = small_or_not(marks.where("_good").select("_id"))
    marked = texts.join(good, F.col("doc_id") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("good"))
    counts = marked.mapInArrow(trimmed(_count), "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    ratio = np.zeros(BUCKETS)
    if target.any():
        share_of_target = target.sum() / raw.sum()
        ratio = np.log((target + SMOOTH) / (raw * share_of_target + SMOOTH))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    u = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.select("doc_id", u.alias("u"), "text").mapInArrow(trimmed(_weigh(shared, kind)), f"doc_id {kind}, u double, n_features bigint, log_weight double")
    scored = keep(rows.select("doc_id", "n_features", "log_weight", (F.col("log_weight") - F.log(-F.log("u"))).alias("score")), "op7-scores")
    n = scored.count()
    k = n if share is None else round(n * share)
    if k >= n or k <= 0:
        return scored.withColumn("kept", F.lit(k > 0))
    return scored.withColumn("kept", F.col("score") >= kth_largest(scored, k))
