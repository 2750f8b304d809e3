"""Source divergence audit: how far each source's words are from its language's, and sources from each other.

Terms are runs of letters and characters beyond ASCII, with A-Z lower-cased; null text, lang and source count as ''.
Each language keeps the V terms that stand in at least MIN_DOCS of its documents. A (lang, source) group, and the
language itself, gives each kept term p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), N being its sum of counts over
kept terms; two such values differ by f(p, q) = floor((p - q)^2 / (p + q)). All arithmetic is on whole numbers.

Pairs of sources come from postings (a kept term with the sources that have it): what a pair would sum to if no term
had a count is corrected by each source's terms, from a histogram of its counts, and by the terms that both have, from
the postings. So no term is visited for sources without it. Sums are taken before the shuffle; the result has a row for
each ordered pair of a language's sources by contract, which is also the size of the largest join here.

The search for a group's K most divergent terms puts its terms into buckets of like counts. f grows with p and falls
with q where p > q, so a bucket's largest p and its smallest p of the language bound f for all of its terms. Buckets are
evaluated best bound first, for all groups at once in rounds of growing size, and a group is closed when the bound of
its next bucket is strictly below its K-th value. Only terms of opened buckets are evaluated.

A null doc_id or extra columns do not matter, repeated rows count again, an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, small_or_not, trimmed

MIN_DOCS = 10
SCALE = 1_000_000_000
K = 10
#: Of the bytes of a text, A-Z become a-z, and what is neither a letter nor beyond ASCII becomes a space.
_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms of all groups that a task counts before it gives them out, and bytes of a text that it takes apart at once.
HELD, PIECE = 1 << 19, 1 << 20
#: Buckets opened for each group in the first round; each later round opens twice as many.
FIRST = 4
#: Buckets for each doubling of the count.
STEPS = 4


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in pieces of about PIECE bytes that no term crosses."""
    data, at = data.translate(_TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each group's terms over a task's texts, given out whenever HELD terms are in memory."""

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]
            same = lambda v: pa.array([v], pa.string()).take(pa.array([0] * len(terms)))  # noqa: B023, E731
            values = [same(lang), same(source), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(values, ["lang", "source", "term", "n", "docs"])
        held.clear()

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for text, lang, source in zip(batch["text"].cast(pa.binary()), batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen, before = set(), len(n)
            for terms in _words(text.as_py()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - before
            if size >= HELD:
                yield from out()
                size = 0
    yield from out()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; the term '' stands for the group itself."""
    named = {"text": text_col, "lang": lang_col, "source": source_col}
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in named.items()])
    rows = rows.mapInArrow(trimmed(_counted), "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 kept)); null where nothing is kept. Exact beyond 64 bits."""
    top = f"(cast({n} as decimal(20, 0)) + 2) * cast({SCALE} as decimal(10, 0))"
    return F.expr(f"case when {kept} > 0 then 1 + ({top} div (cast({total} as decimal(20, 0)) + 2 * cast({kept} as decimal(20, 0)))) end")


def difference(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are below 2^31, so that the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audited(docs: DataFrame, min_docs: int = MIN_DOCS, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): the kept terms of each group with its counts (lang, source, term, n, p, p0, q), and the groups (lang, source, kept, p0)."""
    counts = keep(term_counts(docs, **columns), "op11-counts")
    posting = F.collect_list(F.struct("source", "n"))  # at most one entry for each source
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), posting.alias("posting"))
    terms = keep(terms.where(F.col("docs") >= min_docs).select("lang", "term", "total", "posting"), "op11-terms")
    langs = terms.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("kept"))
    flat = terms.select("lang", "term", "total", F.inline("posting"))
    groups = counts.where("term = ''").select("lang", "source")
    groups = groups.join(flat.groupBy("lang", "source").agg(F.sum("n").alias("group_total")), ["lang", "source"], "left").join(small_or_not(langs), "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", F.coalesce("group_total", zero).alias("group_total"), F.coalesce("lang_total", zero).alias("lang_total"), F.coalesce("kept", zero).alias("kept"))
    groups = keep(groups.select("*", zero.alias("zero")).select("*", probability("zero", "group_total", "kept").alias("p0")).drop("zero"), "op11-groups")
    rows = flat.join(small_or_not(groups), ["lang", "source"])
    rows = rows.select("lang", "source", "term", "n", probability("n", "group_total", "kept").alias("p"), "p0", probability("total", "lang_total", "kept").alias("q"))
    return keep(rows, "op11-rows"), groups.select("lang", "source", "kept", "p0")


def source_pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed difference of each ordered pair of a language's sources."""
    other = small_or_not(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0")))
    level = groups.join(other, "lang").where("source <> item")
    level = level.select("lang", "source", "item", F.coalesce(F.col("kept") * difference("p0", "o0"), F.lit(0).cast("long")).alias("value"))
    # A source's own terms against sources without them.
    histogram = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    own = histogram.join(other, "lang").where("source <> item")
    own = own.select("lang", "source", "item", (F.col("terms") * (difference("p", "o0") - difference("p0", "o0"))).alias("value"))
    # Terms that both have: the true difference instead of what the two sources' own terms added.
    posting = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("posting"))
    both = posting.select("lang", "posting", F.inline("posting")).select("lang", "source", "p", "p0", F.inline("posting").alias("item", "o", "o0")).where("source < item")
    both = both.select("lang", "source", "item", (difference("p", "o") - difference("p", "o0") - difference("p0", "o") + difference("p0", "o0")).alias("value"))
    both = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    own = own.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    parts = level.unionByName(own).unionByName(turned(own)).unionByName(both).unionByName(turned(both))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(w))


def divergent_terms(rows: DataFrame, k: int = K) -> DataFrame:
    """(lang, source, item, value): each group's k terms of largest difference among those more frequent than in the language."""
    spark = rows.sparkSession
    rows = rows.withColumn("bucket", F.floor(F.log2("n") * STEPS).cast("int"))
    buckets = rows.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q")).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")
    queue = buckets.select("lang", "source", "bucket", difference("p", "q").alias("bound")).withColumn("place", F.row_number().over(order))
    queue = keep(queue, "op11-queue")  # some hundred rows for each group at most
    best = spark.createDataFrame([], "lang string, source string, item string, value long")
    done, width = 0, FIRST
    while True:
        kth = best.groupBy("lang", "source").agg(F.min("value").alias("kth"), F.count("*").alias("found")).where(F.col("found") >= k).drop("found")
        closed = queue.where(F.col("place") == done + 1).join(small_or_not(kth), ["lang", "source"]).where("bound < kth").select("lang", "source")
        taken = queue.where(F.col("place").between(done + 1, done + width)).join(small_or_not(closed), ["lang", "source"], "left_anti").select("lang", "source", "bucket")
        taken = keep(taken, "op11-taken")
        if taken.isEmpty():
            return best
        seen = rows.join(small_or_not(taken), ["lang", "source", "bucket"], "left_semi").where("p > q")
        seen = seen.select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value"))
        best = keep(_ranked(best.unionByName(seen)).where(F.col("rank") <= k).drop("rank"), "op11-best")
        done, width = done + width, 2 * width


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = K, **columns: str) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank: all pairs of sources and the k most divergent terms of each group.

    Ranks count from 1 by falling value, then by the bytes of item.
    """
    rows, groups = audited(docs, min_docs, **columns)
    out = lambda df, part: _ranked(df).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(source_pairs(rows, groups), "pair").unionByName(out(divergent_terms(rows, k), "term"))
