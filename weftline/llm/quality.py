"""Quality rules with risk-controlled thresholds.

Each rule is a statistic of a text that is high for junk, measured in steps of its own unit; a document's level is
the largest over the rules. Labelled documents choose the level from which documents are rejected, for each stratum
(language): cutoffs are tried from the most lenient one down, and a cutoff stands as long as the exact binomial
test shows, at DELTA / strata, that at most ALPHA of the stratum's good documents exceed it. Testing in this fixed
order needs no correction for the number of cutoffs, and the rules share one test; Bonferroni's bound corrects for
the strata. So with probability 1 - DELTA the rules together reject at most ALPHA of the good documents of every
stratum. Among the cutoffs that stand, the one that rejects most bad documents less PENALTY times the good ones (as
shares) is taken, the most lenient of equals; in a stratum without one (too few labels) no document is rejected by
the rules.

Texts: null counts as empty. Documents below the base limits fail without a look at the rules. Labels: repeated
ones count once, as do repeated rows of one id, a document with different labels counts as bad, null labels are left out. Null languages are a
stratum, and so is every other value, however many there are. Extra columns are ignored by the statistics and passed
on by filter_documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, small_or_not, trimmed

ALPHA, DELTA, PENALTY = 0.02, 0.05, 5.0
WINDOW = 8

#: Rule: its unit. Symbols a word, capitals among letters, exclamation marks a word, words in repeated windows, words
#: equal to the one before, repeated lines.
RULES = {"symbols": 0.01, "capitals": 0.005, "exclaims": 0.01, "repeats": 0.01, "same_word": 0.005, "dup_lines": 0.01}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def repeat_words(ids: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more; ids: a number for each word."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    key, span = ids.astype(np.int64), 1
    while span < WINDOW:  # the rank of each run of span words, doubled
        m = len(key) - span
        key = np.unique(key[:m] * (int(key.max()) + 1) + key[span : m + span], return_inverse=True)[1]
        span *= 2
    twice = np.bincount(key)[key] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple:
    """STATS, then the rules' statistics, of one text."""
    if not text:
        return (0, 0, 0, 0, 0) + (0.0,) * len(RULES)
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    word_chars = len(text) - chars
    symbols = len(text) - len(text.translate(_SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    first: dict[bytes, int] = {}
    ids = np.array([first.setdefault(w, len(first)) for w in words], np.int64)
    repeated = repeat_words(ids)
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    letters = max(1, sum(map(str.isalpha, text)))
    m = max(1, n)
    follow = int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0
    return (n, word_chars, symbols, dup, repeated, symbols / m, capitals / letters, text.count("!") / m, repeated / m, follow / m, dup / max(1, len(lines)))


def _stat_schema() -> list[T.StructField]:
    return [T.StructField(c, T.LongType()) for c in STATS] + [T.StructField(c, T.DoubleType()) for c in RULES]


def with_statistics(docs: DataFrame, text_col: str = "text", drop_text: bool = True) -> DataFrame:
    """docs with STATS and the rules' statistics; the text column only if asked for."""
    names = [c for c in docs.columns if not (drop_text and c == text_col)]
    docs = docs.select(text_col, *[c for c in docs.columns if c != text_col])
    stats = _stat_schema()
    schema = T.StructType([docs.schema[c] for c in names] + stats)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                got = list(zip(*[statistics(t) for t in part.column(0).to_pylist()], strict=True))
                cols = [part.column(part.schema.get_field_index(c)) for c in names]
                cols += [pa.array(v, pa.int64() if i < len(STATS) else pa.float64()) for i, v in enumerate(got)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return docs.mapInArrow(trimmed(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@lru_cache(4)
def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def at_most(k: int, n: int, p: float) -> float:
    """Probability of at most k of n under a share of p."""
    if n == 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    fact = _log_factorials(n)
    log = fact[n] - fact[i] - fact[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(np.exp(log).sum())


def choose_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> int | None:
    """The place of one stratum's cutoff among its levels, from counts of documents by level: those above it are rejected."""
    n, best, chosen = int(good.sum()), 0.0, None
    over = np.concatenate([np.cumsum(good[::-1])[::-1][1:], [0]])
    hits = np.concatenate([np.cumsum(bad[::-1])[::-1][1:], [0]])
    for c in range(len(good) - 2, -1, -1):
        if at_most(int(over[c]), n, alpha) > delta:
            break
        gain = hits[c] / max(1, bad.sum()) - PENALTY * over[c] / max(1, n)
        if gain > best:
            best, chosen = gain, c
    return chosen


def level() -> Column:
    """The largest of the rules' statistics in units, rounded up."""
    return F.greatest(*[F.ceil(F.col(r) / w) for r, w in RULES.items()]).cast("long")


def fit_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(_stratum, _cutoff): the cutoff level of each stratum that has one; _stratum may be null.

    Uses every labelled document that passes the base limits; rows that share an id are one trial, that of the highest
    level. A stratum's counts by level are one row, and its cutoff is chosen where that row is: the highest level that
    parts the labelled documents in the same way.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("_good"))
    rows = stats.where(~base_failed()).join(marks, F.col(id_col) == F.col("_id"))
    trials = rows.groupBy("_id").agg(F.max(F.struct(level().alias("level"), F.col(stratum).alias("_stratum"), (F.col("_good") > 0).cast("int").alias("good"))).alias("t")).select("t.*")
    counts = trials.groupBy("_stratum", "good", "level").agg(F.count("*").alias("n"))
    strata = keep(counts.groupBy("_stratum").agg(F.collect_list(F.struct("good", "level", "n")).alias("counts")), "op4-counts")
    share = delta / max(1, strata.count())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cutoffs = []
            for found in batch.column(1).to_pylist():
                levels = sorted({r["level"] for r in found} | {0})
                at = {v: i for i, v in enumerate(levels)}
                t = np.zeros((2, len(levels)), np.int64)
                for r in found:
                    t[r["good"], at[r["level"]]] += r["n"]
                c = choose_cutoff(t[1], t[0], alpha, share)
                cutoffs.append(None if c is None else levels[c + 1] - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cutoffs, pa.int64())], names=["_stratum", "_cutoff"])

    schema = T.StructType([T.StructField("_stratum", stats.schema[stratum].dataType), T.StructField("_cutoff", T.LongType())])
    return keep(strata.mapInArrow(trimmed(run), schema).where("_cutoff is not null"), "op4-cutoffs")


def with_cutoffs(rows: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """rows with the _cutoff of their stratum, null where it has none."""
    return rows.join(small_or_not(cutoffs), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")


def rejected() -> Column:
    """Whether the rules reject, as a column over the statistics and _cutoff."""
    return F.coalesce(level() > F.col("_cutoff"), F.lit(False))


def judge_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """STATS, base_failed and kept for each document."""
    stats = keep(with_statistics(docs.select(id_col, stratum, text_col), text_col), "op4-stats")
    rows = with_cutoffs(stats, fit_rules(stats, labels, id_col, stratum), stratum)
    return rows.select(id_col, *STATS, base_failed().alias("base_failed"), (~base_failed() & ~rejected()).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """The documents that judge_documents keeps, with all their columns; each text is read in place, never shuffled."""
    marked = docs.join(small_or_not(labels.select(id_col).distinct()), id_col, "left_semi").select(id_col, stratum, text_col)
    stats = keep(with_statistics(marked, text_col), "op4-labelled")
    cutoffs = fit_rules(stats, labels, id_col, stratum)
    clash = {c: f"_in_{c}" for c in docs.columns if c in {*STATS, *RULES, "_stratum", "_cutoff"}}
    read = docs.withColumnsRenamed(clash)
    rows = with_cutoffs(with_statistics(read, text_col, drop_text=False), cutoffs, clash.get(stratum, stratum)).where(~base_failed() & ~rejected())
    return rows.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])
