"""Benchmark decontamination, wholly with DataFrame functions: windows of test words found in training texts.

A-Z become a-z; words are runs of digits, letters and characters beyond ASCII. A window is WIDTH consecutive words of
a benchmark item; an item of fewer words, but not none, is one window. The distinct windows are the broadcast hash set:
a 64-bit hash with the window's words. Texts are scanned once: each place of a text is hashed and looked up, and a hit
counts only if the words are the same. Should the set be larger than SET_BYTES, it is dealt by hash to blocks below that
size and the texts are scanned once for each block, so what is broadcast never grows with the input.

Defined results: null texts and texts without words are not hit, and null or empty items have no windows. A null
item_id counts as the empty string; rows that repeat an item_id are one item with the windows of all. A null or
repeated doc_id is kept: there is one row out for each row in. An empty benchmark hits nothing, an empty table of
documents gives an empty result. Other columns are ignored by audit_documents() and kept by decontaminate(), whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, small_or_not, unused

WIDTH = 10
#: Bytes of the broadcast set of one scan, its words and 64 bytes of overhead for each window.
SET_BYTES = 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NORMAL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text whose case is kept, or what stands between two.
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(NORMAL_WORD), 0)


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct windows (window, len, hash, gram), the forms that hold them (window, form), and the forms' items (form, item_id).

    Items with the same words are one form, so that copies of an item do not multiply its windows.
    """
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), normal_words(F.col(text_col)).alias("words"))
    items = items.where(F.size("words") > 0).select("item_id", "words", F.sha2(F.array_join("words", " "), 256).alias("form"))
    members = keep(items.select("form", "item_id").distinct(), "op12-members")
    rows = items.dropDuplicates(["form"]).select("form", "words", F.least(F.size("words"), F.lit(width)).alias("len"))
    rows = rows.select("form", "words", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("at"))
    part = F.slice("words", F.col("at"), F.col("len"))
    rows = rows.select("form", "len", F.xxhash64(part).alias("hash"), F.array_join(part, " ").alias("gram")).distinct()
    grams = keep(rows.select("len", "hash", "gram").distinct().withColumn("window", F.monotonically_increasing_id()), "op12-windows")
    forms = keep(rows.join(small_or_not(grams), ["len", "hash", "gram"]).select("window", "form"), "op12-forms")
    return grams, forms, members


def _lookup(rows: DataFrame, keys: list[str], grams: DataFrame, lens: list[int], opening: bool) -> DataFrame:
    """(keys, n_words, at, len, window): where windows stand in rows (keys, words), places from 1.

    With opening each row also gives a line at place 0, without a window, that carries its number of words.
    """
    at = F.explode(F.sequence(F.lit(0 if opening else 1), F.size("words")))
    rows = rows.where(F.size("words") > 0) if not opening else rows
    rows = rows.select(*keys, "words", at.alias("at"))
    rows = rows.select("*", F.lit(lens[0]).alias("len")) if len(lens) == 1 else rows.select("*", F.explode(F.when(F.col("at") == 0, F.array(F.lit(lens[0]))).otherwise(F.array(*[F.lit(x) for x in lens]))).alias("len"))
    rows = rows.where((F.col("at") == 0) | (F.col("at") + F.col("len") - 1 <= F.size("words")))
    part = F.slice("words", F.greatest(F.col("at"), F.lit(1)), F.col("len"))
    rows = rows.withColumn("hash", F.when(F.col("at") == 0, F.lit(0)).otherwise(F.xxhash64(part)))
    side = grams.select(F.col("hash").alias("_h"), F.col("len").alias("_n"), "gram", "window")
    if opening:
        side = side.unionByName(side.sparkSession.range(1).select(F.lit(0).cast("long").alias("_h"), F.lit(0).alias("_n"), F.lit("").alias("gram"), F.lit(-1).cast("long").alias("window")))
    same = ((F.col("at") == 0) & (F.col("_n") == 0)) | ((F.col("at") > 0) & (F.col("len") == F.col("_n")) & (F.array_join(part, " ") == F.col("gram")))
    out = rows.join(F.broadcast(side), (F.col("hash") == F.col("_h")) & same)
    return out.select(*keys, F.size("words").alias("n_words"), "at", "len", "window")


def _scanned(rows: DataFrame, keys: list[str], grams: DataFrame, set_bytes: int, opening: bool = True) -> DataFrame:
    """_lookup over the whole set, in as many scans as it has blocks of set_bytes, as a kept table."""
    lens = sorted(r[0] for r in grams.select("len").distinct().collect()) or [WIDTH]  # at most one for each width
    size = grams.agg(F.sum(F.octet_length("gram") + 64)).first()[0] or 0
    n = size // set_bytes + 1
    block = F.pmod(F.xxhash64("gram"), F.lit(n))
    parts = [keep(_lookup(rows, keys, grams.where(block == b) if n > 1 else grams, lens, opening and b == 0), "op12-hits") for b in range(n)]
    return reduce(DataFrame.unionByName, parts)


def _covered(hits: DataFrame, keys: list[str]) -> DataFrame:
    """hits with reach: the first place after all windows that begin earlier in the text."""
    before = Window.partitionBy(*keys).orderBy("at", F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    return hits.withColumn("reach", F.coalesce(F.max(F.col("at") + F.col("len")).over(before), F.lit(0)))


def audit_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, set_bytes: int = SET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document.

    n_hit counts the words inside any window's occurrence, n_items the items with a window in the text; items_sha256
    is of their ids as text, sorted by bytes and joined by commas.
    """
    grams, forms, members = benchmark_windows(benchmark, width)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), normal_words(F.col(text_col)).alias("words"))
    hits = _scanned(rows, ["row", "doc_id"], grams, set_bytes)
    fresh = F.when(F.col("at") > 0, F.greatest(F.lit(0), F.col("at") + F.col("len") - F.greatest(F.col("at"), F.col("reach")))).otherwise(0)
    opened = hits.withColumn("len", F.when(F.col("at") > 0, F.col("len")).otherwise(0))
    totals = _covered(opened, ["row"]).groupBy("row").agg(F.max_by("doc_id", F.col("at") == 0).alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.sum(fresh).alias("n_hit"))
    found = hits.where("at > 0").select("row", "window").distinct().join(small_or_not(forms), "window").select("row", "form").distinct()
    found = found.join(small_or_not(members), "form").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = totals.join(found, "row", "left")
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def hit_spans(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, set_bytes: int = SET_BYTES, text_col: str = "text") -> DataFrame:
    """(digest, n_words, spans): for the SHA-256 of each text that is hit its words' maximal runs of hits, as places from..to."""
    grams, _, _ = benchmark_windows(benchmark, width)
    rows = docs.select(F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("digest"), normal_words(F.col(text_col)).alias("words"))
    hits = _scanned(rows, ["digest"], grams, set_bytes, opening=False).drop("window").distinct()
    opens = (F.col("at") > F.col("reach")).cast("long")
    run = F.sum(opens).over(Window.partitionBy("digest").orderBy("at", F.desc("len")))
    runs = _covered(hits, ["digest"]).withColumn("run", run).groupBy("digest", "run").agg(F.max("n_words").alias("n_words"), F.min("at").alias("from"), F.max(F.col("at") + F.col("len") - 1).alias("to"))
    return runs.groupBy("digest").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))


def without_spans(text: Column, spans: Column) -> Column:
    """text without what stands from the first to the last letter of each span (from, to) of words; the rest is unchanged."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), 0)
    shift = F.when(text.rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 0).otherwise(1)
    after = lambda k: F.when(k == 0, F.lit(1)).otherwise(2 * F.get(spans, k - 1)["to"] - shift + 1)
    until = lambda k: F.when(k == F.size(spans), F.size(pieces)).otherwise(2 * F.get(spans, k)["from"] - shift - 1)
    kept = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: F.array_join(F.slice(pieces, after(k), F.greatest(F.lit(0), until(k) - after(k) + 1)), ""))
    return F.array_join(kept, "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = WIDTH, set_bytes: int = SET_BYTES, text_col: str = "text") -> DataFrame:
    """docs with all columns, without what the benchmark hits: its spans are cut ("spans") or its documents go ("documents").

    Texts are joined to their spans by digest, so repeated texts are settled together; only texts that are hit are changed.
    """
    if remove not in ("spans", "documents"):
        raise ValueError('remove must be "spans" or "documents"')
    digest, spans, other = unused(docs, "digest", "spans", "other_digest")
    found = keep(hit_spans(docs, benchmark, width, set_bytes, text_col), "op12-spans").select(F.col("digest").alias(other), F.col("spans").alias(spans))
    rows = docs.withColumn(digest, F.sha2(F.coalesce(text_col, F.lit("")), 256))
    if remove == "documents":
        return rows.join(small_or_not(found), F.col(digest) == F.col(other), "left_anti").select(*docs.columns)
    rows = rows.join(small_or_not(found, 20_000), F.col(digest) == F.col(other), "left")
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(without_spans(F.col(text_col), F.col(spans)))
    return rows.withColumn(text_col, text).select(*docs.columns)
