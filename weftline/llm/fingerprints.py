"""Document fingerprints: canonical exact digest, wholly with DataFrame functions.

The canonical form of a text is its NFKC form, lower-cased, with runs of white space folded to one space and
trimmed. Its fingerprint is a 128-bit xxhash (two 64-bit hashes with different seeds, as hex). Rows that share a
hash are grouped and their canonical bytes compared; only if a group turns out to hold different bytes are its
fingerprints extended by the SHA-256 of the canonical form, so that equal fingerprints always mean equal forms.

Nulls count as empty texts. Null ids come first in the order, rows with equal ids are ordered by text; a repeated
row is its own neighbour. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hex64, keep, small_or_not

#: After NFKC only these are left of the white space.
SPACE = r"[\s\u0085\u1680\u2028\u2029]+"


def canonical(text: Column) -> Column:
    """NFKC, lower case, one space for each run of white space, trimmed; text must not be null."""
    form = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.trim(F.regexp_replace(F.lower(form), SPACE, " "))


def wide_hash(c: Column) -> tuple[Column, Column]:
    return F.xxhash64(c), F.xxhash64(F.lit("weftline"), c)


def _fixed(values: list, kind: str = "bigint") -> Column:
    """A list as one literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _slot(bounds: list[int], c: Column) -> Column:
    """How many of the sorted bounds are at most c, by binary search."""
    steps, s = [], 1
    while s <= len(bounds):
        steps.append(s)
        s *= 2
    if not steps:
        return F.lit(0)
    table = _fixed(bounds)
    fits = lambda at, s: (at + s <= F.lit(len(bounds))) & (F.get(table, at + s - 1) <= c)
    return F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), lambda at, s: F.when(fits(at, s), at + s).otherwise(at))


def with_next(rows: DataFrame, id_col: str, carry: list[str], text: str) -> DataFrame:
    """Adds next_<c> for each c of carry: the value in the row that follows by id, after the last that of the first.

    Rows are dealt to ranges of ids (bounds from one pass over the ids), each sorted on its own; the first row of a
    range also goes to the range before it, so that no range needs another one and no task sees the whole table.
    """
    spark = rows.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = _fixed([i / ranges for i in range(1, ranges)], "double")
    found = rows.select(F.percentile_approx(id_col, shares, 100 * ranges)).first()[0] or []
    slot = F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(_slot(sorted(set(found)), F.col(id_col)) + 1)
    rows = rows.withColumn("_slot", slot)
    firsts = {r[0]: r[1] for r in rows.groupBy("_slot").agg(F.min(id_col)).collect()}  # a row for each range
    order = sorted(firsts)
    if not order:
        return rows.select(*rows.columns, *[F.col(c).alias(f"next_{c}") for c in carry]).drop("_slot")
    top = order[-1] + 1
    prior = dict(zip(order, [order[-1], *order], strict=False))
    first = _fixed([firsts.get(i) for i in range(top)])
    before = _fixed([prior.get(i, 0) for i in range(top)], "int")
    opens = F.col(id_col).eqNullSafe(F.get(first, F.col("_slot")))
    here = F.struct(F.col("_slot").alias("s"), F.lit(0).alias("g"))
    also = F.struct(F.get(before, F.col("_slot")).alias("s"), F.lit(1).alias("g"))
    dealt = rows.withColumn("_at", F.explode(F.when(opens, F.array(here, also)).otherwise(F.array(here)))).drop("_slot")
    w = Window.partitionBy("_at.s").orderBy("_at.g", F.col(id_col).asc_nulls_first(), text)
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).where("_at.g = 0").drop("_at")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h1, h2 = wide_hash(canonical(F.col("text")))
    near = with_next(rows.select("*", h1.alias("h1"), h2.alias("h2")), "doc_id", ["doc_id", "text", "h1", "h2"], "text")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    e1, e2 = wide_hash(F.col("edited_form"))
    near = near.select("*", n.cast("long").alias("n_chars"), edited.alias("edited"))
    return near.withColumn("edited_form", canonical(F.col("edited"))).select("*", e1.alias("e1"), e2.alias("e2"))


def _entries(docs: DataFrame, slim: DataFrame, shared: DataFrame) -> DataFrame:
    """(h1, h2, form) of texts and edited texts whose hash others share: texts are read again, and only such are moved.

    An edited text needs the next row, so rows with a needed id or the id after it are read; among these the next one
    is the same as in the whole table.
    """
    h1, h2 = wide_hash(F.col("form"))
    own = docs.select(canonical(F.coalesce("text", F.lit(""))).alias("form")).select(h1.alias("h1"), h2.alias("h2"), "form")
    keys = shared.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"))
    need = slim.join(small_or_not(keys), ["e1", "e2"], "left_semi").select(F.explode(F.array("doc_id", "next_doc_id")).alias("_need")).distinct()
    need = small_or_not(keep(need, "op1-needed"))
    some = docs.join(need, F.col("doc_id").eqNullSafe(F.col("_need")), "left_semi")
    edited = _hashed(some, "doc_id", "text").select(F.col("e1").alias("h1"), F.col("e2").alias("h2"), F.col("edited_form").alias("form"))
    hits = small_or_not(shared)
    return own.join(hits, ["h1", "h2"], "left_semi").unionByName(edited.join(hits, ["h1", "h2"], "left_semi"))


def mixed_buckets(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Of the buckets in keys (h1, h2), those whose entries (h1, h2, form) hold more than one form, compared as bytes."""
    same = entries.join(small_or_not(keys), ["h1", "h2"], "left_semi")
    return same.groupBy("h1", "h2").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo <> hi").select("h1", "h2")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    An exact digest knows only equal and different: near_edited and near_next are 1.0 where the canonical forms are
    equal and 0.0 elsewhere.
    """
    full = _hashed(docs, id_col, text_col)
    slim = keep(full.select("doc_id", "next_doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "h1", "h2", "e1", "e2", "next_h1", "next_h2"), "op1")
    pairs = lambda a, b: F.struct(F.col(a).alias("h1"), F.col(b).alias("h2"))
    shared = slim.select(F.inline(F.array(pairs("h1", "h2"), pairs("e1", "e2")))).groupBy("h1", "h2").count().where("count > 1").drop("count")
    shared = keep(shared, "op1-shared")
    entries = _entries(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), slim, shared)
    mixed = keep(mixed_buckets(entries, shared), "op1-mixed")
    key = lambda a, b: F.concat(hex64(F.col(a)), hex64(F.col(b)))
    if mixed.isEmpty():
        named = slim.select("*", key("h1", "h2").alias("fingerprint"), key("e1", "e2").alias("edited_fingerprint"), key("next_h1", "next_h2").alias("next_fingerprint"))
    else:
        named = _extended(full, mixed, key)
    same = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))


def _extended(full: DataFrame, mixed: DataFrame, key) -> DataFrame:
    """Fingerprints where some buckets hold different bytes: those get the SHA-256 of the form appended."""
    out = full.withColumn("edited_sha256", F.sha2("edited", 256))
    for name, a, b, form in (("fingerprint", "h1", "h2", canonical(F.col("text"))), ("edited_fingerprint", "e1", "e2", F.col("edited_form")), ("next_fingerprint", "next_h1", "next_h2", canonical(F.col("next_text")))):
        hit = small_or_not(mixed.select(F.col("h1").alias("m1"), F.col("h2").alias("m2")))
        out = out.join(hit, (F.col(a) == F.col("m1")) & (F.col(b) == F.col("m2")), "left")
        out = out.withColumn(name, F.concat(key(a, b), F.when(F.col("m1").isNotNull(), F.sha2(form, 256)).otherwise(F.lit("")))).drop("m1", "m2")
    return out
