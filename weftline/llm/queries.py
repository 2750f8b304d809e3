"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_documents

    return fingerprint_documents(_read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_pages

    return extract_pages(_read(spark, sf_dir, "pages"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge_documents

    return judge_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_substrings

    return repeated_substrings(_read(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_documents

    return score_documents(_read(spark, sf_dir, "documents"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample_documents

    return resample_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op9_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit_sources

    return audit_sources(_read(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import audit_documents

    return audit_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


# ---- columns that SQL can express, of operators that decide more than that ---------------------------------------


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op1: the length of each text and the digest of its edited text."""
    return op1_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3: sizes and targets."""
    return op3_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4: the statistics and the base limits."""
    from .quality import STATS, base_failed, with_statistics

    rows = with_statistics(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *STATS, base_failed().alias("base_failed"))


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6: all but the model's score."""
    return op6_lm_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_html_extraction": op2_html_extraction,
    "op3_mix_sources": op3_mix_sources,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_lm_scores": op6_lm_scores,
    "op7_importance_resampling": op7_importance_resampling,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_warc_reassembly": op9_warc_reassembly,
    "op10_bpe": op10_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_decontamination": op12_decontamination,
    "edited_texts": edited_texts,
    "mix_targets": mix_targets,
    "text_statistics": text_statistics,
    "base_scores": base_scores,
}

#: A-Z to lower case, words, and the CRC-32 of an id as text, bit by bit.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: coalesce(nullif(c, '').ord(), 0)::BIGINT), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295::BIGINT)"

SQL: dict[str, str] = {
    "op9_warc_reassembly": """WITH d AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM d),
f AS (SELECT digest, min(page_id) AS first FROM h WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, h.digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM h LEFT JOIN f ON f.digest = h.digest""",
    "op5_substring_dedup": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT r, i, md5(array_slice(b, i, i + 399)) AS h FROM (SELECT r, b, unnest(range(1, n - 398)) AS i FROM d WHERE n >= 400)),
t AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
q AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS j FROM p WHERE h IN (FROM t)),
u AS (SELECT r, i, sum(CASE WHEN j IS NULL OR i > j + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM q),
v AS (SELECT r, k, min(i) AS a, max(i) + 400 AS z FROM u GROUP BY ALL),
x AS (SELECT r, coalesce(lag(z) OVER w, 1) AS a, a - 1 AS z FROM v WINDOW w AS (PARTITION BY r ORDER BY k) UNION ALL SELECT v.r, max(z), any_value(n) FROM v JOIN d ON d.r = v.r GROUP BY v.r),
y AS (SELECT x.r, sha256(unhex(string_agg(CASE WHEN x.z >= x.a THEN hex(array_slice(b, x.a, x.z)) ELSE '' END, '' ORDER BY x.a))) AS kept FROM x JOIN d ON d.r = x.r GROUP BY x.r),
z AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM v GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept, sha256(b)) AS kept_sha256 FROM d LEFT JOIN y ON y.r = d.r LEFT JOIN z ON z.r = d.r""",
    "op8_minhash_near_dedup": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOW)} AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
m AS (SELECT a.r AS a, b.r AS b, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM m JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r AS s, r AS t FROM d UNION SELECT s, b FROM c JOIN e ON a = t),
k AS (SELECT s, min(doc_id) AS component_id FROM c JOIN d ON r = t GROUP BY s)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN k ON s = d.r LEFT JOIN n ON n.r = d.r""",
    "op11_source_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*)::HUGEINT AS n FROM k GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM k SEMI JOIN v USING (lang, term) GROUP BY ALL),
m AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT m.lang, m.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (m.n + 2 * l.v) AS p, 1 + (1000000000 * (v.n + 2)) // (l.n + 2 * l.v) AS q
FROM m JOIN v ON v.lang = m.lang JOIN l ON l.lang = m.lang LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = v.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM x QUALIFY part = 'pair' OR rank <= 10""",
    "op12_decontamination": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT r, i, n, item FROM p JOIN g USING (n, g)),
x AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN x ON x.r = d.r LEFT JOIN t ON t.r = d.r""",
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS u FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(t) AS n_chars, sha256(substring(t, 1, length(t) - length(t) // 4) || substring(u, 1, length(t) // 4)) AS edited_sha256 FROM n""",
    "mix_targets": rf"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [1, 5, 2][k % 3 + 1] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY n / weight, k) AS place FROM w),
l AS (SELECT *, ((SELECT sum(n) FROM o) - coalesce(sum(3.0::DOUBLE * n) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM o),
r AS (SELECT rate FROM l WHERE 3.0::DOUBLE * n >= weight * rate ORDER BY place LIMIT 1),
t AS (SELECT source, n, round(least(3.0::DOUBLE * n, weight * coalesce((FROM r), 'inf'::DOUBLE)), 4) + 0.0 AS target FROM o)
SELECT doc_id, size, n AS source_size, target FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source""",
    "text_statistics": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
q AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
c AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS x FROM q) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
len(w) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN l ON l.r = d.r""",
    "base_scores": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC} % 10 = 0 AS held_out, {_WORDS.format(_LOW)} || [''] AS w FROM documents),
k AS (SELECT r, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM k WHERE NOT held_out GROUP BY w),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))) AS score FROM k LEFT JOIN c ON c.w = k.w, n GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(score, 4) + 0.0 AS base_score FROM d JOIN s ON s.r = d.r, n""",
}
