"""The jobs as registered queries: each is run twice over a whole table into one new folder, and its output read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import flux_ledger, word_walks
from jobs.common import settings
from weftline.session import new_folder


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes])


def job1_flux_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = settings("flux_ledger", input=f"{sf_dir}/events.parquet", output=new_folder(spark, "job1"))
    for _ in range(2):
        flux_ledger.run(spark, config)
    return _rounded(flux_ledger.ledger(spark, config)).withColumn("day", F.col("day").cast("string"))


def job2_word_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = settings("word_walks", input=f"{sf_dir}/documents.parquet", output=new_folder(spark, "job2"))
    for _ in range(2):
        word_walks.run(spark, config)
    return _rounded(word_walks.chain_table(spark, config))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_flux_ledger": job1_flux_ledger, "job2_word_walks": job2_word_walks}

_CLUSTER = "CASE {0} WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END"

SQL: dict[str, str] = {
    "job1_flux_ledger": f"""WITH e AS (SELECT ts::DATE AS day, row_number() OVER w AS k, value AS p1, lag(value) OVER w AS p0, {_CLUSTER.format("event_type")} AS c1, lag({_CLUSTER.format("event_type")}) OVER w AS c0 FROM events
WHERE ts IS NOT NULL AND ts::DATE < (SELECT max(ts::DATE) FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT day, CASE WHEN p0 > 0 AND p0 < 5 THEN 5 ELSE c0 END::BIGINT AS from_state, CASE WHEN p1 > 0 AND p1 < 5 THEN 5 WHEN p1 > 150 AND p1 < 1000 THEN 6 ELSE c1 END::BIGINT AS to_state,
1.0::DOUBLE / count(*) OVER (PARTITION BY day) AS weight FROM e WHERE k > 1),
d AS (SELECT day, from_state, to_state, sum(weight) AS w FROM s WHERE from_state IS NOT NULL AND to_state IS NOT NULL GROUP BY ALL),
t AS (SELECT *, sum(w) OVER (PARTITION BY from_state, to_state ORDER BY day) AS total, sum(w) OVER (PARTITION BY from_state ORDER BY day) AS left_it FROM d)
SELECT day::VARCHAR AS day, from_state, to_state, round(w, 6) + 0.0 AS w, round(total, 6) + 0.0 AS total, round(total / left_it, 6) + 0.0 AS p FROM t""",
    "job2_word_walks": r"""WITH d AS (SELECT coalesce(nullif(lang, ''), '(none)') AS lang, coalesce(nullif(source, ''), '(none)') AS source,
list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: (CASE WHEN length(w) >= 13 THEN 6 WHEN length(w) >= 9 THEN 5 WHEN length(w) >= 6 THEN 4 WHEN length(w) >= 4 THEN 3 WHEN length(w) >= 3 THEN 2 WHEN length(w) >= 2 THEN 1 ELSE 0 END)::BIGINT) AS s FROM documents),
x AS (SELECT lang, source, unnest(s[: len(s) - 1]) AS from_state, unnest(s[2 :]) AS to_state FROM d WHERE len(s) > 1),
n AS (SELECT lang, source, from_state, to_state, count(*) AS n FROM x GROUP BY ALL)
SELECT lang, source, from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY lang, source, from_state), 6) + 0.0 AS p,
round(sum(n) OVER (PARTITION BY lang, from_state, to_state) / sum(n) OVER (PARTITION BY lang, from_state), 6) + 0.0 AS p_lang FROM n""",
}
