"""The jobs by two runs over growing copies of their tables, repeated runs, runs broken off in the middle, and their SQL."""

import json
import os
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import flux_ledger, queries, word_walks
from jobs.common import settings

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
real = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    return sorted(map(repr, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())))


# ---- flux ledger -------------------------------------------------------------------------------------------------

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark, days):
    kinds = ["click", "error", "purchase", "signup", "view", "other", None]
    out = []
    for d in days:
        for i in range(40):
            k = 40 * d + i
            user = None if k % 17 == 0 else 1 if k % 3 else k % 5
            value = None if k % 13 == 0 else float((k * 37) % 220)
            out.append((k, datetime(2024, 3, 1) + timedelta(days=d, minutes=30 * (i // 2)), user, kinds[(k * k + d) % 7], value, "{}"))
    return spark.createDataFrame(out, EVENTS)


def ledger_by_hand(data, clusters, basis, target):
    last = max(r.ts for r in data).date()
    walkers, days = {}, {}
    for r in sorted(data, key=lambda r: (r.ts, r.event_id)):
        if r.ts.date() == last:
            continue
        if (p := walkers.get(r.user_id)) is not None:
            number = lambda c: clusters.index(c) if c in clusters else None
            inside = lambda v, b: v is not None and b[0] < v < b[1]
            a = len(clusters) if inside(p.value, basis) else number(p.event_type)
            z = len(clusters) if inside(r.value, basis) else len(clusters) + 1 if inside(r.value, target) else number(r.event_type)
            days.setdefault(r.ts.date(), []).append((a, z))
        walkers[r.user_id] = r
    total, left, out = {}, {}, []
    for day in sorted(days):
        w = {}
        for a, z in days[day]:
            if a is not None and z is not None:
                w[a, z] = w.get((a, z), 0) + 1 / len(days[day])
        for (a, z), x in w.items():
            total[a, z] = total.get((a, z), 0) + x
            left[a] = left.get(a, 0) + x
        out += [(day, a, z, x, total[a, z], total[a, z] / left[a]) for (a, z), x in w.items()]
    return sorted(map(repr, (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in out)))


@pytest.fixture
def ledger_job(spark, tmp_path):
    return settings("flux_ledger", input=str(tmp_path / "events"), output=str(tmp_path / "out"))


def test_ledger_grows_with_its_input(spark, ledger_job):
    c = ledger_job
    put = lambda days: events(spark, days).write.mode("append").parquet(c["input"])
    by_hand = lambda: ledger_by_hand(spark.read.parquet(c["input"]).collect(), c["clusters"], c["basis"], c["target"])
    put(range(3))
    first = flux_ledger.run(spark, c)
    assert first["read"] == 80 and str(first["mark"]) == "2024-03-02"
    assert rows(flux_ledger.ledger(spark, c)) == by_hand()
    put(range(3, 6))
    second = flux_ledger.run(spark, c)
    assert second["read"] == 120 and second["written"] > 0  # the day that was open, and two new ones
    assert rows(flux_ledger.ledger(spark, c)) == by_hand()
    third = flux_ledger.run(spark, c)
    assert third["read"] == third["written"] == 0
    assert rows(flux_ledger.ledger(spark, c)) == by_hand()


def test_ledger_survives_a_broken_run(spark, ledger_job):
    c = ledger_job
    events(spark, range(3)).write.parquet(c["input"])
    flux_ledger.run(spark, c)
    marks = spark.read.parquet(f"{c['output']}/marks").collect()
    events(spark, range(3, 5)).write.mode("append").parquet(c["input"])
    flux_ledger.run(spark, c)
    whole = rows(flux_ledger.ledger(spark, c))
    # All but the mark was written, then more came.
    spark.createDataFrame(marks, "upto date").write.mode("overwrite").parquet(f"{c['output']}/marks")
    flux_ledger.run(spark, c)
    assert rows(flux_ledger.ledger(spark, c)) == whole
    spark.createDataFrame(marks, "upto date").write.mode("overwrite").parquet(f"{c['output']}/marks")
    events(spark, range(5, 7)).write.mode("append").parquet(c["input"])
    flux_ledger.run(spark, c)
    assert rows(flux_ledger.ledger(spark, c)) == ledger_by_hand(spark.read.parquet(c["input"]).collect(), c["clusters"], c["basis"], c["target"])


def test_ledger_of_nothing(spark, ledger_job):
    events(spark, range(1)).write.parquet(ledger_job["input"])  # one day, still open
    assert flux_ledger.run(spark, ledger_job) == {"mark": None, "read": 0, "written": 0}
    empty = ledger_job | {"input": ledger_job["input"] + "0"}
    events(spark, range(1)).limit(0).write.parquet(empty["input"])
    assert flux_ledger.run(spark, empty)["read"] == 0


def test_ledger_reads_only_new_days(spark, ledger_job):
    c = ledger_job
    events(spark, range(4)).write.parquet(c["input"])
    flux_ledger.run(spark, c)
    # Days up to the mark are gone from the input: what is new needs none of them.
    late = c | {"input": c["input"] + "-late"}
    events(spark, range(3, 6)).write.parquet(late["input"])
    flux_ledger.run(spark, late)
    assert rows(flux_ledger.ledger(spark, c)) == ledger_by_hand(events(spark, range(6)).collect(), c["clusters"], c["basis"], c["target"])


# ---- word walks --------------------------------------------------------------------------------------------------


def texts(spark, ids):
    made = lambda i: None if i % 11 == 0 else " ".join("x" * (1 + (i * k * k + k) % 17) for k in range(i % 7 * 9)) + ("\né\U0001f600 " if i % 2 else "")
    return spark.createDataFrame([(i, made(i), [None, "", "en", "de"][i % 4], [None, "", "a", "b", "c"][i % 5], i) for i in ids], word_walks.DOCUMENTS + ", n_chars int")


def chains_by_hand(data, edges, lag):
    n, pooled = {}, {}
    for r in data:
        s = [max([k for k, e in enumerate(edges) if k == 0 or len(w) >= e]) if len(w) < edges[-1] else len(edges) - 1 for w in __import__("re").findall(word_walks.WORD, r.text or "")]
        for a, z in zip(s, s[lag:], strict=False):
            key = (r.lang or "(none)", r.source or "(none)", a, z)
            n[key] = n.get(key, 0) + 1
            pooled[key[0], a, z] = pooled.get((key[0], a, z), 0) + 1
    row = lambda d, f: sum(v for k, v in d.items() if f(k))
    out = []
    for (lang, source, a, z), c in n.items():
        p = c / row(n, lambda k: k[:3] == (lang, source, a))  # noqa: B023
        q = pooled[lang, a, z] / row(pooled, lambda k: k[:2] == (lang, a))  # noqa: B023
        out.append((lang, source, a, z, c, round(p, 9), round(q, 9)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("lag", [1, 3])
def test_walks_grow_with_their_input(spark, tmp_path, lag):
    c = settings("word_walks", input=str(tmp_path / "docs"), output=str(tmp_path / "out"), lag=lag, files=2)
    put = lambda ids: texts(spark, ids).repartition(3).write.mode("append").parquet(c["input"])
    by_hand = lambda: chains_by_hand(spark.read.parquet(c["input"]).collect(), c["edges"], lag)
    put(range(60))
    assert word_walks.run(spark, c)["read"] == 60
    assert rows(word_walks.chain_table(spark, c)) == by_hand()
    put(range(60, 100))
    assert word_walks.run(spark, c)["read"] == 40
    assert rows(word_walks.chain_table(spark, c)) == by_hand()
    again = word_walks.run(spark, c)
    assert again["batches"] == again["read"] == 0 and again["written"] == len(by_hand())
    assert rows(word_walks.chain_table(spark, c)) == by_hand()


def test_walks_survive_a_broken_run(spark, tmp_path, monkeypatch):
    c = settings("word_walks", input=str(tmp_path / "docs"), output=str(tmp_path / "out"), files=1)
    texts(spark, range(50)).repartition(3).write.parquet(c["input"])
    real_chains, calls = word_walks.transitions, []

    def broken(batch, edges, lag):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return real_chains(batch, edges, lag)

    monkeypatch.setattr(word_walks, "transitions", broken)
    with pytest.raises(Exception):  # noqa: B017
        word_walks.run(spark, c)
    word_walks.run(spark, c)
    assert rows(word_walks.chain_table(spark, c)) == chains_by_hand(spark.read.parquet(c["input"]).collect(), c["edges"], 1)


def test_walks_broken_off_before_the_chains(spark, tmp_path, monkeypatch):
    """All batches are in, the chains are not: the next run, which finds no new file, makes them."""
    c = settings("word_walks", input=str(tmp_path / "docs"), output=str(tmp_path / "out"))
    texts(spark, range(30)).write.parquet(c["input"])
    with monkeypatch.context() as m:
        m.setattr(word_walks, "chains", lambda counts: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            word_walks.run(spark, c)
    word_walks.run(spark, c)
    assert rows(word_walks.chain_table(spark, c)) == chains_by_hand(spark.read.parquet(c["input"]).collect(), c["edges"], 1)


def test_walks_of_nothing(spark, tmp_path):
    c = settings("word_walks", input=str(tmp_path / "docs"), output=str(tmp_path / "out"))
    texts(spark, range(3)).limit(0).write.parquet(c["input"])
    assert word_walks.run(spark, c)["read"] == 0


# ---- both --------------------------------------------------------------------------------------------------------


@real
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")) == before
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got)
    text = lambda f: sorted(tuple(repr(float(v)) if not isinstance(v, str) else v for c, v in zip(columns, r, strict=True)) for r in f[columns].itertuples(index=False, name=None))
    assert text(got) == text(want)


@real
@pytest.mark.parametrize(("job", "table"), [("flux_ledger", "events"), ("word_walks", "documents")])
def test_command_line(tmp_path, job, table):
    config = tmp_path / "config.json"
    config.write_text(json.dumps(settings(job)))
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--config", str(config), "--input", f"{SF}/{table}.parquet", "--output", str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": str(ROOT), "SPARK_LOCAL_IP": "127.0.0.1"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"weftline.jobs.{job} read" in done.stderr


def test_jobs_need_no_text_operators():
    for p in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        lines = [x for x in p.read_text().splitlines() if x.lstrip().startswith(("import ", "from "))]
        assert not [x for x in lines if "llm" in x or "corpus_pipeline" in x], p
