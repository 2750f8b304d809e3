"""Queries of the text operators against their SQL in DuckDB, over whole tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_against_sql(spark, subtests=None):
    duckdb = pytest.importorskip("duckdb")
    from weftline.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in SQL:
        got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns, name
        rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))  # noqa: E731, B023
        plain = lambda f: [r.replace("np.True_", "True").replace("np.False_", "False") for r in rows(f)]  # noqa: E731, B023
        assert plain(got) == plain(want), name
