"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from weftline.operators import trajectories as T
from weftline.streaming import flux_stream as S


def rows(spark):
    return spark.createDataFrame([(t, i, float((t * 31 + i * 17) % 100)) for t in range(6) for i in range(60)], "traj bigint, idx bigint, x double")


def drained(stream, mode, tmp_path, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, stream.sparkSession.table(name).collect()))


def test_passages(spark, tmp_path):
    src = str(tmp_path / "src")
    for k in range(3):
        rows(spark).where((F.col("idx") >= 20 * k) & (F.col("idx") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("traj bigint, idx bigint, x double").option("maxFilesPerTrigger", 1).parquet(src)
    got = drained(S.passages(stream, F.col("x") < 10, F.col("x") > 90), "append", tmp_path, "passed")
    want = T.passages(rows(spark), F.col("x") < 10, F.col("x") > 90).select("traj", "idx", "direction", "fpt")
    assert got == sorted(map(tuple, want.collect()))


def test_edges(spark, tmp_path):
    src = str(tmp_path / "edges")
    df = spark.createDataFrame([(i % 3, i % 4, 0.5) for i in range(40)], "from_state bigint, to_state bigint, weight double")
    df.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = drained(S.flux_edges(stream), "complete", tmp_path, "flux")
    assert got == sorted(map(tuple, df.groupBy("from_state", "to_state").agg(F.sum("weight")).collect()))


def test_model_state_batch_by_batch(spark, tmp_path):
    """Moments and flux kept by batches are those of one pass, of all iterations and of the later ones."""
    import numpy as np
    import pytest

    from weftline.operators import reduce as R
    from weftline.streaming import model_stream as M

    rng = np.random.default_rng(3)
    rows = [(k % 6, rng.normal(size=3).tolist(), rng.normal(size=3).tolist(), float(rng.random()), int(rng.integers(4)), int(rng.integers(4))) for k in range(120)]
    rows += [(None, [1.0] * 3, [1.0] * 3, 1.0, 0, 0), (2, None, [1.0] * 3, 1.0, 0, 0), (3, [1.0] * 3, [1.0] * 3, 1.0, None, 0)]
    schema = "n_iter int, x array<double>, y array<double>, weight double, from_state int, to_state int"
    df = spark.createDataFrame(rows, schema)
    for k in range(3):
        df.where(F.col("n_iter").isNull() & F.lit(k == 0) | (F.col("n_iter") % 3 == k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))

    def run(take, name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
        q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / f"{name}-mark")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run(M.keep_moments(str(tmp_path / "moments"), 3), "moments")
    run(M.keep_flux(str(tmp_path / "flux")), "flux")
    M.keep_flux(str(tmp_path / "flux"))(df.where("n_iter % 3 = 1"), 7)
    M.keep_flux(str(tmp_path / "flux"))(df.limit(0), 7)  # a batch that is repeated is replaced
    for first in (None, 3):
        part = df.where("n_iter is not null") if first is None else df.where(F.col("n_iter") >= first)
        got, want = M.moments_since(spark, str(tmp_path / "moments"), 3, first), R._sums(part)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
        assert R.tica_of(got).spectrum == pytest.approx(R.tica(part).spectrum)
        assert R.vamp_of(got).spectrum.shape == (3,) and R.pca_of(got, dims=2).directions.shape == (3, 2)
        n = 6 if first is None else 3
        flux = {(r.from_state, r.to_state): r.w for r in M.flux_since(spark, str(tmp_path / "flux"), first).collect()}
        sums = {(r[0], r[1]): r[2] / n for r in part.where("from_state is not null").groupBy("from_state", "to_state").agg(F.sum("weight")).collect()}
        assert flux == pytest.approx(sums)
    M.compacted(spark, str(tmp_path / "flux"), str(tmp_path / "flux1"))
    M.compacted(spark, str(tmp_path / "moments"), str(tmp_path / "moments1"), M.MOMENTS)
    assert M.moments_since(spark, str(tmp_path / "moments1"), 3, 3)["xy"] == pytest.approx(R._sums(df.where("n_iter >= 3"))["xy"])
    flux = {(r.from_state, r.to_state): r.w for r in M.flux_since(spark, str(tmp_path / "flux1"), 3).collect()}
    assert flux == pytest.approx(sums)
