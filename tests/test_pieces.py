"""Sources, sinks and small operators that no registered query reaches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import predicates as P
from weftline.operators import cluster as C
from weftline.operators import markov as M
from weftline.operators import optimize as O
from weftline.operators import passage as Q
from weftline.operators import reduce as R
from weftline.operators import trajectories as T
from weftline.sources import segments as S
from weftline.streaming import flux_stream


@pytest.fixture(scope="module")
def walk(spark):
    """Walkers on a line over 12 iterations, in two files."""
    rng = np.random.default_rng(5)
    rows = []
    for f in range(2):
        x = rng.uniform(0, 1, 6)
        for i in range(1, 13):
            y = np.clip(x + rng.normal(0.1, 0.15, 6), 0, 1.5)
            rows += [(f, i, s, 1 / 12, s if i > 1 else -1, 1, [float(x[s])], [float(y[s])], [float(x[s])] * 2, [float(y[s])] * 2) for s in range(6)]
            x = np.where(y > 1.2, 0.1, y)
    return spark.createDataFrame(rows, S.SEGMENTS)


def test_segments_there_and_back(spark, walk, tmp_path):
    S.write_segments(walk, str(tmp_path / "s"))
    back = S.read_segments(spark, str(tmp_path / "s"))
    assert sorted(map(str, back.collect())) == sorted(map(str, walk.collect()))
    nan = walk.withColumn("coord1", F.when(F.col("seg_id") == 0, F.array(F.lit(float("nan")))).otherwise(F.col("coord1")))
    masked = S.masked_pcoords(nan).collect()
    assert all(np.isnan(r["pcoord1"][0]) == (r["seg_id"] == 0) for r in masked)


def test_structures(spark, tmp_path):
    pdb = tmp_path / "a.pdb"
    pdb.write_text("REMARK x\nATOM      1  N   ASN A   1      -8.901   4.127  -0.555  1.00  0.00           N\nHETATM    2  O   HOH A   2       1.000   2.000   3.500  1.00  0.00           O\nTER\n")
    rows = S.read_pdb(spark, str(pdb)).collect()
    assert [(r["serial"], r["name"], r["res_name"], r["res_seq"], r["x"], r["y"], r["z"]) for r in rows] == [(1, "N", "ASN", 1, -8.901, 4.127, -0.555), (2, "O", "HOH", 2, 1.0, 2.0, 3.5)]
    assert [r["x"] for r in S.read_structure(spark, str(pdb)).orderBy("serial").collect()] == [[-8.901, 4.127, -0.555], [1.0, 2.0, 3.5]]
    dat = tmp_path / "a.dat"
    dat.write_text("# basis\n1.5 2\n\n-3 4e1\n")
    assert [(r["serial"], r["x"]) for r in S.read_structure(spark, str(dat)).orderBy("serial").collect()] == [(1, [1.5, 2.0]), (2, [-3.0, 40.0])]
    assert [r["x"] for r in S.read_structure(spark, {"coords": [[1, 2], [3, 4]]}).orderBy("serial").collect()] == [[1.0, 2.0], [3.0, 4.0]]


def test_text_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0.25), (0, 0.5), (1, 1e-9)], "state bigint, value double")
    S.write_values(rows, "state", "value", str(tmp_path / "pss"))
    assert [float(r[0]) for r in spark.read.text(str(tmp_path / "pss")).collect()] == [0.5, 1e-9, 0.25]
    S.write_states(spark.createDataFrame([(1, 0.5, "hdf:b"), (0, 0.25, "hdf:a")], "label bigint, weight double, ref string"), str(tmp_path / "start"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "start")).collect()) == ["0 0.25 hdf:a", "1 0.5 hdf:b"]


def test_clusters_and_mappers_there_and_back(spark, tmp_path):
    rows = [(b, [float(10 * b + k % 3)], 1.0) for b in range(3) for k in range(30)]
    points = spark.createDataFrame(rows, "bin bigint, x array<double>, weight double")
    centres = C.cluster_coordinates(points, 2, "stratified", 7)
    C.save_centres(centres, str(tmp_path / "c"))
    back = C.load_centres(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, centres.collect()))
    assert C.cluster_coordinates(points, 4, "aggregated", 7).count() == 4
    with pytest.raises(ValueError, match="no clustering"):
        C.cluster_coordinates(points, 2, "other")
    remap, mapper = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "bin bigint, bin_to bigint"), spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "state bigint, bin bigint")
    O.save_mapper(str(tmp_path / "m"), remap, centres, mapper)
    again = O.load_mapper(spark, str(tmp_path / "m"))
    assert [sorted(map(str, t.collect())) for t in again] == [sorted(map(str, t.collect())) for t in (remap, centres, mapper)]
    out = O.mapped_points(points, F.col("bin"), *again, 4, F.col("x")[0] < 0.5, F.col("x")[0] > 21.5).collect()
    assert {r["bin"] for r in out} <= {0, 1, 2, 3}
    assert all(r["bin"] == 2 for r in out if r["x"][0] < 0.5)
    assert all(r["bin"] == 3 for r in out if r["x"][0] > 21.5)
    assert len(out) == 90


def test_many_states_by_joins(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    t = M.random_markov_matrix(6, 4)
    edges, states = M.matrix_frame(spark, t), spark.range(6).withColumnRenamed("id", "state")
    pi = {r["state"]: r["value"] for r in M.power_iteration(edges, states, 40).collect()}
    assert [pi[i] for i in range(6)] == pytest.approx(M.steady_state(t).tolist(), abs=1e-9)
    ends = spark.createDataFrame([(0, 0.0), (5, 1.0)], "state bigint, value double")
    q = {r["state"]: r["value"] for r in M.fixed_point(edges, states, ends, 60).collect()}
    assert [q[i] for i in range(6)] == pytest.approx(M.committor(t, [0], [5]).tolist(), abs=1e-6)
    m = {r["state"]: r["value"] for r in M.fixed_point(edges, states, spark.createDataFrame([(5, 0.0)], "state bigint, value double"), 120, 1.0).collect()}
    assert [m[i] for i in range(6)] == pytest.approx(Q.mfpt_to(t, 5).tolist(), rel=1e-3)


def test_small_pieces(spark):
    rng = np.random.default_rng(1)
    assert {M.weighted_choice(["a", "b"], [0.0, 2.0], rng) for _ in range(20)} == {"b"}
    assert C.grid_centres([[0, 1, 3], [5, float("inf")]]) == [[0.5, 5.0], [2.0, 5.0]]
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [9.0])], "x array<double>, y array<double>")
    assert df.select(P.first_dims(F.col("x"), 2)).first()[0] == [1.0, 2.0]
    assert df.select(O.pcoord_map(F.col("x"), F.col("y"))).first()[0] == [1.0, 2.0, 3.0, 9.0]
    pairs = spark.createDataFrame([(rng.normal(size=3).tolist(), rng.normal(size=3).tolist()) for _ in range(50)], "x array<double>, y array<double>")
    found = R.batch_pca(pairs)
    both = np.array([r["x"] for r in pairs.collect()] + [r["y"] for r in pairs.collect()])
    assert found.spectrum == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(both.T, bias=True)))[::-1])
    features = R.featurized(pairs, "x", lambda x: x[:, :1] * 2).collect()
    assert all(r["features"] == [2 * r["x"][0]] for r in features)


def test_shapes(spark):
    rows = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0]), (1, 0, [5.0, 6.0])], "traj bigint, idx bigint, x array<double>")
    assert sorted(map(tuple, T.shape_of(rows).collect())) == [(0, 2, 2), (1, 1, 2)]
    with pytest.raises(ValueError, match="one or two dimensions"):
        T.shape_of(rows.withColumn("x", F.array("x")))


def test_model_from_raw_coordinates(spark, walk, tmp_path):
    """Featurised and reduced coordinates, model, and what it saves."""
    from weftline.plans.model import Config, build, prepared

    rows = prepared(S.complete(walk), "pca", lambda x: x * 3, {"dims": 1})
    rows = rows.withColumn("p0", F.col("pcoord0")[0]).withColumn("p1", F.col("pcoord1")[0])
    rows = rows.withColumn("bin0", P.uniform_bin(F.col("p0"), 0.0, 1.6, 4)).withColumn("bin", P.uniform_bin(F.col("p1"), 0.0, 1.6, 4))
    found = build(rows, Config((0.0, 0.15), (1.2, 9.0), per_bin=2, seed=3))
    assert found.pi.sum() == pytest.approx(1)
    assert found.pi @ found.t == pytest.approx(found.pi)
    assert found.q[-1] == 1
    found.save(spark, str(tmp_path / "model"))
    assert spark.read.parquet(str(tmp_path / "model/states")).count() == len(found.t)
    assert '"n_states"' in spark.read.text(str(tmp_path / "model/manifest")).first()[0]


def test_model_in_one_call(spark, walk):
    """The same model as step by step; bad segments are left out, the reduction may be fitted on the latest iterations."""
    from weftline.plans.model import Config, analyse, build, prepared

    config, bins = Config((0.0, 0.15), (1.2, 9.0), per_bin=2, seed=3), lambda p: P.uniform_bin(p, 0.0, 1.6, 4)
    bad = walk.limit(3).withColumn("coord1", F.array(F.lit(float("nan"))))
    got = analyse(walk.unionByName(bad), config, bins, "pca", lambda x: x * 3, {"dims": 1})
    rows = prepared(S.complete(walk), "pca", lambda x: x * 3, {"dims": 1})
    rows = rows.withColumn("p0", F.col("pcoord0")[0]).withColumn("p1", F.col("pcoord1")[0])
    want = build(rows.withColumn("bin0", bins(F.col("p0"))).withColumn("bin", bins(F.col("p1"))), config)
    assert got.pi == pytest.approx(want.pi) and got.flux == pytest.approx(want.flux) and got.centres == pytest.approx(want.centres)
    late = analyse(walk, config, bins, least=5)
    assert late.pi.sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        analyse(walk.limit(0), config, bins)


def test_windowed_edges(spark, tmp_path):
    src = str(tmp_path / "w")
    rows = spark.createDataFrame([(i % 2, 1, 0.5, f"2024-01-01 00:{i:02}:00") for i in range(40)], "from_state bigint, to_state bigint, weight double, t string").withColumn("t", F.to_timestamp("t"))
    rows.coalesce(1).write.parquet(src)
    stream = flux_stream.windowed_edges(spark.readStream.schema(rows.schema).parquet(src), "t", "10 minutes", "1 minute")
    q = stream.writeStream.outputMode("append").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("windowed").select(F.minute("window.start").alias("m"), "from_state", "w").collect()
    assert {r["w"] for r in got} == {2.5}
    assert {r["m"] for r in got} >= {0, 10, 20}
