"""History-augmented Markov models end to end, in one configuration and one call.

build() reduces and clusters segments within bins, assigns both ends, sums flux, keeps the strongly connected states,
assigns and sums again, sorts states by coordinate and solves for steady state, flux, committors, profile and bins.
Segment rows stay in Spark; what comes to the driver is states by states. Validation groups share the model's
clusters and are summed in one grouped plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.predicates import box_centre, has_nan, in_box
from weftline.operators import cluster as C
from weftline.operators import flux as X
from weftline.operators import markov as M
from weftline.operators import optimize as O
from weftline.operators import reduce as R
from weftline.session import kept
from weftline.sources import segments as S


class BlockValidationError(RuntimeError):
    """A validation group could not be built."""


@dataclass(frozen=True)
class Config:
    """Bounds of basis and target, clusters for each bin and the seed; tau is the time of one iteration."""

    basis: tuple[float, float]
    target: tuple[float, float]
    per_bin: int = 25
    seed: int = 0
    tau: float = 1.0
    groups: int = 0
    blocks: int = 0


@dataclass
class Model:
    """What build() finds; states in sorted order, the basis and the target last."""

    config: Config
    state_map: DataFrame
    edges: DataFrame
    t: np.ndarray
    pi: np.ndarray
    flux: float
    q: np.ndarray
    q_minus: np.ndarray
    centres: np.ndarray
    profile: np.ndarray
    groups: dict[int, float] = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(c), float(p), float(q), float(j)) for i, (c, p, q, j) in enumerate(zip(self.centres, self.pi, self.q, self.profile, strict=True))]
        return spark.createDataFrame(rows, "state bigint, centre double, pi double, q double, flux double")

    def optimized_bins(self, n_bins: int, strategy=O.clustered_bins) -> np.ndarray:
        """Bins for all states but basis and target."""
        h, v = O.discrepancy(self.t, self.pi, len(self.t) - 1)
        return strategy(h[:-2], v[:-2], self.pi[:-2], n_bins)

    def save(self, spark: SparkSession, path: str) -> None:
        """The model as Parquet tables and a manifest in JSON; nothing is pickled."""
        self.table(spark).write.mode("overwrite").parquet(f"{path}/states")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        self.state_map.write.mode("overwrite").parquet(f"{path}/state_map")
        manifest = json.dumps({"flux": self.flux, "n_states": len(self.t), "tau": self.config.tau, "groups": self.groups})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _featured(segments: DataFrame, featurize) -> DataFrame:
    out = segments
    for end in ("0", "1"):
        if featurize is None:
            out = out.withColumn(f"_f{end}", F.col(f"coord{end}").cast("array<double>"))
        else:
            out = R.featurized(out, f"coord{end}", featurize, f"_f{end}")
    return out


def reduction_of(segments: DataFrame, method: str = "pca", featurize=None, options: dict | None = None) -> R.Reduction:
    """The reduction of segments (coord0, coord1, weight); see prepared()."""
    pairs = _featured(segments, featurize).select(F.col("_f0").alias("x"), F.col("_f1").alias("y"), F.col("weight").cast("double").alias("weight"))
    return R.reduction(method, pairs, **(options or {}))


def _reduced(segments: DataFrame, found: R.Reduction, featurize) -> DataFrame:
    out = _featured(segments, featurize)
    return out.withColumn("x0", found.column(F.col("_f0"))).withColumn("x1", found.column(F.col("_f1"))).drop("_f0", "_f1")


def prepared(segments: DataFrame, method: str = "pca", featurize=None, options: dict | None = None) -> DataFrame:
    """segments (coord0, coord1, ...) with reduced coordinates x0 and x1, for build().

    featurize: a user's function, an array of coordinates in and a 2-D array of features out; without one the
    coordinates are the features. options are those of the reduction. Both ends go through the same reduction.
    """
    return _reduced(segments, reduction_of(segments, method, featurize, options), featurize)


def analyse(raw: DataFrame, config: Config, bins: Callable[[Column], Column], method: str = "pca", featurize=None, options: dict | None = None, least: int | None = None) -> Model:
    """A model from raw segments (SEGMENTS of sources.segments) in one call.

    Each file's last iteration, which may be unfinished, is left out, as are segments with NaN or missing coordinates.
    bins maps the first progress coordinate to a whole number, the bin. The reduction (method, featurize, options, as in
    prepared()) is fitted on the latest iterations that give every bin at least least segments, or on all without least,
    and applied to all. What follows is build().
    """
    rows = S.complete(raw).where(~has_nan(F.col("coord0")) & ~has_nan(F.col("coord1")))
    rows = rows.withColumn("p0", F.col("pcoord0")[0]).withColumn("p1", F.col("pcoord1")[0])
    rows = rows.withColumn("bin0", bins(F.col("p0"))).withColumn("bin", bins(F.col("p1"))).where("bin0 is not null and bin is not null")
    rows = kept(rows.select("n_iter", "weight", "p0", "p1", "bin0", "bin", "coord0", "coord1"), "segments")
    if rows.isEmpty():
        raise ValueError("no complete iteration has segments with coordinates")
    fitted = rows if least is None else S.fill_bins(rows, least)
    return build(_reduced(rows, reduction_of(fitted, method, featurize, options), featurize), config)


def _assigned(segments: DataFrame, centres: DataFrame, n: int, config: Config) -> DataFrame:
    """Segments with from_cluster and to_cluster, both ends assigned in one pass each, then states."""
    start = C.assigned(segments.withColumn("bin_end", F.col("bin")).withColumn("bin", F.col("bin0")).withColumn("x", F.col("x0")), centres).withColumnRenamed("state", "from_cluster")
    both = C.assigned(start.withColumn("bin", F.col("bin_end")).drop("bin_end").withColumn("x", F.col("x1")), centres).withColumnRenamed("state", "to_cluster")
    return X.with_states(both, n, config.basis, config.target).select("n_iter", "p0", "p1", "weight", "from_state", "to_state").where("from_state is not null and to_state is not null")


def _remapped(segments: DataFrame, bins: DataFrame) -> DataFrame:
    to = F.broadcast(bins)
    out = segments.join(to.withColumnsRenamed({"bin": "_b", "bin_to": "_t"}), F.col("bin") == F.col("_b")).withColumn("bin", F.col("_t")).drop("_b", "_t")
    return out.join(to.withColumnsRenamed({"bin": "_b", "bin_to": "_t"}), F.col("bin0") == F.col("_b")).withColumn("bin0", F.col("_t")).drop("_b", "_t")


def build(segments: DataFrame, config: Config) -> Model:
    """A model from segments (n_iter, p0, p1, x0, x1, bin0, bin, weight): bin0 and bin are the bins of start and end."""
    spark = segments.sparkSession
    segments = kept(segments.select("n_iter", "p0", "p1", "x0", "x1", "bin0", "bin", "weight"), "segments")  # read some ten times
    inside = in_box([F.col("p1")], config.basis) | in_box([F.col("p1")], config.target)
    points = segments.where(~inside).select("bin", F.col("x1").alias("x"), "weight")
    seen = segments.select("bin").union(segments.select("bin0")).distinct()
    counts = seen.join(C.bin_counts(points, config.per_bin), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("filled", F.lit(False)).alias("filled"))
    mean = segments.groupBy("bin").agg(F.avg("p1").alias("m")).union(segments.groupBy(F.col("bin0").alias("bin")).agg(F.avg("p0").alias("m"))).groupBy("bin").agg(F.array(F.avg("m")).alias("x"))
    bins = spark.createDataFrame(C.thin_bins(counts, mean).collect(), "bin bigint, bin_to bigint")  # a row for each bin
    moved = _remapped(segments, bins)
    centres = C.numbered(C.stratified_centres(moved.where(~inside).select("bin", F.col("x1").alias("x"), "weight"), config.per_bin, config.seed))
    centres = spark.createDataFrame(centres.collect(), centres.schema)  # per_bin rows for each bin
    n = centres.count()
    last = segments.agg(F.max("n_iter")).first()[0]
    used = moved.where((F.col("n_iter") >= 2) & (F.col("n_iter") < last))
    n_iters = max(1, last - 2)
    first = X.flux_matrix(_assigned(used, centres, n, config), n_iters)
    stay, _ = C.strongly_connected(first, n + 2, (n, n + 1))
    staying = C.cleaned_centres(centres, stay).collect()
    kept_bins = {r["bin"] for r in staying}
    bin_means = {r["bin"]: r["x"][0] for r in mean.collect()}
    nearest = {b: min(kept_bins, key=lambda k: (abs(bin_means[k] - bin_means[b]), k)) for b in {r["bin"] for r in centres.collect()}}
    again = spark.createDataFrame([(b, k) for b, k in nearest.items()], "bin bigint, bin_to bigint")
    staying = sorted(staying, key=lambda r: r["state"])
    m = len(staying)
    new = spark.createDataFrame([(r["bin"], r["local_id"], i, r["x"]) for i, r in enumerate(staying)], centres.schema)
    rows = kept(_assigned(_remapped(used, again), new, m, config), "assigned")
    found = X.centre_stats(rows, spark.range(m + 2).withColumnRenamed("id", "state")).collect()
    centre = {r["state"]: r["centre"] for r in found}
    order = sorted(range(m), key=lambda s: (centre[s] is None, centre[s] or 0.0, s))
    place = {s: i for i, s in enumerate(order)} | {m: m, m + 1: m + 1}
    places = spark.createDataFrame(list(place.items()), "state bigint, place bigint")
    edges = X.relabelled(X.total_one(X.flux_matrix(rows, n_iters)), places)
    w = M.dense(edges, m + 2, "w")
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "from_state bigint, to_state bigint, w double")
    model = _solved(w, m, config)
    raw = {i: r["state"] for i, r in enumerate(staying)}
    smap = spark.createDataFrame([(raw[s], staying[s]["bin"], staying[s]["local_id"], "cluster", place[s]) for s in range(m)] + [(None, None, None, "basis", m), (None, None, None, "target", m + 1)], "raw_state bigint, bin bigint, local_id bigint, kind string, sorted_state bigint")
    x = np.array([np.nan if centre[s] is None else centre[s] for s in order] + [box_centre(config.basis)[0], box_centre(config.target)[0]])
    groups = {}
    if config.groups:
        try:
            shared = X.group_flux(X.block_groups(rows, last, config.groups, config.blocks)).collect()
            for g in range(config.groups):
                part = np.zeros_like(w)
                for r in shared:
                    if r["group_id"] == g:
                        part[place[r["from_state"]], place[r["to_state"]]] += r["w"]
                groups[g] = _solved(part, m, config)[2]
        except Exception as e:
            raise BlockValidationError(str(e)) from e
    t, pi, j, q, qm = model
    by_centre = np.argsort(x, kind="stable")
    net = (w.sum(axis=0) - w.sum(axis=1))[by_centre]
    profile = np.empty(m + 2)
    profile[by_centre] = np.cumsum(net)
    return Model(config, smap, edges, t, pi, j, q, qm, x, profile, groups)


def _solved(w: np.ndarray, m: int, config: Config) -> tuple:
    """(t, pi, flux, q, backward q) from flux among m clusters, the basis m and the target m + 1."""
    t = w.copy()
    t[m + 1] = 0
    t[m + 1, m] = 1
    empty = t.sum(axis=1) == 0
    t[empty, empty] = 1
    t = M.normalized_rows(t)
    pi = M.steady_state(t)
    j = M.flux_into(t, pi, m, m + 1, config.tau)
    return t, pi, j, M.committor(t, [m], [m + 1]), M.backward_committor(t, pi, [m], [m + 1])
