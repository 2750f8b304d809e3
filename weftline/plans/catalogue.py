"""The registered queries of the trajectory operators; their SQL is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import predicates as P
from weftline.operators import centre_index as I
from weftline.operators import chains as H
from weftline.operators import cluster as C
from weftline.operators import components as K
from weftline.operators import flux as X
from weftline.operators import graphs as G
from weftline.operators import markov as M
from weftline.operators import optimize as O
from weftline.operators import passage as Q
from weftline.operators import reduce as R
from weftline.operators import sequences as Z
from weftline.operators import trajectories as T
from weftline.session import ship
from weftline.sources import lineage as L
from weftline.sources import segments as S
from weftline.sources import views as V

from .oracle import SQL  # noqa: F401

N, BASIS, TARGET = len(V.CLUSTERS), len(V.CLUSTERS), len(V.CLUSTERS) + 1
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
    return f


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, whole numbers as bigint."""
    out = []
    for c, kind in df.dtypes:
        out.append(F.round(F.col(c), 6).alias(c) if kind == "double" else F.col(c).cast("bigint").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c))
    return df.select(*out)


# ---- segments ----------------------------------------------------------------------------------------------------


@query
def load_segments(spark, d):
    return tidy(S.iteration(V.segments(spark, d), 3).select("file_idx", "seg_id", "p0", "p1", "from_label", "to_label", "weight"))


@query
def iteration_counts(spark, d):
    return tidy(S.iteration_counts(V.segments(spark, d)))


@query
def iteration_counts_range(spark, d):
    return tidy(S.iterations_between(V.segments(spark, d), 5, 20))


@query
def drop_last_iteration(spark, d):
    return tidy(S.complete(V.segments(spark, d)).groupBy("file_idx").agg(F.count("*").alias("n"), F.max("n_iter").alias("last_iter")))


@query
def pick_iterations(spark, d):
    return tidy(S.pick_iterations(V.segments(spark, d), iters=[2, 4, 8]).groupBy("n_iter").agg(F.count("*").alias("n"), F.sum("p1").alias("p1_sum")))


@query
def until_budget(spark, d):
    return tidy(S.until_budget(V.segments(spark, d), 500).groupBy("n_iter").agg(F.count("*").alias("n")))


@query
def parent_history_k3(spark, d):
    rows = S.histories(V.segments(spark, d), 3, carry=("weight", "p1")).where("n_iter >= 4")
    return tidy(rows.groupBy("n_iter").agg(F.count("parent_3").alias("n"), F.sum("weight_3").alias("w3"), F.sum("p1_1").alias("p1_sum"), F.sum("p1_3").alias("p3_sum")))


@query
def start_from_parent(spark, d):
    rows = V.segments(spark, d).select("file_idx", "n_iter", "seg_id", "parent_id", F.array("p0").alias("coord0"), F.array("p1").alias("coord1"))
    out = S.with_parent_coordinates(rows, F.array(F.lit(-1.0)))
    return tidy(out.groupBy("n_iter").agg(F.count("*").alias("n"), F.sum(F.col("coord0")[0]).alias("start_sum")))


@query
def masked_transitions(spark, d):
    rows = V.segments(spark, d)
    nan = F.when(F.col("p1") > 100, F.lit(float("nan"))).otherwise(F.col("p1"))
    pairs = S.transition_pairs(rows.select("file_idx", "n_iter", "seg_id", F.array("p0").alias("coord0"), F.array(nan).alias("coord1"), "weight"))
    return tidy(pairs.groupBy("n_iter").agg(F.count("*").alias("n"), F.sum("weight").alias("w")))


@query
def warped_segments(spark, d):
    return tidy(X.warps(V.segments(spark, d), P.in_box([F.col("p1")], V.TARGET)))


@query
def structure_references(spark, d):
    """Of every complete iteration."""
    rows = S.complete(V.segments(spark, d))
    return rows.select("seg_id", S.structure_reference(F.concat(F.lit("f"), F.col("file_idx")), F.col("n_iter"), F.col("seg_id")).alias("ref"))


# ---- predicates and labels ---------------------------------------------------------------------------------------


@query
def box_basis_target(spark, d):
    x = [F.col("value")]
    return V.read(spark, d, "events").select("event_id", P.in_box(x, V.BASIS).alias("in_basis"), P.in_box(x, V.TARGET).alias("in_target"))


@query
def interval_union_nd(spark, d):
    rows = V.read(spark, d, "events").where("value is not null")
    union = P.in_interval(F.col("value"), [(1, 2), (3, 4), (10, 40)])
    product = P.in_interval([F.col("value"), F.col("user_id").cast("double")], [[(0, 20), (0, 5)], [(20, 50), (5, 15)]])
    return rows.select("event_id", union.alias("in_union"), product.alias("in_product"))


@query
def label_dictionary(spark, d):
    return T.dictionary(V.event_trajs(spark, d))


@query
def coarse_macrostates(spark, d):
    a, b = ["F1-URGENT", "O1-URGENT"], ["F5-LOW", "O5-LOW"]
    rows = V.order_trajs(spark, d).withColumn("state", P.merged_label(P.merged_label(F.col("state"), a), b))
    return rows.groupBy("state").agg(F.count("*").alias("n"))


@query
def rectilinear_bins(spark, d):
    rows = V.read(spark, d, "events")
    b = P.rectilinear_bin([F.col("value"), F.col("user_id").cast("double")], [[0, 5, 20, 80, 600], [0, 4, 9, 1e9]])
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query
def bin_counts(spark, d):
    return C.bin_counts(V.vectors(spark, d), 50)


# ---- flux --------------------------------------------------------------------------------------------------------


def _flux_segments(spark, d):
    """Segments of iterations 2 up to the one before the last, with their states; and how many iterations these are."""
    rows = X.with_states(V.segments(spark, d), N, V.BASIS, V.TARGET)
    last = rows.agg(F.max("n_iter")).first()[0] or 0
    return S.pick_iterations(rows, 2, last), max(1, last - 2)


def _edges(spark, d):
    rows, n = _flux_segments(spark, d)
    return X.flux_matrix(rows, n)


def _states(spark):
    return spark.range(N + 2).withColumnRenamed("id", "state")


def _t(spark, d):
    return M.transition_matrix(_edges(spark, d), _states(spark), BASIS, TARGET)


def _t_dense(spark, d):
    return M.dense(_t(spark, d), N + 2)


@query
def flux_matrix(spark, d):
    return tidy(_edges(spark, d))


@query
def flux_matrix_total_one(spark, d):
    return tidy(X.total_one(_edges(spark, d)))


@query
def flux_matrix_by_iter(spark, d):
    return tidy(X.flux_matrix(_flux_segments(spark, d)[0], 1, ("n_iter",)))


@query
def flux_special_states(spark, d):
    rows = X.with_states(V.segments(spark, d), N, V.BASIS, V.TARGET)
    return tidy(rows.groupBy("from_state", "to_state").agg(F.count("*").alias("n")))


@query
def flux_pcoord1d(spark, d):
    """The mean over all complete iterations, by their real number."""
    rows = S.complete(V.segments(spark, d))
    n = rows.agg(F.countDistinct("n_iter")).first()[0]
    return tidy(X.pcoord_flux(rows, 0.0, 200.0, 10, max(1, n)))


def _centres(spark, d):
    rows = X.with_states(V.segments(spark, d), N, V.BASIS, V.TARGET)
    got = X.centre_stats(rows, _states(spark))
    fixed = F.when(F.col("state") == BASIS, P.box_centre(V.BASIS)[0]).when(F.col("state") == TARGET, P.box_centre(V.TARGET)[0]).otherwise(F.col("centre"))
    kind = F.when(F.col("state") == BASIS, "basis").when(F.col("state") == TARGET, "target")
    return got.withColumn("centre", fixed).withColumn("kind", kind)


@query
def cluster_centers_stats(spark, d):
    return tidy(_centres(spark, d).select("state", "centre", "low", "high"))


@query
def sorted_states(spark, d):
    return X.sorted_states(_centres(spark, d))


@query
def flux_sorted(spark, d):
    return tidy(X.relabelled(_edges(spark, d), X.sorted_states(_centres(spark, d))))


def _places(spark, d):
    """All states by centre, the basis and target among them by the centres of their boxes."""
    return _centres(spark, d).select("state", (F.row_number().over(Window.orderBy("centre", "state")) - 1).cast("long").alias("place"))


@query
def flux_profile(spark, d):
    return tidy(X.profile(_edges(spark, d), _places(spark, d)))


@query
def flux_profile_committor(spark, d):
    q = M.committor_steps(_t_dense(spark, d), BASIS, TARGET, 40)
    states = M.vector_frame(spark, np.round(q, 9), "q")
    places = states.select("state", (F.row_number().over(Window.orderBy(F.desc("q"), "state")) - 1).cast("long").alias("place"))
    return tidy(X.profile(_edges(spark, d), places))


@query
def coarse_flux_profile(spark, d):
    inner = _centres(spark, d).where("kind is null")
    return tidy(X.coarse_profile(_edges(spark, d), inner, 0.0, 100.0, 20))


@query
def flux_profile_fit(spark, d):
    points = X.profile(_edges(spark, d), _places(spark, d)).join(_centres(spark, d).select("state", "centre"), "state")
    return tidy(X.fit_line(points, "centre", "flux", P.box_centre(V.TARGET)[0] < P.box_centre(V.BASIS)[0]))


@query
def smoothed_flux(spark, d):
    rows = X.direct_flux(V.segments(spark, d), P.in_box([F.col("p1")], V.TARGET))
    return tidy(X.smoothed(rows, "n_iter", "flux", 5))


@query
def direct_target_flux(spark, d):
    return tidy(X.direct_flux(V.segments(spark, d), P.in_box([F.col("p1")], V.TARGET), 2.0))


@query
def windowed_direct_flux(spark, d):
    return tidy(X.windowed_flux(X.direct_flux(V.segments(spark, d), P.in_box([F.col("p1")], V.TARGET)), 4))


@query
def block_validation_flux(spark, d):
    rows = X.with_states(V.segments(spark, d), N, V.BASIS, V.TARGET)
    last = rows.agg(F.max("n_iter")).first()[0] or 4
    return tidy(X.group_flux(X.block_groups(rows, last, 2, 4)))


@query
def start_state_weights(spark, d):
    """Segments of all complete iterations share their state's weight."""
    rows = S.complete(X.with_states(V.segments(spark, d), N, V.BASIS, V.TARGET))
    pi = M.vector_frame(spark, M.steady_state_powers(_t_dense(spark, d), 0, 200))
    return tidy(X.start_weights(rows, pi, [BASIS, TARGET]))


# ---- chains ------------------------------------------------------------------------------------------------------


@query
def transition_matrix(spark, d):
    return tidy(_t(spark, d))


@query
def eq_transition_matrix(spark, d):
    return tidy(M.without_states(_edges(spark, d), [BASIS, TARGET]))


@query
def steady_state_power(spark, d):
    return tidy(M.vector_frame(spark, M.steady_state_powers(_t_dense(spark, d), 0, 200)))


@query
def target_flux(spark, d):
    pi = M.vector_frame(spark, M.steady_state_powers(_t_dense(spark, d), 0, 200))
    return tidy(M.target_flux(_t(spark, d), pi, TARGET, 2.0))


@query
def vector_step(spark, d):
    pi = _states(spark).withColumn("value", F.lit(1.0 / (N + 2)))
    t = _t(spark, d)
    return tidy(M.step(t, M.step(t, pi)))


@query
def committor_iter(spark, d):
    return tidy(M.vector_frame(spark, M.committor_steps(_t_dense(spark, d), BASIS, TARGET, 40)))


@query
def backward_committor_iter(spark, d):
    t = _t_dense(spark, d)
    pi = M.steady_state_powers(t, 0, 200)
    return tidy(M.vector_frame(spark, M.committor_steps(M.normalized_rows(t.T * pi[None, :]), TARGET, BASIS, 40)))


@query
def evolve_target_flux(spark, d):
    p0 = np.zeros(N + 2)
    p0[BASIS] = 1
    return tidy(spark.createDataFrame(M.evolved_flux(p0, _t_dense(spark, d), TARGET, 20, 2.0), "step bigint, flux double"))


@query
def is_reachable(spark, d):
    m = M.dense(_edges(spark, d), N + 2, "w")
    return spark.createDataFrame([(i, j, G.reaches(m, [i], [j])) for i in range(N + 2) for j in range(N + 2)], "i bigint, j bigint, reached boolean")


def _fine_chain(spark, d):
    """The chain of 20 states: the clusters, each in four ranges of the coordinate."""
    fine = lambda c, x: F.col(c) * 4 + sum((F.col(x) >= b).cast("long") for b in (5, 20, 60))
    rows = V.segments(spark, d).select(fine("from_cluster", "p0").alias("from_state"), fine("to_cluster", "p1").alias("to_state"))
    rows = rows.where("from_state is not null and to_state is not null").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    return T.normalized(rows, ["from_state"], "n").select("from_state", "to_state", "p")


def _named(spark, *states):
    return spark.createDataFrame([(s,) for s in states], "state bigint")


@query
def fine_stationary(spark, d):
    """Stationary probabilities by aggregation over blocks of eight states."""
    return tidy(H.stationary(_fine_chain(spark, d), block=8))


@query
def fine_committor(spark, d):
    return tidy(H.committor(_fine_chain(spark, d), _named(spark, 12), _named(spark, 11), block=8))


@query
def fine_passage(spark, d):
    """Mean steps to one state, of every state."""
    return tidy(H.mean_passage(_fine_chain(spark, d), _named(spark, 11), block=8))


@query
def fine_passage_times(spark, d):
    """Distributions of the steps from two states to a third, up to 24."""
    starts = spark.createDataFrame([(12, 12, 1.0), (3, 3, 1.0)], "source bigint, state bigint, value double")
    return tidy(H.passage_distribution(_fine_chain(spark, d), starts, _named(spark, 11), 24))


@query
def part_components(spark, d):
    """Strongly connected components of the walks over parts, each state with its component."""
    return tidy(K.components(V.part_edges(spark, d)))


@query
def part_reach(spark, d):
    """How many parts the walks reach from each part whose number is divisible by 20."""
    edges = V.part_edges(spark, d)
    sources = edges.select(F.explode(F.array("from_state", "to_state")).alias("state")).where("state % 20 = 0").distinct()
    return tidy(K.reach_counts(edges, sources))


@query
def part_chain_cleaned(spark, d):
    """The chain of the walks over parts without states that are never entered or never left."""
    return tidy(K.cleaned_edges(V.part_edges(spark, d), "w"))


# ---- trajectories ------------------------------------------------------------------------------------------------


def _fpts(spark, d, lag=1):
    return T.passages(V.event_trajs(spark, d), V.in_a(), V.in_b(), lag, block=T.BLOCK)


@query
def fpt_events(spark, d):
    return _fpts(spark, d).select("traj", "idx", "direction", "fpt")


@query
def mean_fpt(spark, d):
    return tidy(T.mean_passages(_fpts(spark, d)))


@query
def mean_fpt_lag2(spark, d):
    return tidy(T.mean_passages(_fpts(spark, d, 2)))


@query
def mean_fpt_discrete(spark, d):
    rows = V.event_trajs(spark, d)
    return tidy(T.mean_passages(T.passages(rows, F.col("state") == "signup", F.col("state") == "purchase", block=T.BLOCK)))


@query
def event_durations(spark, d):
    return tidy(T.event_durations(_fpts(spark, d)))


@query
def paths_ab(spark, d):
    return T.paths(V.event_trajs(spark, d), V.in_a(), V.in_b(), block=T.BLOCK).select("traj", "path_id", "idx", "state")


@query
def path_lengths(spark, d):
    return T.path_lengths(T.paths(V.event_trajs(spark, d), V.in_a(), V.in_b(), block=T.BLOCK))


@query
def corr_function(spark, d):
    return tidy(T.correlation(V.event_trajs(spark, d), V.in_a(), V.in_b(), [1, 2, 5], block=T.BLOCK))


@query
def corr_function_symmetric(spark, d):
    return tidy(T.correlation(V.event_trajs(spark, d), V.in_a(), V.in_b(), [1, 2, 5], True, block=T.BLOCK))


@query
def count_matrix(spark, d):
    return T.count_pairs(V.event_trajs(spark, d), block=T.BLOCK)


@query
def count_matrix_orders(spark, d):
    return T.count_pairs(V.order_trajs(spark, d), block=T.BLOCK)


@query
def count_matrix_lag3(spark, d):
    return T.count_pairs(V.event_trajs(spark, d), 3, block=T.BLOCK)


@query
def count_matrix_nonsliding(spark, d):
    return T.count_pairs(V.event_trajs(spark, d), 3, False, block=T.BLOCK)


@query
def mle_transition_matrix(spark, d):
    return tidy(T.normalized(T.count_pairs(V.turn_trajs(spark, d), block=T.BLOCK), ["from_state"], "n").select("from_state", "to_state", "p"))


@query
def symmetric_tmatrix(spark, d):
    return tidy(T.normalized(T.symmetrized(T.count_pairs(V.event_trajs(spark, d), 3, block=T.BLOCK)), ["from_state"], "n").select("from_state", "to_state", "p"))


def _ab():
    return F.col("state") == "signup", F.col("state") == "purchase"


@query
def colored_count_matrix(spark, d):
    return T.coloured_counts(V.event_trajs(spark, d), *_ab(), 3, block=T.BLOCK)


@query
def colored_count_nonsliding(spark, d):
    return T.coloured_counts(V.event_trajs(spark, d), *_ab(), 3, False, block=T.BLOCK)


@query
def colored_tmatrix(spark, d):
    counts = T.coloured_counts(V.event_trajs(spark, d), *_ab(), 1, block=T.BLOCK)
    return tidy(T.normalized(counts, ["from_state", "from_color"], "n").drop("n"))


@query
def history_color_counts(spark, d):
    return T.history_counts(V.event_trajs(spark, d), *_ab(), 2, 3, block=T.BLOCK)


@query
def history_color_fractional(spark, d):
    """Unknown colours split by the flux of the reversible chain with colours added."""
    return tidy(T.history_model(V.event_trajs(spark, d), ["signup"], ["purchase"], 2, 3, block=T.BLOCK))


@query
def pseudo_flux(spark, d):
    return tidy(T.pseudo_flux(V.event_trajs(spark, d), ["signup"], ["purchase"], 2, block=T.BLOCK))


@query
def trajectory_shapes(spark, d):
    return T.shape_of(V.event_trajs(spark, d))


@query
def sorted_together(spark, d):
    """Users by their number of events, the most first, with the place of each."""
    rows = V.event_trajs(spark, d).groupBy("traj").agg(F.count("*").alias("n"), F.sum("x").alias("x_sum"))
    return tidy(T.ranked(rows, [F.desc("n"), F.col("traj")]).select("n", "traj", "x_sum", "place"))


@query
def path_counts(spark, d):
    return tidy(T.path_counts(V.turn_trajs(spark, d)))


@query
def path_sequences(spark, d):
    """Every different sequence of roles, a row for each place, with the number of conversations that have it."""
    counts, states = Z.sequence_counts(V.turn_trajs(spark, d))
    return tidy(states.join(counts, "traj").select("traj", "place", "state", "n", "weight"))


@query
def ensemble_union(spark, d):
    both = T.joined_ensembles(V.event_trajs(spark, d).select("traj", "idx", "x"), V.order_trajs(spark, d).select("traj", "idx", "x"))
    return tidy(both.groupBy("traj").agg(F.count("*").alias("n"), F.sum("x").alias("x_sum")))


# ---- coloured chains ---------------------------------------------------------------------------------------------


def _label_edges(spark, d):
    rows = T.normalized(T.count_pairs(V.event_trajs(spark, d), block=T.BLOCK), ["from_state"], "n")
    return rows.select(V.cluster_of("from_state").alias("from_state"), V.cluster_of("to_state").alias("to_state"), "p")


@query
def pseudo_color_matrix(spark, d):
    return tidy(M.lifted(_label_edges(spark, d), [3], [2]))


def _colored(spark, d):
    counts = T.coloured_counts(V.event_trajs(spark, d), *_ab(), 1, block=T.BLOCK)
    return T.normalized(counts, ["from_state", "from_color"], "n")


@query
def tmatrix_ab(spark, d):
    return tidy(M.one_way(_colored(spark, d), "A", ["purchase"]))


@query
def tmatrix_ba(spark, d):
    return tidy(M.one_way(_colored(spark, d), "B", ["signup"]))


@query
def entry_flux_distribution(spark, d):
    trajs = V.event_trajs(spark, d)
    counts = T.coloured_counts(trajs, F.col("state").isin("signup", "view"), F.col("state").isin("purchase", "error"), 1, block=T.BLOCK)
    return tidy(M.entry_distribution(counts, "A"))


def _colored_dense(spark, d):
    """The coloured chain over the five labels: row 2s in colour A, 2s + 1 in colour B."""
    m = np.zeros((2 * N, 2 * N))
    for r in _colored(spark, d).select(V.cluster_of("from_state").alias("f"), "from_color", V.cluster_of("to_state").alias("t"), "to_color", "p").collect():
        m[2 * r["f"] + "AB".index(r["from_color"]), 2 * r["t"] + "AB".index(r["to_color"])] = r["p"]
    return m


@query
def folded_populations(spark, d):
    """Populations of the states from the steady state of the coloured chain."""
    return tidy(M.vector_frame(spark, M.folded(M.steady_state(_colored_dense(spark, d)))))


@query
def macrostate_populations(spark, d):
    a, b = Q.macrostate_populations(M.folded(M.steady_state(_colored_dense(spark, d))), [3], [2])
    return tidy(spark.createDataFrame([(a, b)], "pop_a double, pop_b double"))


@query
def fpt_distribution_ab(spark, d):
    return tidy(spark.createDataFrame(Q.directed_fpt_distribution(_colored_dense(spark, d), [3], [2], "AB", 40), "t double, density double"))


@query
def fpt_distribution_ba(spark, d):
    return tidy(spark.createDataFrame(Q.directed_fpt_distribution(_colored_dense(spark, d), [3], [2], "BA", 40), "t double, density double"))


@query
def path_model_mfpt(spark, d):
    """The chain counted along paths from A to B, and its mean time from A to B."""
    rows = T.paths(V.event_trajs(spark, d), *_ab(), block=T.BLOCK).withColumn("traj", F.concat_ws("-", "traj", "path_id"))
    w = Window.partitionBy("traj").orderBy("idx")
    counts = T.count_pairs(rows.withColumn("idx", F.row_number().over(w) - 1))
    m = M.dense(counts.select(V.cluster_of("from_state").alias("from_state"), V.cluster_of("to_state").alias("to_state"), F.col("n").cast("double").alias("w")), N, "w")
    return tidy(spark.createDataFrame([(Q.path_model_mfpt(m, [3], [2]),)], "mfpt double"))


def _mfpts(spark, d):
    return Q.mfpt_table(spark, M.dense(_label_edges(spark, d), N))


@query
def commute_time_min(spark, d):
    return tidy(M.extreme_commute(_mfpts(spark, d)))


@query
def commute_time_max(spark, d):
    return tidy(M.extreme_commute(_mfpts(spark, d), True))


# ---- clusters ----------------------------------------------------------------------------------------------------


def _label_centres(spark, d):
    rows = V.vectors(spark, d).select("bin", F.posexplode("x").alias("k", "v")).groupBy("bin", "k").agg(F.avg("v").alias("v"))
    rows = rows.groupBy("bin").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("x"))
    return rows.select("bin", F.lit(0).cast("long").alias("local_id"), F.col("bin").alias("state"), "x")


@query
def nearest_center(spark, d):
    return tidy(C.nearest(V.vectors(spark, d), _label_centres(spark, d), ["vec_id"]))


@query
def nearest_center_stratified(spark, d):
    # two centres for each label: the means of its even and its odd vectors
    v = V.vectors(spark, d).withColumn("local_id", F.col("vec_id") % 2)
    rows = v.select("bin", "local_id", F.posexplode("x").alias("k", "v")).groupBy("bin", "local_id", "k").agg(F.avg("v").alias("v"))
    rows = rows.groupBy("bin", "local_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("x"))
    return tidy(C.nearest(V.vectors(spark, d), C.numbered(rows), ["vec_id"], ["bin"]))


@query
def nearest_bin(spark, d):
    v = V.vectors(spark, d)
    counts = C.bin_counts(v, (v.count() + 9) // 10)
    return C.thin_bins(counts, _label_centres(spark, d)).select("bin", "bin_to")


@query
def state_offsets(spark, d):
    return tidy(C.state_offsets(V.vectors(spark, d)))


def _fine_states(spark, d):
    """The 20 states of the fine chain: mean coordinate one step on, its deviation, and the share of segments."""
    fine = F.col("from_cluster") * 4 + sum((F.col("p0") >= b).cast("long") for b in (5, 20, 60))
    rows = V.segments(spark, d).withColumn("state", fine).where("state is not null and p1 is not null")
    rows = rows.groupBy("state").agg(F.avg("p1").alias("h"), F.stddev_pop("p1").alias("v"), F.count("*").alias("n"))
    return rows.select("state", "h", "v", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pi"))


@query
def nearest_of_many(spark, d):
    """Of all vectors: the nearest of those whose number is divisible by 20, through an index."""
    v = V.vectors(spark, d)
    index = I.index_centres(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("state"), "x"), shard=64)
    return tidy(I.nearest_of_many(v, index, ["vec_id"]))


@query
def optimized_uniform_bins(spark, d):
    return O.uniform_bins(_fine_states(spark, d), 7)


@query
def optimized_bin_lookup(spark, d):
    rows = V.segments(spark, d).withColumn("state", F.col("to_cluster"))
    mapper = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (4, 2)], "state bigint, bin bigint")
    out = O.optimized_bins(rows, mapper, 5, P.in_box([F.col("p1")], V.BASIS), P.in_box([F.col("p1")], V.TARGET))
    return out.groupBy("bin").agg(F.count("*").alias("n"))


@query
def target_reached(spark, d):
    rows = V.segments(spark, d).withColumn("endpoint_type", F.when(P.in_box([F.col("p1")], V.TARGET), F.lit(S.RECYCLED)).otherwise(F.lit(1)))
    return spark.createDataFrame([(S.target_reached(rows),)], "reached boolean")


@query
def end_coordinates(spark, d):
    rows = V.segments(spark, d).withColumn("coord1", F.array(F.when(F.col("p1") > 100, F.lit(float("nan"))).otherwise(F.col("p1"))))
    return tidy(S.end_coordinates(rows).groupBy("n_iter").agg(F.count("*").alias("n"), F.sum(F.col("coord1")[0]).alias("x_sum")))


@query
def start_coordinates(spark, d):
    rows = V.segments(spark, d).withColumn("coord0", F.array(F.when(F.col("p0") > 100, F.lit(float("nan"))).otherwise(F.col("p0"))))
    return tidy(S.start_coordinates(rows).groupBy("n_iter").agg(F.count("*").alias("n"), F.sum(F.col("coord0")[0]).alias("x_sum")))


@query
def coordinate_set(spark, d):
    """Structures of all iterations, with bad segments masked."""
    bad = F.when(F.col("p1") > 100, F.lit(float("nan"))).otherwise(F.col("p1"))
    rows = V.segments(spark, d).withColumn("pcoord1", F.array("p1")).withColumn("coord1", F.array(bad))
    last = (rows.agg(F.max("n_iter")).first()[0] or 0) + 1
    out = S.coordinate_set(rows, 1, last)
    return tidy(out.groupBy("n_iter").agg(F.count("*").alias("n"), F.count("coord1").alias("good"), F.sum(F.when(~F.isnan(F.col("pcoord1")[0]), F.col("pcoord1")[0])).alias("x_sum")))


@query
def discretized(spark, d):
    """Events as states by intervals of their value, counted."""
    rows = T.discretized(V.event_trajs(spark, d), P.uniform_bin(F.col("x"), 0.0, 100.0, 5))
    return T.count_pairs(rows, block=T.BLOCK)


@query
def sliced(spark, d):
    rows = T.sliced(V.event_trajs(spark, d), 3, 9)
    return tidy(rows.groupBy("idx").agg(F.count("*").alias("n"), F.sum("x").alias("x_sum")))


@query
def lagged_pairs(spark, d):
    rows = V.segments(spark, d).withColumn("parent_id", F.when(F.col("p1") > 150, F.lit(-1)).otherwise(F.col("parent_id")))
    rows = rows.select("file_idx", "n_iter", "seg_id", "weight", "parent_id", F.array("p0").alias("coord0"), F.array("p1").alias("coord1"))
    out = S.lagged_pairs(rows, 1, F.array(F.lit(-1.0)), F.array(F.lit(-2.0)))
    return tidy(out.agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("start")[0]).alias("start_sum"), F.sum(F.col("end")[0]).alias("end_sum")))


@query
def lagged_pairs_lag2(spark, d):
    rows = V.segments(spark, d).withColumn("parent_id", F.when(F.col("p1") > 150, F.lit(-1)).otherwise(F.col("parent_id")))
    rows = rows.select("file_idx", "n_iter", "seg_id", "weight", "parent_id", F.array("p0").alias("coord0"), F.array("p1").alias("coord1"))
    out = S.lagged_pairs(rows, 2, F.array(F.lit(-1.0)), F.array(F.lit(-2.0)))
    return tidy(out.agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("start")[0]).alias("start_sum"), F.sum(F.col("end")[0]).alias("end_sum")))


@query
def lagged_pairs_lag20(spark, d):
    rows = V.branching(spark, d).select("file_idx", "n_iter", "seg_id", "weight", "parent_id", F.array("p0").alias("coord0"), F.array("p1").alias("coord1"))
    out = S.lagged_pairs(rows, 20, F.array(F.lit(-1.0)), F.array(F.lit(-2.0)))
    return tidy(out.groupBy(F.floor(F.col("start")[0] / 10).alias("from_bin"), F.floor(F.col("end")[0] / 10).alias("to_bin")).agg(F.count("*").alias("n"), F.sum("weight").alias("w")))


@query
def ancestors_64(spark, d):
    """Of every segment: the ancestor 64 iterations back, or the recycled one on the way; -1 where there is none."""
    return tidy(L.ancestors(V.branching(spark, d), 64).fillna(-1))


@query
def path_sums(spark, d):
    """Of every segment: length and summed coordinate of its history, up to 40 iterations back."""
    sums = L.history_sums(V.branching(spark, d), 40, ["p1", "weight"])
    return tidy(sums.withColumnsRenamed({"p1": "p1_sum", "weight": "w_sum"}))


@query
def structures_by_state(spark, d):
    return tidy(S.structures_by_state(X.with_states(V.segments(spark, d), N, V.BASIS, V.TARGET)))


@query
def fill_bins(spark, d):
    """Coordinates of the iterations pulled until every bin seen holds 40 points."""
    points = V.segments(spark, d).withColumn("bin", P.uniform_bin(F.col("p1"), 0.0, 200.0, 4))
    return tidy(S.fill_bins(points, 40).groupBy("bin").agg(F.count("*").alias("n"), F.min("n_iter").alias("first"), F.sum("p1").alias("p1_sum")))


CORNERS = ((0.0, 0.0), (20.0, 10.0), (60.0, 5.0), (200.0, 20.0))


@query
def voronoi_bins(spark, d):
    rows = V.read(spark, d, "events").where("value is not null and user_id is not null")
    b = P.voronoi_bin(F.array(F.col("value"), F.col("user_id").cast("double")), CORNERS)
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query
def nearest_bin_overridden(spark, d):
    """As nearest_bin, by the largest difference of a coordinate instead of the RMSD."""
    v = V.vectors(spark, d)
    counts = C.bin_counts(v, (v.count() + 9) // 10)
    far = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return C.thin_bins(counts, _label_centres(spark, d), far).select("bin", "bin_to")


@query
def optimized_mapper(spark, d):
    """From coordinate to base bin, microstate and optimised bin, with clusters of a fixed grid."""
    points = V.segments(spark, d).select("p1", F.array("p1").alias("x"))
    centres = spark.createDataFrame([(b, k, 2 * b + k, [100.0 * b + 30.0 + 40.0 * k]) for b in range(3) for k in range(2)], "bin bigint, local_id bigint, state bigint, x array<double>")
    remap = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 2), (4, 2)], "bin bigint, bin_to bigint")
    mapper = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)], "state bigint, bin bigint")
    base = P.uniform_bin(F.col("p1"), 0.0, 400.0, 4)
    out = O.mapped_points(points, base, remap, centres, mapper, 5, P.in_box([F.col("p1")], V.BASIS), P.in_box([F.col("p1")], V.TARGET))
    return tidy(out.groupBy("bin").agg(F.count("*").alias("n"), F.sum("p1").alias("p1_sum")))


@query
def accumulated_flux(spark, d):
    h, kh, varh = M.accumulated_flux(_t_dense(spark, d), [TARGET])
    return tidy(spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(h, kh, varh, strict=True))], "state bigint, h double, kh double, varh double"))


@query
def reduced_coordinates(spark, d):
    """Both ends of each segment through one reduction of features that a user's function makes."""
    from .model import prepared

    rows = V.segments(spark, d).select("n_iter", "seg_id", "weight", F.array("p0").alias("coord0"), F.array("p1").alias("coord1"))
    out = prepared(rows, "pca", lambda x: np.concatenate([x, 2 * x], axis=1), {"dims": 1})
    return tidy(out.select("n_iter", "seg_id", F.col("x0")[0].alias("x0"), F.col("x1")[0].alias("x1")))


@query
def history_trajectories(spark, d):
    rows = V.segments(spark, d).withColumn("coord1", F.array("p1"))
    out = S.trajectories(rows, 12, 4)
    total = F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["coord"][0])
    return tidy(out.select("file_idx", "seg_id", F.size("steps").alias("n"), total.alias("x_sum")))


@query
def parsed_labels(spark, d):
    """Of every complete iteration."""
    rows = S.complete(V.segments(spark, d)).select("n_iter", F.concat(F.lit("b"), F.col("to_cluster"), F.lit("_s"), F.col("seg_id")).alias("label"), "p1")
    b, seg = S.label_parts(F.col("label"), r"^b(\d+)_s(\d+)$", 2)
    return tidy(rows.select("n_iter", "label", b.alias("bin"), seg.alias("seg"), "p1"))


@query
def structure_hash_states(spark, d):
    """Of every complete iteration: a structure seen in several has one state."""
    rows = S.complete(X.with_states(V.segments(spark, d), N, V.BASIS, V.TARGET))
    hashed = rows.select("n_iter", "seg_id", "to_state", F.md5(F.concat_ws(",", F.format_string("%.2f", "p0"), F.format_string("%.2f", "p1"))).alias("hash"))
    known = hashed.groupBy("hash").agg(F.min("to_state").alias("state"))
    return tidy(hashed.join(known, "hash").select("n_iter", "seg_id", "hash", "state"))


@query
def normalized_vector(spark, d):
    return tidy(M.normalized_vector(V.event_trajs(spark, d).groupBy("state").agg(F.sum("x").alias("value"))))


@query
def checked_tmatrix(spark, d):
    return spark.createDataFrame([(M.checked(_t(spark, d), _states(spark)),)], "ok boolean")


@query
def evolve_probability(spark, d):
    p0 = np.full(N + 2, 1.0 / (N + 2))
    rows = [(k, i, float(x)) for k, p in M.evolved(p0, _t_dense(spark, d), 30, 10) for i, x in enumerate(p)]
    return tidy(spark.createDataFrame(rows, "step bigint, state bigint, p double"))


@query
def flux_fit_pvalue(spark, d):
    points = X.profile(_edges(spark, d), _places(spark, d)).join(_centres(spark, d).select("state", "centre"), "state")
    r = X.fit_line(points, "centre", "flux").first()["r"]
    return tidy(spark.createDataFrame([(float(X.student_p(r, points.where("centre is not null").count())),)], "p double"))


@query
def fpt_distribution_log(spark, d):
    rows = Q.fpt_distribution(M.dense(_label_edges(spark, d), N), [3], [2], max_lags=30, log_scale=True, powers=(0, 3), clean_recycling=True)
    return tidy(spark.createDataFrame(rows, "t double, density double"))


@query
def cleaned_tmatrix(spark, d):
    t, stay = M.cleaned(_t_dense(spark, d))
    rows = M.matrix_frame(spark, t)
    names = spark.createDataFrame(list(enumerate(stay)), "i bigint, s bigint")
    out = rows.join(names.withColumnsRenamed({"i": "from_state", "s": "f"}), "from_state").join(names.withColumnsRenamed({"i": "to_state", "s": "t"}), "to_state")
    return tidy(out.select(F.col("f").alias("from_state"), F.col("t").alias("to_state"), "p"))


# ---- not expressible in SQL: rows only, held to goldens and laws by the tests --------------------------------------


@query
def steady_state(spark, d):
    return tidy(M.vector_frame(spark, M.steady_state(_t_dense(spark, d))))


@query
def pca_reduce(spark, d):
    v = V.vectors(spark, d)
    return tidy(v.select("vec_id", F.posexplode(R.pca(v, "x", dims=5).column(F.col("x"))).alias("k", "value")))


@query
def sketched_pca_reduce(spark, d):
    """The same components without a matrix of coordinates by coordinates."""
    v = V.vectors(spark, d)
    return tidy(v.select("vec_id", F.posexplode(R.sketched_pca(v, "x", 3, 20, most=200, tol=1e-11).column(F.col("x"))).alias("k", "value")))


@query
def tica_reduce(spark, d):
    w = Window.partitionBy("bin").orderBy("vec_id")
    pairs = V.vectors(spark, d).withColumn("y", F.lead("x").over(w)).where("y is not null").select("vec_id", "x", "y", "weight")
    return tidy(pairs.select("vec_id", F.posexplode(R.tica(pairs).column(F.col("x"))).alias("k", "value")))


@query
def vamp_reduce(spark, d):
    w = Window.partitionBy("bin").orderBy("vec_id")
    pairs = V.vectors(spark, d).withColumn("y", F.lead("x").over(w)).where("y is not null").select("vec_id", "x", "y", "weight")
    return tidy(pairs.select("vec_id", F.posexplode(R.vamp(pairs, 4).column(F.col("x"))).alias("k", "value")))


@query
def kmeans_stratified(spark, d):
    centres = C.numbered(C.stratified_centres(V.vectors(spark, d), 3, 1337))
    return C.assigned(V.vectors(spark, d), centres).select("vec_id", "bin", "state")


@query
def kmeans_aggregated(spark, d):
    centres = C.aggregated_centres(V.vectors(spark, d), 8, 1337).withColumnRenamed("local_id", "state").withColumn("bin", F.lit(0))
    return C.assigned(V.vectors(spark, d), centres, False).select("vec_id", "state")


@query
def scc_clean(spark, d):
    stay, gone = C.strongly_connected(_edges(spark, d), N + 2, (BASIS, TARGET))
    return spark.createDataFrame([(s, True) for s in stay] + [(s, False) for s in gone], "state bigint, stays boolean")


@query
def mfpt_matrix(spark, d):
    return tidy(Q.mfpt_table(spark, M.dense(_label_edges(spark, d), N)))


@query
def fpt_distribution(spark, d):
    return tidy(spark.createDataFrame(Q.fpt_distribution(M.dense(_label_edges(spark, d), N), [3], [2], max_lags=50), "t double, density double"))


@query
def adaptive_fpt(spark, d):
    return tidy(spark.createDataFrame(Q.adaptive_fpt_distribution(M.dense(_label_edges(spark, d), N), [3], [2]), "t double, p double"))


@query
def model_mfpts(spark, d):
    m = Q.markov_mfpts(M.dense(_label_edges(spark, d), N), [3], [2])
    return tidy(spark.createDataFrame(list(m.items()), "direction string, mfpt double"))


@query
def color_correlation(spark, d):
    t2 = M.lifted_matrix(M.dense(_label_edges(spark, d), N), [3], [2])
    return tidy(spark.createDataFrame(Q.color_correlation(t2, [3], [2], [1, 2, 5, 10]), "t bigint, aa double, ab double, ba double, bb double"))


@query
def discrepancy(spark, d):
    t = _t_dense(spark, d)
    pi = M.steady_state(t)
    h, v = O.discrepancy(t, pi, TARGET)
    return tidy(spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(h, v, pi, strict=True))], "state bigint, h double, v double, pi double"))


@query
def clustered_bins(spark, d):
    rows = sorted(_fine_states(spark, d).collect())
    b = O.clustered_bins(*(np.array([r[k] for r in rows]) for k in ("h", "v", "pi")), 7)
    return spark.createDataFrame([(r["state"], int(x)) for r, x in zip(rows, b, strict=True)], "state bigint, bin bigint")


@query
def allocation(spark, d):
    bins = O.uniform_bins(_fine_states(spark, d), 7)
    return tidy(O.walkers(O.bin_totals(_fine_states(spark, d), bins), 100, 2))


def _valued(spark, d):
    """The segments' coordinate, its square step, and their weight."""
    return V.segments(spark, d).select(F.col("p1").alias("value"), F.col("weight").alias("pi"), ((F.col("p1") - F.col("p0")) * (F.col("p1") - F.col("p0"))).alias("var"))


@query
def value_bins_uniform(spark, d):
    rows = _valued(spark, d)
    return tidy(O.value_bins(rows, O.value_centres(rows, 9)))


@query
def value_bins_equal(spark, d):
    """Bins of about equal allocation, cut from 200 fine ones."""
    rows = _valued(spark, d)
    return tidy(O.value_bins(rows, O.value_centres(rows, 6, "equal", 200)))


@query
def fundamental_sequences(spark, d):
    t = M.dense(_label_edges(spark, d), N)
    rows = T.paths(V.event_trajs(spark, d), *_ab(), block=T.BLOCK).withColumn("s", V.cluster_of("state").cast("int"))
    found = rows.groupBy("traj", "path_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "s"))), lambda x: x["s"]).alias("path"))
    return G.fundamental_sequences(found, t)


@query
def simulate_paths(spark, d):
    return Q.simulate_paths(spark, M.dense(_label_edges(spark, d), N), [3], [2], 200, seed=42).select("path_id", F.size("path").cast("long").alias("n"))


@query
def simulate_trajectories(spark, d):
    return Q.simulate(spark, M.dense(_label_edges(spark, d), N), 20, 200, seed=42).groupBy("state").agg(F.count("*").alias("n"))


@query
def build_model(spark, d):
    from .model import Config, build

    rows = V.segments(spark, d).withColumn("bin", P.uniform_bin(F.col("p1"), 0.0, 600.0, 12)).withColumn("bin0", P.uniform_bin(F.col("p0"), 0.0, 600.0, 12))
    rows = rows.withColumn("x0", F.array("p0")).withColumn("x1", F.array("p1"))
    return tidy(build(rows, Config(V.BASIS, V.TARGET, per_bin=3, seed=1337)).table(spark))
