"""Stratified clustering: k-means within each bin, nearest centres, remapping of thin bins, cleaning.

Tables: points (bin, x array<double>, weight); centres (bin, local_id, state, x); remap (bin, bin_to). Centres and
remaps are few (clusters times bins) and go to the tasks by broadcast when a count shows that; points are never
moved for an assignment.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.predicates import squared_distance
from weftline.session import kept

FEW = 1_000_000


#: Rows, and numbers of their coordinates, that a task takes at once: a step over small batches is mostly calls.
CHUNK_ROWS, CHUNK_NUMBERS = 1 << 14, 1 << 18


def _chunks(batches: Iterator) -> Iterator:
    """Arrow batches with a column x joined into larger ones."""
    import pyarrow as pa

    held, rows, numbers = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, numbers = rows + batch.num_rows, numbers + len(batch.column("x").flatten())
        if rows >= CHUNK_ROWS or numbers >= CHUNK_NUMBERS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, numbers = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _coordinates(column) -> Callable[[np.ndarray], np.ndarray]:
    """Rows of an Arrow column of arrays as a matrix: a function of their places, which must be of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(n) - n

    def at(places: np.ndarray) -> np.ndarray:
        width = n[places[0]]
        if (n[places] != width).any():
            raise ValueError("coordinates of a bin differ in length")
        return flat[starts[places][:, None] + np.arange(width)]

    return at


def _places(column) -> Iterator:
    """(value, places of its rows) for each value of an Arrow column, without null and NaN."""
    coded = column.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for k, b in enumerate(coded.dictionary.to_pylist()):
        if b == b:
            yield b, order[cuts[k] : cuts[k + 1]]


def _by_bin(batch, centres: dict) -> Iterator:
    """(bin, its rows' places, their coordinates, squared distances to the bin's centres) of a batch."""
    coordinates = _coordinates(batch.column("x"))
    for b, at in _places(batch.column("bin")):
        x = coordinates(at)
        c = centres.get(b)
        yield b, at, x, None if c is None else np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1)


def _keys(batch, centres: dict) -> Iterator:
    """(bin, its rows' places, coordinates, keys): a key is the least the likelier its point is to be drawn.

    Points are drawn in proportion to weight times squared distance from their bin's centres, those on a centre never.
    """
    u, weights = batch.column("u").to_numpy(), batch.column("weight").to_numpy()
    for b, at, x, d in _by_bin(batch, centres):
        p = weights[at] if d is None else weights[at] * d.min(axis=1)
        yield b, at, x, np.divide(-np.log(u[at]), p, out=np.full(len(p), np.inf), where=p > 0)


def _drawn(points: DataFrame, centres: dict, m: int, seed: int) -> dict:
    """m different points for each bin (or all that are off its centres), drawn without replacement, in two passes.

    The first finds the m-th least key of each bin from m numbers a task, the second fetches the points up to it. Keys
    come from hashes of the coordinates, so neither partitions nor lost executors matter.
    """
    shared = points.sparkSession.sparkContext.broadcast(centres)
    u = (F.pmod(F.xxhash64("bin", "x", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rows = points.withColumn("u", u)
    kind = points.schema["bin"].dataType.simpleString()

    def least(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best: dict = {}
        for batch in _chunks(batches):
            kind = batch.column("bin").type
            for b, _, _, key in _keys(batch, shared.value):
                best[b] = np.unique(np.concatenate([best.get(b, np.empty(0)), key[key < np.inf]]))[:m]
        for b, key in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([b] * len(key), kind), pa.array(key)], names=["bin", "key"])

    w = Window.partitionBy("bin").orderBy("key")
    found = rows.mapInArrow(least, f"bin {kind}, key double").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= m)
    last = {r[0]: r[1] for r in found.groupBy("bin").agg(F.max("key")).collect()}  # a number for each bin

    def fetch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _chunks(batches):
            for b, _, x, key in _keys(batch, shared.value):
                if b in last and (key <= last[b]).any():
                    got = np.unique(x[key <= last[b]], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([b] * len(got), batch.column("bin").type), pa.array(list(got), pa.list_(pa.float64()))], names=["bin", "x"])

    out: dict = {}
    for b, x in rows.mapInArrow(fetch, f"bin {kind}, x array<double>").distinct().collect():  # m points for each bin
        out.setdefault(b, []).append(x)
    shared.unpersist()
    return {b: np.array(sorted(x)) for b, x in out.items()}


def _moved(points: DataFrame, centres: dict) -> dict:
    """(mean, weight) of the points nearest to each centre, by (bin, place); a centre without points has none.

    Each task sums its own; sums of a centre are packed in one array, however many coordinates there are.
    """
    shared = points.sparkSession.sparkContext.broadcast(centres)
    kind = points.schema["bin"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict = {}
        for batch in _chunks(batches):
            kind = batch.column("bin").type
            w = batch.column("weight").to_numpy()
            for b, at, x, d in _by_bin(batch, shared.value):
                if d is None:
                    continue
                own = d.argmin(axis=1)
                for i in np.unique(own):
                    of = own == i
                    sums[b, i] = sums.get((b, i), 0.0) + np.append(w[at][of] @ x[of], w[at][of].sum())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sums], kind), pa.array([int(i) for _, i in sums], pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["bin", "i", "s"])

    def merge(batches: Iterator) -> Iterator:
        import pandas as pd

        sums: dict = {}
        for pdf in batches:
            for key, v in zip(zip(pdf["bin"], pdf["i"], strict=True), pdf["s"], strict=True):
                sums[key] = sums.get(key, 0.0) + v
        if sums:
            yield pd.DataFrame({"bin": [b for b, _ in sums], "i": [int(i) for _, i in sums], "s": list(sums.values())})

    schema = f"bin {kind}, i bigint, s array<double>"
    got = points.mapInArrow(run, schema).repartition("bin", "i").mapInPandas(merge, schema)
    out = {(r[0], r[1]): (np.array(r[2][:-1]) / r[2][-1], r[2][-1]) for r in got.collect() if r[2][-1] > 0}
    shared.unpersist()
    return out


#: Rounds of seeding, and how many candidates a round draws for each centre asked for.
ROUNDS, OVERSAMPLED = 3, 2


def _chosen(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of few weighted candidates: the best of some k-means++ seedings after Lloyd steps among the candidates."""
    if len(x) <= k:
        return x
    best, least = x[:k], np.inf
    for _ in range(8):
        c = x[[rng.choice(len(x), p=w / w.sum())]]
        for _ in range(k - 1):
            d = ((x[:, None] - c) ** 2).sum(axis=2).min(axis=1) * w
            if not d.sum() > 0:
                break
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())]])
        for _ in range(20):
            own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([np.average(x[own == i], axis=0, weights=w[own == i]) if (own == i).any() else c[i] for i in range(len(c))])
        cost = (((x[:, None] - c) ** 2).sum(axis=2).min(axis=1) * w).sum()
        if cost < least:
            best, least = c, cost
    return best


def seeded_centres(points: DataFrame, k: int, seed: int = 0) -> dict:
    """k first centres for each bin of points (bin, x, weight), in as many passes whatever k is.

    Each of ROUNDS rounds draws OVERSAMPLED * k candidates for each bin, far from those that it has; one more pass weighs
    the candidates by the points nearest to them, and the driver clusters the candidates.
    """
    found: dict = {}
    for r in range(ROUNDS):
        for b, x in _drawn(points, found, OVERSAMPLED * k, seed * 1_000_003 + r).items():
            found[b] = np.unique(np.vstack([found[b], x]), axis=0) if b in found else x
    weights = _moved(points, found)
    rng = np.random.default_rng(seed)
    return {b: _chosen(x, np.array([weights[b, i][1] if (b, i) in weights else 0.0 for i in range(len(x))]), k, rng) for b, x in sorted(found.items())}


def stratified_centres(points: DataFrame, k: int, seed: int = 0, iters: int = 100) -> DataFrame:
    """(bin, local_id, x): k-means in each bin over all its points, by weight if there is a column of that name.

    Seeding is seeded_centres(), then come Lloyd's iterations, each one pass over the points for all bins; if iters do
    not settle all bins, a warning says so. Points without bin or coordinates, with a null coordinate, or without
    positive weight don't count. What comes to the driver are centres and candidates, some k a bin.
    """
    schema = f"bin {points.schema['bin'].dataType.simpleString()}, local_id bigint, x array<double>"
    weight = F.col("weight").cast("double") if "weight" in points.columns else F.lit(1.0)
    rows = points.select("bin", F.col("x").cast("array<double>").alias("x"), weight.alias("weight"))
    rows = kept(rows.where("bin is not null and weight > 0 and x is not null and not exists(x, v -> v is null)"), "points")
    centres = seeded_centres(rows, k, seed)
    active = centres
    for _ in range(iters):
        if not active:
            break
        means = _moved(rows, active)
        moved = {b: np.array([means[b, i][0] if (b, i) in means else c[i] for i in range(len(c))]) for b, c in active.items()}
        active = {b: c for b, c in moved.items() if not np.allclose(c, centres[b], rtol=0, atol=1e-12)}
        centres = centres | moved
    if active:
        warnings.warn(f"{len(active)} bins have not settled after {iters} iterations", stacklevel=2)
    out = [(b, i, x.tolist()) for b, c in centres.items() for i, x in enumerate(c[np.lexsort(c.T[::-1])])]
    return points.sparkSession.createDataFrame(out, schema)


def aggregated_centres(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(local_id, x): one k-means over all points, distributed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, featuresCol="v").fit(points.select(array_to_vector("x").alias("v")))
    rows = sorted(tuple(map(float, c)) for c in model.clusterCenters())
    return points.sparkSession.createDataFrame([(i, list(c)) for i, c in enumerate(rows)], "local_id bigint, x array<double>")


def state_offsets(centres: DataFrame) -> DataFrame:
    """(bin, n, offset): how many centres come before each bin's."""
    n = centres.groupBy("bin").agg(F.count("*").alias("n"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def numbered(centres: DataFrame) -> DataFrame:
    """Centres with a state number: by bin, then local_id."""
    off = state_offsets(centres).select("bin", "offset")
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("local_id")) - 1
    return centres.withColumn("_r", rank).join(off, "bin").select("bin", "local_id", (F.col("offset") + F.col("_r")).cast("long").alias("state"), "x")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def nearest(points: DataFrame, centres: DataFrame, keys: list[str], on: list[str] = ()) -> DataFrame:
    """keys with the state of the nearest centre (of the same on columns, such as the bin) and its distance.

    Each point meets the centres of its own bin only, as one array that travels with the join, so no pair of a point
    and a centre becomes a row and points are not grouped; ties go to the lower state.
    """
    near = F.sort_array(F.collect_list(F.struct("state", F.col("x").cast("array<double>").alias("c")))).alias("_c")
    held = _few(centres.groupBy(*on).agg(near))
    rows = points.join(held, list(on)) if on else points.crossJoin(held)
    best = F.array_min(F.transform("_c", lambda c: F.struct(squared_distance(F.col("x"), c["c"]).alias("d"), c["state"].alias("s"))))
    return rows.withColumn("_m", best).where("_m is not null").select(*keys, F.col("_m.s").alias("state"), F.sqrt("_m.d").alias("distance"))


def save_centres(centres: DataFrame, path: str) -> None:
    """Clusters as a table; nothing is pickled."""
    centres.select("bin", "local_id", "state", "x").coalesce(1).write.mode("overwrite").parquet(path)


def load_centres(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select("bin", "local_id", "state", "x")


def cluster_coordinates(points: DataFrame, k: int, method: str = "stratified", seed: int = 0, **options) -> DataFrame:
    """Numbered centres (bin, local_id, state, x) of points (bin, x, weight): k for each bin, or k over all in bin 0."""
    if method == "stratified":
        return numbered(stratified_centres(points, k, seed, **options))
    if method == "aggregated":
        centres = aggregated_centres(points, k, seed, **options)
        return centres.select(F.lit(0).cast("long").alias("bin"), "local_id", F.col("local_id").alias("state"), "x")
    raise ValueError(f"no clustering is called {method}")


def assigned(points: DataFrame, centres: DataFrame, on_bin: bool = True) -> DataFrame:
    """points with a state column, without a shuffle: every task holds the centres (at most FEW rows, checked)."""
    rows = centres.limit(FEW + 1).collect()
    if len(rows) > FEW:
        raise ValueError("too many centres to hold in a task; use nearest()")
    table: dict = {}
    for r in rows:
        table.setdefault(r["bin"] if on_bin else None, []).append((r["state"], r["x"]))
    packed = {b: (np.array([s for s, _ in sorted(v)]), np.array([x for _, x in sorted(v)])) for b, v in table.items()}
    shared = points.sparkSession.sparkContext.broadcast(packed)
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*points.schema.fields, StructField("state", LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _chunks(batches):
            out, unknown = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
            coordinates = _coordinates(batch.column("x"))
            for b, at in _places(batch.column("bin")) if on_bin else [(None, np.arange(batch.num_rows))]:
                if b in shared.value and len(at):
                    s, c = shared.value[b]
                    x = coordinates(at)
                    d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]
                    out[at], unknown[at] = s[d.argmin(axis=1)], False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=unknown)], names=[*batch.schema.names, "state"])

    return points.mapInArrow(run, schema)


def bin_counts(points: DataFrame, least: int) -> DataFrame:
    """(bin, n, filled): points in each bin, and whether they are enough."""
    return points.groupBy("bin").agg(F.count("*").alias("n")).withColumn("filled", F.col("n") >= least)


def thin_bins(counts: DataFrame, bin_centres: DataFrame, distance=squared_distance) -> DataFrame:
    """remap (bin, bin_to): filled bins to themselves, others to the nearest filled one, the lower of equals.

    distance: of two array columns; as given, bins are nearest by RMSD. The number of bins squared is what is compared.
    """
    filled = counts.where("filled").select(F.col("bin").alias("bin_to")).join(bin_centres.select(F.col("bin").alias("bin_to"), F.col("x").alias("_c")), "bin_to")
    rest = counts.where("not filled").select("bin").join(bin_centres.select("bin", "x"), "bin")
    d = distance(F.col("x"), F.col("_c"))
    moved = rest.crossJoin(_few(filled)).groupBy("bin").agg(F.min(F.struct(d.alias("d"), F.col("bin_to").alias("b"))).alias("m")).select("bin", F.col("m.b").alias("bin_to"))
    return counts.where("filled").select("bin", F.col("bin").alias("bin_to")).unionByName(moved)


def grid_centres(edges: list[list[float]]) -> list[list[float]]:
    """Centres of a grid's cells in row-major order; a cell with one infinite edge is represented by the finite one."""
    import itertools

    from weftline.functions.predicates import box_centre

    sides = [[box_centre((a, b))[0] for a, b in zip(e, e[1:], strict=False)] for e in edges]
    return [list(p) for p in itertools.product(*sides)]


def strongly_connected(edges: DataFrame, n: int, special: tuple[int, int]) -> tuple[list[int], list[int]]:
    """(states that stay, states that go): the largest strongly connected set, once the target leads back to the basis.

    Edges among n states come to the driver (see markov.dense).
    """
    from .graphs import strong_components
    from .markov import dense

    m = dense(edges, n, "w")
    m[special[1], special[0]] = max(m[special[1], special[0]], 1e-300)
    stay = strong_components(m)[0]
    return stay, sorted(set(range(n)) - set(stay))


def cleaned_centres(centres: DataFrame, stay: list[int]) -> DataFrame:
    """Centres of the states that stay; states keep their numbers, so that a state map can name both."""
    keep = centres.sparkSession.createDataFrame([(int(s),) for s in stay], "state bigint")
    return centres.join(F.broadcast(keep), "state", "left_semi")
