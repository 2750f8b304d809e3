"""Dimensionality reduction from moments that one distributed pass adds up: PCA, TICA, VAMP."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import ship


@dataclass
class Reduction:
    """x -> (x - mean) @ directions."""

    mean: np.ndarray
    directions: np.ndarray
    spectrum: np.ndarray

    def column(self, array: Column) -> Column:
        """The reduced vector of an array column: one matrix product for each Arrow batch; null for a null vector.

        The matrix is broadcast; its size is that of the model, not of the data.
        """
        from pyspark.sql.functions import pandas_udf

        spark = SparkSession.active()
        shared = spark.sparkContext.broadcast((self.mean, self.directions))
        ship(spark)

        def project(x: pd.Series) -> pd.Series:
            mean, directions = shared.value
            there = [v for v in x if v is not None]
            found = iter((np.stack(there).astype(float) - mean) @ directions) if there else iter(())
            return pd.Series([None if v is None else next(found) for v in x], dtype=object)

        return pandas_udf(project, "array<double>")(array)


#: Columns of a block of a moment matrix: a row of the partial sums holds ROWS of it by all columns.
ROWS = 64


PACKED = "k bigint, v binary"
#: Tasks that the first round of adding up deals each block to.
FANS = 32


def _added(parts: DataFrame) -> DataFrame:
    """PACKED sums by k of packed arrays, in two rounds: first the parts of groups of tasks, then the groups."""

    def merge(batches: Iterator) -> Iterator:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, v in zip(pdf["k"], pdf["v"], strict=True):
                sums[k] = sums[k] + np.frombuffer(v) if k in sums else np.frombuffer(v)
        for k, v in sums.items():
            yield pd.DataFrame({"k": [k], "v": [v.tobytes()]})

    first = parts.withColumn("fan", F.spark_partition_id() % FANS).repartition("k", "fan").select("k", "v").mapInPandas(merge, PACKED)
    return first.repartition("k").mapInPandas(merge, PACKED)


def _whole(pairs: DataFrame, both: bool) -> DataFrame:
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull())
    return pairs.where(whole("x") & whole("y")) if both else pairs.where(whole("x"))


def packed_moments(pairs: DataFrame, d: int, both: bool = True, by: str | None = None) -> DataFrame:
    """PACKED weighted sums of 1, x, y, xx', xy', yy' over rows (x, y, weight) of d coordinates, one set for each task; without
    both, of 1, x and xx' only.

    A set is a row for what is no matrix and one for each ROWS rows of the matrices, by number. With by (a column of
    whole numbers, such as the iteration) there is a set for each of its values, and by in front. Sums add up by number:
    those of any parts of the data, such as batches or iterations, are those of all of it. Rows with a null vector, or
    with a null in one, don't count.
    """
    parts = ["xx", "xy", "yy"] if both else ["xx"]

    def run(batches: Iterator) -> Iterator:
        totals: dict = {}
        for pdf in batches:
            for g, at in (pdf.groupby("by").indices if by else {0: slice(None)} if len(pdf) else {}).items():
                x, w = np.stack(pdf["x"].iloc[at]), pdf["weight"].to_numpy()[at][:, None]
                first, total = totals.setdefault(g, (np.zeros((3, max(d, 1))), np.zeros((len(parts) * d, d))))
                first[0, 0] += w.sum()
                first[1, :d] += (w * x).sum(0)
                total[:d] += (w * x).T @ x
                if both:
                    y = np.stack(pdf["y"].iloc[at])
                    first[2, :d] += (w * y).sum(0)
                    total[d : 2 * d] += (w * x).T @ y
                    total[2 * d : 3 * d] += (w * y).T @ y
        for g, (first, total) in totals.items():
            if first[0, 0]:
                blocks = [first.ravel(), *[total[i : i + ROWS].ravel() for i in range(0, len(parts) * d, ROWS)]]
                rows = pd.DataFrame({"k": range(len(blocks)), "v": [b.tobytes() for b in blocks]})
                yield rows.assign(by=g)[["by", "k", "v"]] if by else rows

    columns = ["x", "y", "weight"] if both else ["x", "weight"]
    columns = [*([F.col(by).cast("long").alias("by")] if by else []), *columns]
    rows = _whole(pairs, both).select(*columns)
    if by:
        return rows.where("by is not null").mapInPandas(run, f"by bigint, {PACKED}").withColumnRenamed("by", by)
    return rows.mapInPandas(run, PACKED)


def moments(packed: DataFrame, d: int, both: bool = True) -> dict[str, np.ndarray]:
    """Weighted means of x, y, xx', xy', yy' from PACKED sums, which are added in two rounds."""
    rows = {r["k"]: np.frombuffer(r["v"]) for r in _added(packed.select("k", "v")).collect()}
    if not rows:
        raise ValueError("no weight to reduce by")
    first = rows.pop(0).reshape(3, -1)
    w = first[0, 0]
    found = np.concatenate([rows[k] for k in sorted(rows)]).reshape(-1, d) / w
    out = {"w": w, "x": first[1, :d] / w, "y": first[2, :d] / w}
    return out | {name: found[i * d : (i + 1) * d] for i, name in enumerate(["xx", "xy", "yy"] if both else ["xx"])}


def _sums(pairs: DataFrame, both: bool = True) -> dict[str, np.ndarray]:
    """moments() of rows (x, y, weight); an empty table raises ValueError."""
    head = _whole(pairs, both).select("x").first()
    if head is None:
        raise ValueError("no rows to reduce")
    return moments(packed_moments(pairs, len(head[0]), both), len(head[0]), both)


def pca_of(s: dict[str, np.ndarray], cutoff: float = 0.95, dims: int | None = None) -> Reduction:
    """Principal components from moments(); as many as explain more than cutoff of the variance, all if none do.

    Signs are fixed: the largest entry of each direction is positive.
    """
    values, dirs = np.linalg.eigh(s["xx"] - np.outer(s["x"], s["x"]))
    values, dirs = np.clip(values[::-1], 0, None), dirs[:, ::-1]
    share = np.cumsum(values) / values.sum()
    if dims is None:
        over = np.flatnonzero(share > cutoff)
        dims = int(over[0]) + 1 if len(over) else len(values)
    dirs = dirs[:, :dims] * np.sign(dirs[np.abs(dirs[:, :dims]).argmax(axis=0), np.arange(dims)])
    return Reduction(s["x"], dirs, values[:dims])


def pca(vectors: DataFrame, column: str, cutoff: float = 0.95, dims: int | None = None) -> Reduction:
    """pca_of() an array column, every row weighing the same."""
    return pca_of(_sums(vectors.select(F.col(column).cast("array<double>").alias("x"), F.lit(1.0).alias("weight")), both=False), cutoff, dims)


#: Blocks of directions that sketched_pca holds.
SPAN = 6


def _beside(basis: np.ndarray, block: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal directions of block that are not in basis, without those that are no longer than least."""
    rest = block - basis @ (basis.T @ block)
    u, long, _ = np.linalg.svd(rest - basis @ (basis.T @ rest), full_matrices=False)
    u = u[:, long > least]
    for _ in range(2):
        u = np.linalg.qr(u - basis @ (basis.T @ u))[0]
    return u


def sketched_pca(vectors: DataFrame, column: str, dims: int, oversample: int = 10, tol: float = 1e-9, most: int = 30, seed: int = 0) -> Reduction:
    """The first dims principal components of wide vectors, without a matrix of coordinates by coordinates.

    Block Krylov iteration from a random start: each pass multiplies the covariance by dims + oversample new directions,
    so a task sends an array of coordinates by directions, in packed blocks. The components are those within all
    directions so far, so that close variances cost few passes; the driver holds at most SPAN blocks of directions and
    their products, then goes on from the best block. Passes end when no variance wanted changes by more than tol of the
    largest and no component leaves its direction by more than the root of tol of it, or when the directions span all
    coordinates (at most coordinates / directions passes, if those fit into SPAN blocks); after most passes an
    ArithmeticError is raised. Signs are fixed as in pca().
    """
    rows = vectors.select(F.col(column).cast("array<double>").alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    head = rows.first()
    if head is None:
        raise ValueError("no rows to reduce")
    spark, d = vectors.sparkSession, len(head[0])
    size = min(d, dims + oversample)
    dims = min(dims, d)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    before = np.full(dims, np.inf)
    ship(spark)
    for _ in range(most):
        shared = spark.sparkContext.broadcast(q)

        def run(batches: Iterator, shared=shared) -> Iterator:
            n, mean, total = 0, np.zeros(d), np.zeros(shared.value.shape)
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["x"])
                    n, mean, total = n + len(x), mean + x.sum(0), total + x.T @ (x @ shared.value)
            if n:
                blocks = [np.append(mean, n), *[total[i : i + ROWS].ravel() for i in range(0, d, ROWS)]]
                yield pd.DataFrame({"k": range(len(blocks)), "v": [b.tobytes() for b in blocks]})

        sums = {r["k"]: np.frombuffer(r["v"]) for r in _added(rows.mapInPandas(run, PACKED)).collect()}
        shared.unpersist()
        first = sums.pop(0)
        mean = first[:d] / first[d]
        product = np.concatenate([sums[k] for k in sorted(sums)]).reshape(q.shape) / first[d] - np.outer(mean, mean @ q)
        basis, images = np.hstack([basis, q]), np.hstack([images, product])
        inner = basis.T @ images
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = np.clip(values[::-1], 0, None), turn[:, ::-1]
        dirs, largest = basis @ turn[:, :dims], max(values[0], 1e-300)
        left = np.linalg.norm(images @ turn[:, :dims] - dirs * values[:dims], axis=0).max()
        settled = np.abs(values[:dims] - before).max() <= tol * largest and left <= np.sqrt(tol) * largest
        q = _beside(basis, product, 1e-12 * largest)[:, : d - basis.shape[1]]
        if settled or not q.shape[1]:
            return Reduction(mean, dirs * np.sign(dirs[np.abs(dirs).argmax(axis=0), np.arange(dims)]), values[:dims])
        before = values[:dims]
        if basis.shape[1] + q.shape[1] > SPAN * size:
            basis, images = basis @ turn[:, :size], images @ turn[:, :size]
    raise ArithmeticError(f"the components have not settled after {most} passes")


def batch_pca(pairs: DataFrame, dims: int | None = None) -> Reduction:
    """All components over starts and ends together: pairs (x, y)."""
    both = pairs.select("x").unionByName(pairs.select(F.col("y").alias("x")))
    return pca(both, "x", 2.0, dims)


def _whitening(c: np.ndarray, eps: float) -> np.ndarray:
    values, dirs = np.linalg.eigh(c)
    keep = values > eps * max(values.max(), eps)
    return dirs[:, keep] / np.sqrt(values[keep])


def tica(pairs: DataFrame, var_cutoff: float = 0.95, kinetic_map: bool = True, eps: float = 1e-10) -> Reduction:
    """tica_of() weighted pairs (x, y, weight)."""
    return tica_of(_sums(pairs), var_cutoff, kinetic_map, eps)


def tica_of(s: dict[str, np.ndarray], var_cutoff: float = 0.95, kinetic_map: bool = True, eps: float = 1e-10) -> Reduction:
    """Time-lagged independent components from moments(), symmetrised."""
    mean = (s["x"] + s["y"]) / 2
    c0 = (s["xx"] + s["yy"]) / 2 - np.outer(mean, mean)
    ct = (s["xy"] + s["xy"].T) / 2 - np.outer(mean, mean)
    w = _whitening(c0, eps)
    values, dirs = np.linalg.eigh(w.T @ ct @ w)
    order = np.argsort(-np.abs(values))
    values, dirs = values[order], (w @ dirs)[:, order]
    k = int(np.searchsorted(np.cumsum(values**2) / (values**2).sum(), var_cutoff)) + 1
    dirs = dirs[:, :k] * (values[:k] if kinetic_map else 1)
    return Reduction(mean, dirs, values[:k])


def vamp(pairs: DataFrame, dims: int | None = None, eps: float = 1e-10) -> Reduction:
    """vamp_of() pairs (x, y); weights are left out."""
    return vamp_of(_sums(pairs.withColumn("weight", F.lit(1.0))), dims, eps)


def vamp_of(s: dict[str, np.ndarray], dims: int | None = None, eps: float = 1e-10) -> Reduction:
    """Left singular functions of the whitened lagged covariance, from moments()."""
    wx, wy = _whitening(s["xx"] - np.outer(s["x"], s["x"]), eps), _whitening(s["yy"] - np.outer(s["y"], s["y"]), eps)
    u, values, _ = np.linalg.svd(wx.T @ (s["xy"] - np.outer(s["x"], s["y"])) @ wy)
    k = min(dims or len(values), len(values))
    return Reduction(s["x"], (wx @ u)[:, :k], values[:k])


def identity(d: int) -> Reduction:
    return Reduction(np.zeros(d), np.eye(d), np.ones(d))


def reduction(method: str, pairs: DataFrame, **options) -> Reduction:
    """pca, sketched-pca, tica, vamp, batch-pca or none over rows (x, y, weight)."""
    if method == "none":
        return identity(len(pairs.select("x").first()[0]))
    if method == "pca":
        return pca(pairs, "x", **options)
    made: dict[str, Callable[..., Reduction]] = {"tica": tica, "vamp": vamp, "batch-pca": batch_pca}
    if method == "sketched-pca":
        return sketched_pca(pairs, "x", **options)
    if method not in made:
        raise ValueError(f"no reduction is called {method}")
    return made[method](pairs, **options)


def featurized(df: DataFrame, column: str, function: Callable[[np.ndarray], np.ndarray], name: str = "features") -> DataFrame:
    """A user's featurizer, array of coordinates in and 2-D array of features out, over Arrow batches."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(**{name: [list(map(float, v)) for v in function(np.stack(pdf[column]))] if len(pdf) else []})

    return df.mapInPandas(run, schema)
