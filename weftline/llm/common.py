"""Shared pieces of the text operators: scratch tables in the shared folder, size-checked joins, text blocks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 1_000_000

#: Rows of narrow tables that one task writes.
ROWS_A_TASK = 250_000

#: White space of the contracts: the space and the five ASCII controls of [\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset and everything is on one machine (tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            root = made.get()
        elif not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            root = tempfile.mkdtemp(prefix="weftline-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def keep(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    rows: an upper bound of its rows where known; few rows are written by few tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(rows // ROWS_A_TASK + 1)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows it has at most limit rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have: each name, with underscores in front as long as it clashes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Give freed memory back to the system; Python workers live on between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that gives back freed memory now and then, and when its task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        for k, batch in enumerate(run(batches), 1):
            yield batch
            if k % 8 == 0:
                release()
        release()

    return wrapped


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def blocks(texts: Iterable, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about size characters together; a longer text has a range of its own."""
    start, held = 0, 0
    n = 0
    for n, t in enumerate(texts, 1):
        held += len(t) if t else 0
        if held >= size:
            yield start, n
            start, held = n, 0
    if start < n:
        yield start, n
