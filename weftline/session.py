"""What a session needs before Python code of this package can run on its executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch where the session leaves Spark's default: texts are long, and a batch is held several times.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS, DEFAULT = 1000, "10000"


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that is not there yet, under the one that spark.checkpoint.dir names and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            root = made.get()
        elif spark.sparkContext.master.startswith("local["):
            root = tempfile.mkdtemp(prefix="weftline-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root.rstrip('/')}/weftline/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder, removed when the interpreter ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's executors, once for each application, and keep Arrow batches small."""
    if spark.conf.get(BATCH, DEFAULT) == DEFAULT:
        spark.conf.set(BATCH, ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="weftline-"), "weftline.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark
