"""What the jobs share: their command line, their log, tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

HERE = Path(__file__).resolve().parent


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"weftline.jobs.{name}")


def settings(job: str, **given) -> dict:
    """The job's config file beside its code, with the given values in place of the file's."""
    return json.loads((HERE / f"{job}.json").read_text()) | given


def found(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """The Parquet table at path, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def command_line(job: str, run: Callable[[SparkSession, dict], dict], about: str) -> None:
    """Reads the config file and the paths, makes a session, runs the job and stops the session."""
    p = argparse.ArgumentParser(description=about)
    p.add_argument("--config", default=str(HERE / f"{job}.json"), help="file of settings, JSON")
    p.add_argument("--input", required=True, help="the table to read, Parquet")
    p.add_argument("--output", required=True, help="folder of the job's tables and its mark or checkpoint")
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = json.loads(Path(args.config).read_text()) | {"input": args.input, "output": args.output}
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        run(spark, config)
    finally:
        spark.stop()
