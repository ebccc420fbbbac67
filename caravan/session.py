"""What a session needs: workers that can import this package, and a shared folder for written steps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished step are of no use once its table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
REPOSITORY = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; clusters ship it with --py-files."""
    environment = spark.sparkContext.environment
    paths = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if REPOSITORY not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([REPOSITORY, *paths])


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which the driver and all executors see.

    Only where that setting is absent and the session is local does a temporary folder take its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/caravan-checkpoints"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: later steps survive lost executors, and the plan starts anew.

    The step's shuffle files go when it is written; remove() deletes the table when nothing reads it any more.
    """
    path, conf = work_dir(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(*steps: DataFrame) -> None:
    """Delete tables of written() whose results are written themselves; others are left alone."""
    for step in steps:
        if path := getattr(step, "written_to", None):
            p = step.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
