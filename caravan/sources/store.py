"""Tables that change in place: updates of the partitions concerned, loads that may be repeated, views that follow their inputs."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.operators.relational import surrogate_key
from caravan.session import remove, written


def _hadoop(spark: SparkSession, path: str):
    """The file system that Spark uses for a path, and the path in its terms."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its text unless there is one of that name; whether this call made it, of any number at once."""
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getScheme() == "file":
        final, temporary = p.toUri().getPath(), f"{p.getParent().toUri().getPath()}/.{uuid.uuid4().hex}"
        with open(temporary, "w") as f:
            f.write(text)
        try:
            os.link(temporary, final)
        except FileExistsError:
            return False
        finally:
            os.remove(temporary)
        return True
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Exception as failed:  # py4j wraps what the file system throws
        if "AlreadyExists" in str(failed):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file by a finished one, in one step where the file system can."""
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p.getParent())
    temporary = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    files = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 1)
    over[0] = getattr(files, "Options$Rename").OVERWRITE
    files.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, p, over)


def read_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names and texts of a folder's small files."""
    fs, p = _hadoop(spark, folder)
    if not fs.exists(p):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(p) if not s.isDirectory() and not s.getPath().getName().startswith(".") and not s.getPath().getName().endswith(".tmp")]
    rows = spark.read.text([f"{folder}/{n}" for n in names], wholetext=True).select("value", F.col("_metadata.file_name").alias("n")).collect() if names else []
    return {r.n: r.value for r in rows}


# --- updates --------------------------------------------------------------------------------------------------------


def write_partitioned(df: DataFrame, path: str, by: str) -> DataFrame:
    """Write df as a whole table, a folder for each value of by."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def _replace_partitions(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def update_from(spark: SparkSession, path: str, by: str, found: DataFrame, key: str, columns: Sequence[str]) -> list:
    """UPDATE table SET columns = found's FROM found WHERE the keys are equal, on a table partitioned by `by`; the values of `by`
    whose partitions were written anew.

    Only partitions with a matching row are read in full and rewritten, staged beside the table and swapped in when all of them are
    done; the files of others stay as they are. Rows of a null key match nothing; of several rows of found with a key the one with
    the smallest values counts, so a repeated update changes nothing. A null in found is set; leave such rows out to keep values.
    """
    table = spark.read.parquet(path)
    new = found.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_new")) if columns else found
    new = written(new, "updates")
    touched = [r[0] for r in table.select(key, by).join(new.select(key), key, "left_semi").select(by).distinct().collect()]
    if touched:
        same = F.col(by).isin([v for v in touched if v is not None])
        rows = table.where(same | F.col(by).isNull() if None in touched else same)
        changed = [F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in table.columns]
        staged = written(rows.join(new, key, "left").select(*changed), "staged")
        _replace_partitions(staged, path, by)
        remove(staged)
    remove(new)
    return sorted(touched, key=lambda v: (v is not None, v))


# --- loads ----------------------------------------------------------------------------------------------------------


def append_batch(df: DataFrame, path: str, batch: str, order: list[str], key: str = "gid") -> DataFrame:
    """Add the rows of df to the table at path under running keys, as the batch of that name; the batch's rows.

    A batch takes its range of keys by a file that only one load can create, and its rows go into a partition of their own, which a
    repeated load replaces by the same: loads that failed, are repeated, or run side by side add every row once, and no two rows share
    a key. Keys start at 1 and follow the order given, which should be total, within a batch; a load that never finishes leaves a
    gap. A batch that is loaded again has to have as many rows as before.
    """
    spark = df.sparkSession
    n, folder = df.count(), f"{path}/_batches"
    while True:
        known = [json.loads(x) for _, x in sorted(read_files(spark, folder).items())]
        mine = next((x for x in known if x["batch"] == batch), None)
        if mine:
            break
        last = known[-1] if known else {"start": 1, "rows": 0}
        claim(spark, f"{folder}/{len(known):09d}", json.dumps({"batch": batch, "start": last["start"] + last["rows"], "rows": n}))
    if mine["rows"] != n:
        raise ValueError(f"batch {batch} was loaded with {mine['rows']} rows, not {n}")
    keyed = surrogate_key(df, order, key, start=mine["start"]).withColumn("batch", F.lit(batch))
    _replace_partitions(keyed, path, "batch")
    remove(keyed)
    return spark.read.parquet(path).where(F.col("batch") == batch)


# --- views ----------------------------------------------------------------------------------------------------------


@dataclass
class View:
    """A stored query: make gets its inputs' tables in the order given; inputs are names of views or of tables."""

    name: str
    inputs: Sequence[str]
    make: Callable[..., DataFrame]


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash over names, sizes and times of a table's files; no file is read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    except AnalysisException:
        return "absent"
    row = files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0)).alias("h")).first()
    return f"{row.n}-{row.h & (1 << 64) - 1:x}"


def refresh(spark: SparkSession, views: Sequence[View], tables: dict[str, str], folder: str) -> list[str]:
    """Write anew the views under folder whose inputs have changed since they were written; their names, inputs before dependents.

    tables: paths by name. A view is written to a new place and takes effect with the record of its place and of its inputs'
    fingerprints, so that a reader sees the old rows or the new ones; a failed refresh leaves the old ones.
    """
    done, waiting, paths = [], list(views), dict(tables)
    while waiting:
        ready = [v for v in waiting if all(i in paths for i in v.inputs)]
        if not ready:
            raise ValueError(f"views {sorted(v.name for v in waiting)} have unknown inputs or depend on each other")
        for view in ready:
            record, prints = read_files(spark, f"{folder}/_views").get(view.name), {i: fingerprint(spark, paths[i]) for i in view.inputs}
            old = json.loads(record) if record else {}
            if old.get("inputs") != prints:
                place = f"{folder}/{view.name}-{time.time_ns():x}"
                view.make(*(spark.read.parquet(paths[i]) for i in view.inputs)).write.parquet(place)
                replace_file(spark, f"{folder}/_views/{view.name}", json.dumps({"inputs": prints, "place": place}))
                if old:
                    fs, p = _hadoop(spark, old["place"])
                    fs.delete(p, True)
                old = {"place": place}
                done.append(view.name)
            paths[view.name] = old["place"]
        waiting = [v for v in waiting if v not in ready]
    return done


def read_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view as it was last refreshed."""
    return spark.read.parquet(json.loads(read_files(spark, f"{folder}/_views")[name])["place"])
