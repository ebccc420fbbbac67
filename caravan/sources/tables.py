"""Tables of the transit store: Parquet folders that are replaced, or grown under running keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravan.operators.relational import surrogate_key


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write df as the whole table, with its own columns and types; df must not read from path."""
    df.write.mode("overwrite").parquet(path)
    return read_table(df.sparkSession, path)


def append_table(df: DataFrame, path: str) -> DataFrame:
    """Add the rows of df, cast to the table's types by name; a column that df lacks is null, one that the table lacks is an error."""
    table = read_table(df.sparkSession, path)
    more = set(df.columns) - set(table.columns)
    if more:
        raise ValueError(f"the table at {path} has no columns {sorted(more)}")
    rows = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields))
    rows.write.mode("append").parquet(path)
    return read_table(df.sparkSession, path)


def append_with_keys(df: DataFrame, path: str, order: list[str], key: str = "gid") -> DataFrame:
    """Add the rows of df under keys that go on from the table's largest, in the order given; the added rows with their keys."""
    last = read_table(df.sparkSession, path).agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).first()["m"]
    keyed = surrogate_key(df, order, key, start=last + 1)
    append_table(keyed, path)
    return keyed
