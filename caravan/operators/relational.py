"""Relational operators that transit pipelines keep needing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravan.session import written

Order = list


def fill_forward_back(df: DataFrame, column: str, by: list[str], order: list[str]) -> DataFrame:
    """Nulls take the last value before them within by, else the first after them."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(column, F.coalesce(before, after))


def mean_impute(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Nulls take the mean of their group: the means are a map-side combined aggregate, joined back."""
    keys = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    means = df.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.avg(column).alias("_mean"))
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    return df.join(means, on, "left").withColumn(column, F.coalesce(F.col(column).cast("double"), "_mean")).drop("_mean", *(f"_{c}" for c in by))


def ceil_mean_impute(df: DataFrame, column: str) -> DataFrame:
    """Nulls take the ceiling of the mean of the whole column."""
    mean = df.agg(F.ceil(F.avg(column)).cast("double").alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(column, F.coalesce(F.col(column).cast("double"), "_mean")).drop("_mean")


def mode_by(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """The most frequent non-null value in each group; of equally frequent ones the smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_m")).select(*by, F.col("_m.v").alias(name))


def top_k(df: DataFrame, k: int, by: list[str], order: Order) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a group before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def first_by(df: DataFrame, by: list[str], order: Order) -> DataFrame:
    return top_k(df, 1, by, order)


def interval_join(facts: DataFrame, intervals: DataFrame, value: Column, start: str, end: str, inclusive: bool) -> DataFrame:
    """Facts with every interval that holds the value. A stream's intervals go to every task; other tables of intervals do if few."""
    low, high = F.col(start), F.col(end)
    on = (value >= low) & (value <= high) if inclusive else (value > low) & (value < high)
    return facts.join(F.broadcast(intervals) if facts.isStreaming else few(intervals), on)


#: Rows, and bytes of their text form, of a table up to which it is sent to every task.
FEW, SMALL = 100_000, 16_000_000


def few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is measured to be small, by a reading that stops beyond FEW rows; a join shuffles or sorts otherwise."""
    row = df.limit(FEW + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if row["n"] <= FEW and row["b"] <= SMALL else df


def surrogate_key(df: DataFrame, order: list[str], name: str = "gid", start: int = 1) -> DataFrame:
    """A gapless number from start in the order given, without sorting in one task.

    Rows are range-partitioned, numbered within their partition and written with both numbers, so that what is counted is what is
    numbered; the partitions' counts, one row each, are added up.
    """
    spark = df.sparkSession
    place = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", *place), "numbered")
    before, offsets = start, []
    for part, n in sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        offsets.append((part, before))
        before += n
    base = spark.createDataFrame(offsets, "_part int, _before long")
    return placed.join(F.broadcast(base), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def pivot_fill(df: DataFrame, by: list[str], pivot: str, values: list, column: str) -> DataFrame:
    """Mean of a column for each group and each of the given values of pivot, 0 where there is none."""
    return df.groupBy(*by).pivot(pivot, values).agg(F.avg(column)).na.fill(0, subset=list(map(str, values)))


def lag_across_groups(df: DataFrame, group: str, order: list[str], column: str, name: str, number: str | None = None, keep=None, firsts: bool = False) -> DataFrame:
    """lag(column) over the order (group, *order), not partitioned: a group's first row sees the last row of the group before.

    With number, such a column has a row's number in its group. keep(value, before), a condition, says which rows are wanted: others
    are numbered and seen, but not written unless they begin or end a group. With firsts, groups' first rows are what is asked for, kept or not.

    Rows are sorted once, within groups, and written; groups are then range-partitioned and written with their partition's number, so
    that a group's predecessor is in its partition or ends the one before. Only the groups' first rows meet what they carry, and one row
    a partition meets in the step that links partitions.
    """
    spark = df.sparkSession
    w = Window.partitionBy(group).orderBy(*order)
    at = number or "_number"
    rows = df.where(F.col(group).isNotNull()).withColumn("_within", F.lag(column).over(w)).withColumn(at, F.row_number().over(w)).withColumn("_ends", F.lead(F.lit(True)).over(w).isNull())
    if keep is not None:
        rows = rows.where((F.col(at) == 1) | F.col("_ends") | keep(F.col(column), F.col("_within")))
    rows = written(rows, "lagged")
    last = rows.where("_ends").select(group, F.struct(F.col(column).alias("v")).alias("_last"))
    placed = written(last.repartitionByRange(group).select("*", F.spark_partition_id().alias("_part")), "ends")
    ends = sorted((r["_part"], r["_end"]) for r in placed.groupBy("_part").agg(F.max_by("_last", group).alias("_end")).collect())
    kind = df.schema[column].dataType.simpleString()
    carried = [(part, end) for (part, _), (_, end) in zip(ends[1:], ends, strict=False)]
    base = spark.createDataFrame(carried, f"_part int, _from struct<v:{kind}>")
    within = F.lag("_last").over(Window.partitionBy("_part").orderBy(group))
    linked = placed.withColumn("_own", within).join(F.broadcast(base), "_part", "left").select(group, F.coalesce("_own", "_from")["v"].alias(name))
    begun = rows.where(F.col(at) == 1).join(linked, group)
    if firsts:
        return begun.drop("_within", "_ends", *([] if number else [at]))
    out = begun.unionByName(rows.where(F.col(at) > 1).withColumn(name, F.col("_within")))
    out = out.drop("_within", "_ends", *([] if number else [at]))
    return out if keep is None else out.where(keep(F.col(column), F.col(name)))


def running_sum(column: str, by: list[str], order: Order) -> Column:
    return F.sum(column).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def not_test(column: str, word: str = "test") -> Column:
    """Names without a word, in any case."""
    return ~F.lower(F.col(column)).contains(word)


def blank_to_null(column: str) -> Column:
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def where_late(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on costly columns, without the optimizer computing those columns once more for the filter."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where(condition & (F.col("_row") >= 0)).drop("_row")
