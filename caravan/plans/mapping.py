"""The transit tables, read out of the test tables by fixed rules, and the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caravan.functions import geo

#: Interval length and the first interval's start, seconds of the day.
HOURS4, FIRST = 14400, 7200


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _place(k: Column, a: int, b: int, m: int) -> Column:
    return ((k * k * a + k * b) % m).cast("double")


def stops(spark: SparkSession, d: str) -> DataFrame:
    """part: (id, name, x, y, brand, kind, size)."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("name"), _place(k, 31, 17, 10007).alias("x"), _place(k, 57, 91, 10009).alias("y"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    """customer: (id, x, y)."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), _place(k, 13, 7, 10007).alias("x"), _place(k, 29, 3, 10009).alias("y"))


def streets(spark: SparkSession, d: str) -> DataFrame:
    """customer: (gid, line of up to 500 m, segment)."""
    k = F.col("c_custkey")
    x, y = _place(k, 13, 7, 10007), _place(k, 29, 3, 10009)
    line = F.array(geo.point(x, y), geo.point(x + k * 37 % 801 - 400, y + k * 53 % 607 - 303))
    return table(spark, d, "customer").select(k.alias("gid"), line.alias("line"), F.col("c_mktsegment").alias("segment"))


def roads(spark: SparkSession, d: str) -> DataFrame:
    """(gid, line) from each stop to the next."""
    a = stops(spark, d).select("id", geo.point("x", "y").alias("a"))
    b = a.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return a.join(b, "id").select(F.col("id").alias("gid"), F.array("a", "b").alias("line"))


def calls(spark: SparkSession, d: str, by: str = "trip_id") -> DataFrame:
    """lineitem: (trip_id, seq from 1, stop_id, q: ten times the quantity, board, alight, vehicle)."""
    # numbered by the name that steps on trips ask for: a partitioning is lost with its column's name
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias(by), F.col("l_partkey").alias("stop_id"), (F.col("l_quantity").cast("long") * 10).alias("q"),
        F.col("l_quantity").cast("long").alias("board"), F.col("l_linenumber").cast("long").alias("alight"), F.col("l_returnflag").alias("vehicle"), F.col("l_suppkey").alias("supplier"),
    )
    w = Window.partitionBy(by).orderBy("alight", "stop_id", "supplier")
    return rows.select(by if by == "trip_id" else F.col(by).alias("trip_id"), F.row_number().over(w).cast("long").alias("seq"), "stop_id", "q", "board", "alight", "vehicle", "supplier")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(trip_id, line) through the stops that a trip calls at."""
    k = F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("k")  # the order of calls(), which needs no numbers here
    at = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id"), k).join(stops(spark, d).select(F.col("id").alias("stop_id"), geo.point("x", "y").alias("p")), "stop_id")
    rows = at.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("_l"))
    return rows.select("trip_id", F.transform("_l", lambda x: x["p"]).alias("line"))


def trips(spark: SparkSession, d: str) -> DataFrame:
    """orders: (trip_id, route_id, agency, status, value, headway, start)."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("trip_id"), F.col("o_custkey").alias("route_id"), F.col("o_orderpriority").alias("agency"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"), (F.lit(300) + F.col("o_custkey") % 10 * 120).alias("headway"), (k % 5 * HOURS4 + FIRST).alias("start"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """region: (interval_id, interval_name, s, e)."""
    s = (F.col("r_regionkey") * HOURS4 + FIRST).cast("long")
    return table(spark, d, "region").select(F.col("r_regionkey").alias("interval_id"), F.col("r_name").alias("interval_name"), s.alias("s"), (s + HOURS4).alias("e"))


SQL = {
    "stops": "stops AS (SELECT p_partkey AS id, p_name AS name, CAST((p_partkey*p_partkey*31+p_partkey*17)%10007 AS DOUBLE) AS x, CAST((p_partkey*p_partkey*57+p_partkey*91)%10009 AS DOUBLE) AS y, p_brand AS brand, p_type AS kind, p_size AS size FROM part)",
    "probes": "probes AS (SELECT c_custkey AS id, CAST((c_custkey*c_custkey*13+c_custkey*7)%10007 AS DOUBLE) AS x, CAST((c_custkey*c_custkey*29+c_custkey*3)%10009 AS DOUBLE) AS y FROM customer)",
    "roads": "roads AS (SELECT a.id AS gid, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by2 FROM stops a JOIN stops b ON b.id = a.id + 1)",
    "streets": "streets AS (SELECT id AS gid, x AS ax, y AS ay, x + (id*37%801-400) AS bx, y + (id*53%607-303) AS by2, c_mktsegment AS segment FROM probes JOIN customer ON c_custkey = id)",
    "calls": "calls AS (SELECT l_orderkey AS trip_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_partkey AS stop_id, CAST(l_quantity AS BIGINT)*10 AS q, CAST(l_quantity AS BIGINT) AS board, CAST(l_linenumber AS BIGINT) AS alight, l_returnflag AS vehicle, l_suppkey AS supplier FROM lineitem)",
    "trips": "trips AS (SELECT o_orderkey AS trip_id, o_custkey AS route_id, o_orderpriority AS agency, o_orderstatus AS status, o_totalprice AS value, 300+o_custkey%10*120 AS headway, o_orderkey%5*14400+7200 AS start FROM orders)",
    "intervals": "intervals AS (SELECT r_regionkey AS interval_id, r_name AS interval_name, CAST(r_regionkey*14400+7200 AS BIGINT) AS s, CAST(r_regionkey*14400+21600 AS BIGINT) AS e FROM region)",
    "edges": "edges AS (SELECT * FROM (SELECT c.trip_id, seq, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by2 FROM calls c JOIN stops ON stop_id = id WINDOW w AS (PARTITION BY c.trip_id ORDER BY seq)) WHERE bx IS NOT NULL)",
    "runs": "runs AS (SELECT trip_id, headway, start, unnest(range(0, 14400 // headway)) AS k FROM trips)",
    "legs": "legs AS (SELECT trip_id, seq, stop_id AS gid, vehicle, CAST(sum(q) OVER (PARTITION BY trip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - q AS BIGINT) AS ts FROM calls)",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """A query with the named tables in front of it."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in names.split()) + " " + body


#: Squared length, parameter and distance of the place on edge (ax, ay)-(bx, by) nearest to (x, y), for SQL.
NEAR_T = "CASE WHEN (bx-ax)*(bx-ax)+(by2-ay)*(by2-ay) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((x-ax)*(bx-ax)+(y-ay)*(by2-ay))/((bx-ax)*(bx-ax)+(by2-ay)*(by2-ay)))) END"
NEAR_D = "sqrt((x-(ax+t*(bx-ax)))*(x-(ax+t*(bx-ax)))+(y-(ay+t*(by2-ay)))*(y-(ay+t*(by2-ay))))"
