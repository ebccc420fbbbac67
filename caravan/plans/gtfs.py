"""The nine tables of a GTFS feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravan.functions import geo, times
from caravan.operators import relational as R

#: Metres a second where no travel time is known; seconds at a stop.
STATIC_SPEED, DWELL = 10, 15
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def period(rows: DataFrame, column: str) -> DataFrame:
    """One row (start, end): the first and the last day of a column of times, as numbers YYYYMMDD; null without any."""
    day = lambda c: F.date_format(c, "yyyyMMdd").cast("int")
    return rows.agg(day(F.min(column)).alias("start"), day(F.max(column)).alias("end"))


def feed_info(period: DataFrame, name: str, url: str, version: str | None = None, lang: str = "en") -> DataFrame:
    """The feed's one row, over a period(start, end)."""
    return period.select(F.lit(name).alias("feed_publisher_name"), F.lit(url).alias("feed_publisher_url"), F.col("start").alias("feed_start_date"), F.col("end").alias("feed_end_date"), F.lit(version or name).alias("feed_version"), F.lit(lang).alias("feed_lang"))


def agency(agencies: DataFrame) -> DataFrame:
    return agencies.select("agency_id", "agency_name", "agency_url", "agency_timezone")


def calendar(period: DataFrame) -> DataFrame:
    """Two services over a period(start, end): every day, and Sunday to Thursday."""

    def service(name: str, days: list[str]) -> Column:
        return F.struct(F.lit(name).alias("service_id"), *(F.lit(int(d in days)).alias(d) for d in DAYS))

    both = F.array(service("Ground_Daily", DAYS), service("Ground_Sun_Thu", [d for d in DAYS if d not in ("friday", "saturday")]))
    return period.select(F.explode(both).alias("s"), F.col("start").alias("start_date"), F.col("end").alias("end_date")).select("s.*", "start_date", "end_date")


def frequencies(trips_intervals: DataFrame, trips: DataFrame, intervals: DataFrame) -> DataFrame:
    """trips_intervals(trip_gid, interval_id, headway_secs), trips(gid, trip_id), intervals(interval_id, start_time, end_time).

    Rows without a headway go: a feed can't state them.
    """
    rows = trips_intervals.where("headway_secs is not null").join(trips.select(F.col("gid").alias("trip_gid"), "trip_id"), "trip_gid").join(R.few(intervals), "interval_id", "left")
    return rows.select("trip_id", "start_time", "end_time", F.col("headway_secs").cast("int").alias("headway_secs"))


def routes(trips: DataFrame, continuous: bool = False) -> DataFrame:
    """The first trip of each route."""
    more = ["continuous_pickup", "continuous_drop_off"] if continuous else []
    return R.first_by(trips, ["route_id"], ["gid"]).select("route_id", "agency_id", F.col("route_long").alias("route_long_name"), F.col("route_short").alias("route_short_name"), "route_type", *more)


def shapes(trips: DataFrame) -> DataFrame:
    """Vertices of trips(trip_id, line), numbered from 1."""
    rows = trips.select(F.concat(F.col("trip_id").cast("string"), F.lit("_Shape")).alias("shape_id"), F.posexplode("line").alias("at", "p"))
    return rows.select("shape_id", F.col("p.y").alias("shape_pt_lat"), F.col("p.x").alias("shape_pt_lon"), (F.col("at") + 1).alias("shape_pt_sequence"))


def stops(rows: DataFrame) -> DataFrame:
    """stops(stop_id, stop_name, point) that have a place."""
    return rows.where("point is not null").select("stop_id", "stop_name", F.col("point.y").alias("stop_lat"), F.col("point.x").alias("stop_lon"))


def trips(rows: DataFrame) -> DataFrame:
    """The first row of each trip; its headsign is the destination."""
    text = F.col("trip_id").cast("string")
    return R.first_by(rows, ["trip_id"], ["gid"]).select("route_id", "service_id", F.col("destination").alias("trip_headsign"), "direction_id", F.concat(text, F.lit("_Shape")).alias("shape_id"), text.alias("trip_id"))


def complete_od(travel: DataFrame, by_vehicle: bool = True) -> DataFrame:
    """travel with a row for each stop pair in each interval, of each vehicle, that its pairs have rows in. A vehicle that isn't known
    is one of its own, so known durations of such rows stay."""
    pair = F.concat_ws("-", F.col("o_id").cast("string"), F.col("d_id").cast("string")).alias("_pair")
    keys = ["interval_id", *(["vehicle_name"] if by_vehicle else [])]
    wanted = travel.select(pair, *keys).distinct().join(travel.select(pair, "o_id", "d_id").distinct(), "_pair").drop("_pair")
    every = ["o_id", "d_id", *keys]
    known = travel.withColumnsRenamed({c: f"_{c}" for c in every})
    on = F.lit(True)
    for c in every:
        on = on & wanted[c].eqNullSafe(known[f"_{c}"])
    return wanted.join(known, on, "left").drop(*(f"_{c}" for c in every))


def estimate_missing_times(travel: DataFrame, by_vehicle: bool = True, lengths: DataFrame | None = None) -> DataFrame:
    """Missing durations of travel(o_id, d_id, interval_id, vehicle_name, duration) take the mean of their stop pair."""
    keys = ["o_id", "d_id", *(["vehicle_name"] if by_vehicle else [])]
    whole = complete_od(travel, by_vehicle)
    rows = whole if lengths is None else whole.join(lengths.select("o_id", "d_id", "length_m"), ["o_id", "d_id"], "left")
    return R.mean_impute(rows, "duration", keys)


def leg_seconds(sequence: DataFrame, travel: DataFrame, interval_id, fan_out: bool = False) -> DataFrame:
    """(trip_id, stop_id, stop_sequence, duration) of sequence(trip_id, stop_id, stop_sequence, distance, vehicle_name): the seconds from
    the stop before.

    travel(o_id, d_id, interval_id, vehicle_name, duration): a leg's mean duration in the given interval; with fan_out, every row
    of it, as joined tables would. Legs without one take length / 10 seconds, rounded up; the first stop none.
    """
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    legs = sequence.withColumn("from_id", F.lag("stop_id").over(w)).withColumn("length", F.coalesce(F.col("distance") - F.lag("distance").over(w), F.lit(0.0)))
    known = travel.where(F.col("interval_id") == interval_id).select(F.col("o_id").alias("from_id"), F.col("d_id").alias("stop_id"), "vehicle_name", F.col("duration").cast("double").alias("_d"))
    known = known if fan_out else known.groupBy("from_id", "stop_id", "vehicle_name").agg(F.avg("_d").alias("_d"))
    timed = legs.select("trip_id", "stop_id", "stop_sequence", "from_id", "vehicle_name", "length").join(known, ["from_id", "stop_id", "vehicle_name"], "left")
    seconds = F.when(F.col("_d").isNotNull(), F.col("_d")).when(F.col("stop_sequence") != 1, F.ceil(F.col("length") / STATIC_SPEED).cast("double")).otherwise(F.lit(0.0))
    return timed.select("trip_id", "stop_id", "stop_sequence", seconds.alias("duration"))


def arrivals(legs: DataFrame, start: int, dwell: int = DWELL) -> DataFrame:
    """legs(trip_id, stop_sequence, duration, ...) with arrival, in seconds of the day."""
    total = R.running_sum("duration", ["trip_id"], ["stop_sequence"])
    return legs.withColumn("arrival", F.floor(total) + F.lit(start) + (F.col("stop_sequence") - 1) * dwell)


def stop_times(sequence: DataFrame, travel: DataFrame, interval_id, start: int, dwell: int = DWELL, wrap: bool = False, fan_out: bool = False) -> DataFrame:
    """Arrivals and departures of sequence(trip_id, stop_id, stop_sequence, distance, vehicle_name), by leg_seconds(). Hours pass 24
    unless wrapped."""
    rows = arrivals(leg_seconds(sequence, travel, interval_id, fan_out), start, dwell)
    return rows.select("trip_id", "stop_id", "stop_sequence", times.format_hms(F.col("arrival"), wrap).alias("arrival_time"), times.format_hms(F.col("arrival") + dwell, wrap).alias("departure_time"))


def trip_lines(shape_points: DataFrame) -> DataFrame:
    """Lines of shapes(shape_id, shape_pt_sequence, shape_pt_lon, shape_pt_lat) on the projected plane."""
    p = F.struct("shape_pt_sequence", geo.mercator(geo.point("shape_pt_lon", "shape_pt_lat")).alias("p"))
    rows = shape_points.groupBy("shape_id").agg(F.array_sort(F.collect_list(p)).alias("_p"))
    return rows.select("shape_id", F.transform("_p", lambda x: x["p"]).alias("line"))


def feed_trip_lines(trips: DataFrame, routes: DataFrame, shape_points: DataFrame) -> DataFrame:
    """Trips of a feed with their route's agency and their shape's line on the projected plane; those without either stay."""
    agencies = R.first_by(routes, ["route_id"], ["agency_id"]).select("route_id", "agency_id")
    return trips.join(agencies, "route_id", "left").join(trip_lines(shape_points), "shape_id", "left")


def boundary(stop_points: DataFrame, margin: float = 0.01) -> DataFrame:
    """struct box around stops(stop_lon, stop_lat), widened by a margin in degrees."""
    return stop_points.agg((F.min("stop_lon") - margin).alias("x1"), (F.min("stop_lat") - margin).alias("y1"), (F.max("stop_lon") + margin).alias("x2"), (F.max("stop_lat") + margin).alias("y2"))
