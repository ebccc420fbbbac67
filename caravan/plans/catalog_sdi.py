"""Queries for the transit store's sinks, its extract and the survey steps, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravan.functions import geo, kernels, spheroid, times
from caravan.operators import relational as R
from caravan.operators import spatial as S
from caravan.plans import catalog as C
from caravan.plans import extract, gtfs, migrate
from caravan.plans import mapping as M
from caravan.session import work_dir, written
from caravan.sources import gtfs as gtfs_files
from caravan.sources import tables

query = C.query


# --- sinks ----------------------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY n_name) AS gid, n_name AS name, CAST(n_regionkey AS BIGINT) AS vehicle_id FROM nation UNION ALL SELECT (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY c_name), c_name, NULL FROM customer")
def append_agencies(spark, d):
    """A table of agencies, and a second load under keys that go on from the first one's."""
    path = work_dir(spark, "agencies")
    first = M.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("vehicle_id"))
    tables.replace_table(R.surrogate_key(first, ["name"]).select("gid", "name", "vehicle_id"), path)
    tables.append_with_keys(M.table(spark, d, "customer").select(F.col("c_name").alias("name")), path, ["name"])
    return tables.read_table(spark, path)


@query("SELECT r_regionkey + 1 AS gid, r_name AS name, CAST(r_regionkey * 14400 + 7200 AS BIGINT) AS start_time, true AS active FROM region")
def replace_intervals(spark, d):
    """A table written twice holds the second load alone, with its columns and types."""
    path = work_dir(spark, "intervals")
    tables.replace_table(M.table(spark, d, "nation").select("n_name"), path)
    rows = M.intervals(spark, d).select(F.col("interval_name").alias("name"), F.col("s").alias("start_time"), F.lit(True).alias("active"), "interval_id")
    return tables.replace_table(R.surrogate_key(rows, ["interval_id"]).select(F.col("gid").cast("int").alias("gid"), "name", "start_time", "active"), path)


@query(M.sql("trips intervals", "SELECT trip_id, interval_id, headway FROM trips JOIN intervals ON interval_id = trip_id % 5 UNION ALL SELECT trip_id, NULL, headway * 2 FROM trips WHERE status = 'O'"))
def append_trips_intervals(spark, d):
    path, trips = work_dir(spark, "trips_intervals"), M.trips(spark, d)
    tables.replace_table(trips.withColumn("interval_id", (F.col("trip_id") % 5).cast("int")).select("trip_id", "interval_id", "headway"), path)
    return tables.append_table(trips.where("status = 'O'").select((F.col("headway") * 2).alias("headway"), "trip_id"), path)


@query(M.sql("stops", "SELECT row_number() OVER (ORDER BY id) AS gid, CAST(row_number() OVER (ORDER BY id) AS VARCHAR) AS stop_id, name AS stop_name, round(degrees(x / 6378137.0), 9) AS stop_lon, round(degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2), 9) AS stop_lat FROM stops"))
def stops_table(spark, d):
    rows = M.stops(spark, d).select(F.col("id").alias("cluster"), F.col("name").alias("stop_name"), F.lit("").alias("stop_desc"), F.lit(0).alias("location_type"), F.lit(0).alias("double"), geo.point("x", "y").alias("geom"))
    return migrate.stops_table(rows).select("gid", "stop_id", "stop_name", F.round("stop_lon", 9).alias("stop_lon"), F.round("stop_lat", 9).alias("stop_lat"))


@query(M.sql("stops", "SELECT CAST(id AS VARCHAR) AS stop_id, name AS stop_name, y AS stop_lat, x AS stop_lon FROM stops WHERE size % 9 <> 0"))
def csv_tables(spark, d):
    """A feed's table as CSV parts, read back with a schema."""
    folder = work_dir(spark, "csv")
    gtfs_files.write_tables({"stops.txt": C.gtfs_stops(spark, d)}, folder)
    return gtfs_files.read_table(spark, f"{folder}/stops.txt", gtfs_files.SCHEMAS["stops.txt"])


# --- extract --------------------------------------------------------------------------------------------------------


def _store(spark, d):
    """A transit store: agencies are customers, vehicles regions, trips orders."""
    customers = M.table(spark, d, "customer")
    agencies = customers.select(F.col("c_custkey").alias("gid"), F.col("c_name").alias("agency_id"), F.col("c_nationkey").alias("vehicle_id"), (F.col("c_acctbal") > 0).alias("has_serial"))
    vehicles = M.table(spark, d, "region").select(F.col("r_regionkey").alias("gid"), F.col("r_name").alias("name"))
    calls = M.calls(spark, d)
    line = F.when(F.col("status") == "F", F.array(geo.point(F.col("trip_id"), F.col("route_id")), geo.point(F.col("route_id"), F.col("trip_id"))))
    line = F.when(F.col("status") == "P", F.array().cast(geo.LINE)).otherwise(line)
    trips = M.trips(spark, d).join(agencies.select(F.col("gid").alias("route_id"), "agency_id"), "route_id").select("trip_id", "agency_id", "route_id", line.alias("geom"))
    return {
        "agencies": agencies, "vehicles": vehicles, "stops": M.stops(spark, d), "trips_view": trips, "terminals": M.table(spark, d, "supplier"),
        "intervals": M.intervals(spark, d).select(F.col("interval_id").alias("gid"), "interval_name", F.col("interval_name").startswith("A").alias("active")),
        "trips_intervals": M.trips(spark, d).select("trip_id", (F.col("trip_id") % 5).cast("int").alias("interval_id"), "headway"),
        "trip_stops_sequence": calls.select(F.col("seq").alias("gid"), "trip_id", "stop_id", "seq"),
        "od_stats": calls.select(F.col("stop_id").alias("o_id"), F.col("supplier").alias("d_id"), F.lit(1).alias("interval_id"), F.lit(0).alias("interval_start"), F.col("q").alias("duration"), F.col("vehicle").alias("vehicle_name"), F.lit(1.0).alias("speed")),
    }


@query("SELECT c_custkey AS gid, c_name AS agency_id, c_nationkey AS vehicle_id, c_acctbal > 0 AS has_serial, r_name AS vehicle_name FROM customer LEFT JOIN region ON r_regionkey = c_nationkey")
def extract_agency(spark, d):
    return extract.extract(_store(spark, d))["agency"]


@query(M.sql("trips", "SELECT trip_id, c_name AS agency_id, route_id, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS continuous_pickup, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS continuous_drop_off FROM trips JOIN customer ON c_custkey = route_id WHERE status = 'F'"))
def extract_trips(spark, d):
    return extract.extract(_store(spark, d))["trips"].drop("geom")


@query(M.sql("trips intervals", "SELECT interval_id, trip_id, headway FROM trips JOIN intervals ON interval_id = trip_id % 5 WHERE interval_name LIKE 'A%'"))
def extract_frequencies(spark, d):
    return extract.extract(_store(spark, d))["frequencies"]


@query(M.sql("stops calls trips intervals", "SELECT 'agency' AS name, (SELECT count(*) FROM customer) AS n, 5 AS columns UNION ALL SELECT 'stops', (SELECT count(*) FROM stops), 7 UNION ALL SELECT 'trips', (SELECT count(*) FROM trips JOIN customer ON c_custkey = route_id WHERE status = 'F'), 6 UNION ALL SELECT 'terminals', (SELECT count(*) FROM supplier), (SELECT count(*) FROM (DESCRIBE supplier)) UNION ALL SELECT 'intervals', (SELECT count(*) FROM intervals WHERE interval_name LIKE 'A%'), 3 UNION ALL SELECT 'frequencies', (SELECT count(*) FROM trips JOIN intervals ON interval_id = trip_id % 5 WHERE interval_name LIKE 'A%'), 3 UNION ALL SELECT 'trip_stop_sequence', (SELECT count(*) FROM calls), 3 UNION ALL SELECT 'travel_times_trackpoints', (SELECT count(*) FROM calls), 6"))
def extract_sdi(spark, d):
    """The eight tables, written and read back: their rows and numbers of columns."""
    folder, found = work_dir(spark, "extract"), extract.extract(_store(spark, d))
    extract.write_extract(found, folder)
    out = None
    for name in found:
        table = tables.read_table(spark, f"{folder}/{name}")
        row = table.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(len(table.columns)).alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


# --- survey steps ---------------------------------------------------------------------------------------------------


@query(M.sql("stops roads probes", f", {C.SEQ} SELECT trip_id, stop_id, seq AS stop_sequence, r_name AS vehicle_name FROM sq LEFT JOIN nation ON n_nationkey = trip_id % 40 LEFT JOIN region ON r_regionkey = n_regionkey + 1"))
def sequence_with_vehicles(spark, d):
    roads = M.roads(spark, d).withColumnRenamed("gid", "trip_id").withColumn("agency_id", (F.col("trip_id") % 40).cast("int"))
    agencies = M.table(spark, d, "nation").select(F.col("n_nationkey").alias("agency_id"), (F.col("n_regionkey") + 1).alias("vehicle_id"))
    vehicles = M.table(spark, d, "region").select(F.col("r_regionkey").alias("gid"), F.col("r_name").alias("name"))
    stops = C._probes(spark, d).withColumnRenamed("id", "stop_id")
    found = migrate.trip_stops_sequence(stops, roads, reach=10.0, agencies=agencies, vehicles=vehicles)
    return found.select("trip_id", "stop_id", F.col("stop_sequence").cast("long").alias("stop_sequence"), "vehicle_name")


#: Where and when surveyed vehicles were: events, some metres off a stop; instances are the events' users.
TRACK = "track AS (SELECT event_id AS id, user_id AS instance_id, epoch_us(ts) // 1000000 AS time, x + event_id % 57 - 28 AS px, y + event_id % 41 - 20 AS py FROM events JOIN probes ON probes.id = event_id * 31 % (SELECT count(*) FROM customer)), inst AS (SELECT c_custkey AS id, c_nationkey AS trip_id FROM customer WHERE c_mktsegment <> 'HOUSEHOLD' AND c_acctbal > -500)"
VISITS = "visit AS (SELECT instance_id, probes.id AS stop_id, max(time) AS time, min(trip_id) AS trip_id FROM track JOIN inst ON inst.id = instance_id JOIN probes ON probes.x BETWEEN px - 30 AND px + 30 AND sqrt((px-probes.x)*(px-probes.x)+(py-probes.y)*(py-probes.y)) <= 30 GROUP BY ALL)"


def _visits(spark, d, at=None):
    """Visits of stops, or of those whose stop_id is among at's."""
    n = M.table(spark, d, "customer").agg(F.count("*").alias("n"))
    events = M.table(spark, d, "events").crossJoin(F.broadcast(n)).withColumn("at", F.col("event_id") * 31 % F.col("n"))
    moved = geo.point(F.col("x") + F.col("event_id") % 57 - 28, F.col("y") + F.col("event_id") % 41 - 20)
    points = events.join(M.probes(spark, d).withColumnRenamed("id", "at"), "at").select(F.col("event_id").alias("id"), F.col("user_id").alias("instance_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), moved.alias("point"))
    instances = M.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "open").otherwise("finished").alias("status"), (F.col("c_acctbal") > -500).alias("valid"), F.col("c_nationkey").alias("trip_id"), F.lit("Bus").alias("vehicle_name"))
    stops = C._probes(spark, d).withColumnRenamed("id", "stop_id")
    return migrate.stop_visits(points, instances, stops if at is None else stops.join(at, "stop_id", "left_semi"))


@query(M.sql("probes", f", {TRACK}, {VISITS} SELECT instance_id, stop_id, time, trip_id FROM visit"))
def stop_visits_30m(spark, d):
    return _visits(spark, d).select("instance_id", "stop_id", "time", "trip_id")


@query(M.sql("stops roads probes intervals", f""", {C.SEQ}, {TRACK}, {VISITS}, seg AS (SELECT o_id, d_id, avg(dd) AS dist FROM (SELECT stop_id AS o_id, lead(stop_id) OVER w AS d_id, lead(dist) OVER w - dist AS dd FROM sq WHERE t < 1 WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) WHERE d_id IS NOT NULL GROUP BY ALL),
pairs AS (SELECT seg.o_id, seg.d_id, d.time - o.time AS secs, o.time % 86400 AS tod FROM seg JOIN visit o ON o.stop_id = seg.o_id JOIN visit d ON d.stop_id = seg.d_id AND d.instance_id = o.instance_id WHERE d.time > o.time),
dur AS (SELECT o_id, d_id, interval_id, CAST(round(avg(secs)) AS INTEGER) AS duration FROM pairs JOIN intervals ON tod BETWEEN s AND e GROUP BY o_id, d_id, interval_id)
SELECT seg.o_id, seg.d_id, interval_id, duration, round(dist / duration * 3.6, 5) AS speed FROM seg JOIN dur ON seg.o_id = dur.o_id AND seg.d_id = dur.d_id"""))
def od_stats_trackpoints(spark, d):
    """Speeds between stops from trackpoints within 30 m of them."""
    segments = written(migrate.od_segments(C._sequence(spark, d).withColumn("vehicle_name", F.lit("Bus"))), "segments")
    # visits of other stops, whose number grows with the product of both tables, aren't made
    at = segments.select(F.explode(F.array("o_id", "d_id")).alias("stop_id")).distinct()
    durations = migrate.od_durations(_visits(spark, d, at), segments, M.intervals(spark, d).withColumn("active", F.lit(True)))
    return migrate.od_stats(segments, durations).select("o_id", "d_id", "interval_id", "duration", F.round("speed", 5).alias("speed"))


@query(M.sql("calls", ", t AS (SELECT stop_id % 40 AS o_id, supplier % 40 AS d_id, seq % 3 AS interval_id, vehicle AS vehicle_name, CASE WHEN board > 5 THEN q END AS duration FROM calls) SELECT o_id, d_id, interval_id, vehicle_name, count(*) AS n, round(sum(coalesce(duration, m)), 4) AS total FROM (SELECT *, avg(duration) OVER (PARTITION BY o_id, d_id, vehicle_name) AS m FROM t) GROUP BY ALL"))
def estimate_missing_times(spark, d):
    rows = M.calls(spark, d).select((F.col("stop_id") % 40).alias("o_id"), (F.col("supplier") % 40).alias("d_id"), (F.col("seq") % 3).alias("interval_id"), F.col("vehicle").alias("vehicle_name"), F.when(F.col("board") > 5, F.col("q")).alias("duration"))
    found = gtfs.estimate_missing_times(rows)
    return found.groupBy("o_id", "d_id", "interval_id", "vehicle_name").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("total"))


@query("SELECT c_custkey AS observer_id, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS created_at FROM customer")
def stops_created_at(spark, d):
    rows = M.table(spark, d, "customer").withColumnRenamed("c_custkey", "observer_id")
    return migrate.stops_with_time(rows.select("observer_id", F.col("c_name").alias("name")), rows.where("c_acctbal > 0").select("observer_id", F.col("c_acctbal").alias("created_at")))


@query("SELECT row_number() OVER (ORDER BY r_regionkey DESC) AS nth, r_name AS name FROM region WHERE r_regionkey <> 2")
def active_intervals(spark, d):
    rows = M.table(spark, d, "region").select(F.col("r_name").alias("name"), (-F.col("r_regionkey")).alias("start_time"), (F.col("r_regionkey") != 2).alias("active"))
    return R.surrogate_key(migrate.active_intervals(rows), ["start_time"], "nth").select("nth", "name")


@query(M.sql("roads", "SELECT gid, n_name AS agency, n_regionkey AS vehicle_id FROM roads JOIN nation ON n_nationkey = gid % 40 WHERE NOT (ax = bx AND ay = by2)").replace("WITH roads", "WITH " + M.SQL["stops"] + ", roads"))
def onboard_instances(spark, d):
    names = M.table(spark, d, "nation")
    rows = M.roads(spark, d).withColumn("n_nationkey", (F.col("gid") % 40).cast("int")).join(names.select("n_nationkey", F.col("n_name").alias("agency")), "n_nationkey").select("gid", "agency", F.col("line").alias("geom"))
    return migrate.onboard_instances(rows, names.select(F.col("n_name").alias("agency_id"), F.col("n_regionkey").alias("vehicle_id"))).select("gid", "agency", "vehicle_id")


@query("SELECT c_custkey AS observer_id, c_name AS name, c_acctbal AS x FROM customer WHERE c_mktsegment = 'BUILDING'")
def reattach_geometry(spark, d):
    rows = M.table(spark, d, "customer").select(F.col("c_custkey").alias("observer_id"), F.col("c_name").alias("name"), "c_acctbal", "c_mktsegment")
    twice = rows.select("observer_id", "name", F.lit(None).cast(geo.LINE).alias("geom"))
    found = migrate.reattach_geometry(twice.unionByName(twice), rows.where("c_mktsegment = 'BUILDING'").select("observer_id", F.array(geo.point(F.col("c_acctbal"), F.lit(0))).alias("geom")))
    return found.select("observer_id", "name", F.get("geom", F.lit(0))["x"].alias("x"))


# --- geometry and times ---------------------------------------------------------------------------------------------


@query(M.sql("stops roads", "SELECT gid, ax, ay, bx, by2, 'LINESTRING' AS kind FROM roads UNION ALL SELECT -gid, ax, ay, NULL, NULL, 'POINT' FROM roads"))
def wkb_and_wkt(spark, d):
    """Lines through WKB, points through WKT, and the types that texts name."""
    roads = M.roads(spark, d)
    lines = roads.select("gid", kernels.from_wkb(kernels.to_wkb(F.col("line"))).alias("g"), geo.geometry_type(geo.to_wkt(F.col("line"))).alias("kind"))
    p = F.get("line", F.lit(0))
    text = F.concat(F.lit("SRID=4326;POINT("), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(")"))
    points = roads.select((-F.col("gid")).alias("gid"), geo.from_wkt(text).alias("g"), geo.geometry_type(text).alias("kind"))
    at = lambda i, c: F.get("g", F.lit(i))[c]
    return lines.unionByName(points).select("gid", at(0, "x").alias("ax"), at(0, "y").alias("ay"), at(1, "x").alias("bx"), at(1, "y").alias("by2"), "kind")


@query(M.sql("stops roads", "SELECT gid, 3 AS vertices, ax AS x1, ay AS y1 FROM roads WHERE NOT (ax = bx AND ay = by2)"))
def single_lines(spark, d):
    """Two halves of a road, the second one reversed, are one line again; a far short part goes."""
    a, b = F.get("line", F.lit(0)), F.get("line", F.lit(1))
    middle = geo.on_edge(a, b, F.lit(0.5))
    far = F.array(geo.point(F.lit(-1e6), F.lit(0)), geo.point(F.lit(-1e6), F.lit(0.1)))
    rows = M.roads(spark, d).where(geo.is_valid(F.col("line"))).select("gid", kernels.single_line(F.array(F.array(a, middle), far, F.array(b, middle))).alias("g"))
    return rows.select("gid", F.size("g").alias("vertices"), F.get("g", F.lit(0))["x"].alias("x1"), F.get("g", F.lit(0))["y"].alias("y1"))


#: The distance from (x1, y1) to (x2, y2), in degrees, as SQL over a table of such columns: the straight line through the spheroid,
#: bent by the curvature at its middle in its own direction; for lines of some kilometres this is exact to a micrometre.
GEODESIC = """ecef AS (SELECT *, 6378137.0 / sqrt(1 - e2 * sin(radians(y1)) ** 2) AS n1, 6378137.0 / sqrt(1 - e2 * sin(radians(y2)) ** 2) AS n2, 6378137.0 / sqrt(1 - e2 * sin(radians((y1 + y2) / 2)) ** 2) AS nm FROM (SELECT *, (2 - 1 / 298.257223563) / 298.257223563 AS e2 FROM leg)),
chord AS (SELECT *, sqrt((n2*cos(radians(y2))*cos(radians(x2))-n1*cos(radians(y1))*cos(radians(x1)))**2 + (n2*cos(radians(y2))*sin(radians(x2))-n1*cos(radians(y1))*sin(radians(x1)))**2 + ((n2*sin(radians(y2))-n1*sin(radians(y1)))*(1-e2))**2) AS c, nm ** 3 * (1 - e2) / 6378137.0 ** 2 AS mm FROM ecef),
bent AS (SELECT *, (mm * radians(y2 - y1)) ** 2 AS north, (nm * cos(radians((y1 + y2) / 2)) * radians(x2 - x1)) ** 2 AS east FROM chord),
curve AS (SELECT *, CASE WHEN north + east > 0 THEN (north / mm + east / nm) / (north + east) ELSE 0 END AS k FROM bent),
far AS (SELECT *, c * (1 + (c * k) ** 2 / 24 + 3 * (c * k) ** 4 / 640) AS metres FROM curve)"""


@query(M.sql("stops roads", f", leg AS (SELECT gid, 31 + ax / 100000 AS x1, 30 + ay / 100000 AS y1, 31 + bx / 100000 AS x2, 30 + by2 / 100000 AS y2 FROM roads), {GEODESIC} SELECT gid, round(metres, 2) AS metres FROM far"))
def geodesic_length(spark, d):
    line = F.transform("line", lambda p: geo.point(p["x"] / 100000 + 31, p["y"] / 100000 + 30))
    return M.roads(spark, d).select("gid", F.round(spheroid.geodesic_length(line), 2).alias("metres"))


@query(M.sql("stops roads probes", f""", lo AS (SELECT gid, radians(31 + ax / 100000) * 6378137.0 AS ax, ln(tan(pi() / 4 + radians(30 + ay / 100000) / 2)) * 6378137.0 AS ay, radians(31 + bx / 100000) * 6378137.0 AS bx, ln(tan(pi() / 4 + radians(30 + by2 / 100000) / 2)) * 6378137.0 AS by2 FROM roads),
po AS (SELECT id, 31 + x / 100000 AS x1, 30 + y / 100000 AS y1, radians(31 + x / 100000) * 6378137.0 AS x, ln(tan(pi() / 4 + radians(30 + y / 100000) / 2)) * 6378137.0 AS y FROM probes),
tt AS (SELECT *, {M.NEAR_T} AS t FROM po, lo), dd AS (SELECT *, {M.NEAR_D} AS d FROM tt), leg AS (SELECT id, gid, x1, y1, degrees((ax + t * (bx - ax)) / 6378137.0) AS x2, degrees(2 * atan(exp((ay + t * (by2 - ay)) / 6378137.0)) - pi() / 2) AS y2 FROM dd WHERE d <= 61), {GEODESIC} SELECT id, gid, round(metres, 2) AS dist FROM far WHERE metres <= 30"""))
def geodesic_join_30m(spark, d):
    degrees = lambda p: geo.point(p["x"] / 100000 + 31, p["y"] / 100000 + 30)
    lines = M.roads(spark, d).select("gid", F.transform("line", degrees).alias("line"))
    points = M.probes(spark, d).select("id", degrees(F.struct("x", "y")).alias("point"))
    return S.geodesic_join(points, lines, 30.0).select("id", "gid", geo.rounded(F.col("dist"), 2).alias("dist"))


@query("SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS INTEGER) AS tod, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0, 3) AS since, printf('%02d:%02d:00', hour(ts), minute(ts)) AS hm FROM events")
def clock_times(spark, d):
    rows = M.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    hm = F.format_string("%02d:%02d", F.hour("t"), F.minute("t"))
    return rows.select("event_id", times.seconds_of_day(F.col("t")).cast("int").alias("tod"), F.round(times.seconds_between(F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.col("t")), 3).alias("since"), times.normalize_hm(hm).alias("hm"))
