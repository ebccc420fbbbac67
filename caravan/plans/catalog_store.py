"""Queries for files and stored tables as they come and change, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from caravan.functions import geo, times
from caravan.operators import relational as R
from caravan.plans import catalog as C
from caravan.plans import flow, gtfs, migrate
from caravan.plans import mapping as M
from caravan.session import work_dir
from caravan.sources import geojson, layers, osm, store, tables
from caravan.sources import gtfs as gtfs_files
from caravan.streaming.intervals import streaming_vehicle_flow

query = C.query

# --- archives -------------------------------------------------------------------------------------------------------

#: Columns of a wide member.
WIDE = 60


@query(
    "SELECT p_partkey AS id, p_name || chr(13) || chr(10) || '\"' || p_brand || '\", ' || p_type AS stop_name, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN '' ELSE '  ' || p_type || chr(10) END AS stop_desc, "
    + ", ".join(f"p_partkey * {i} % 97 AS c{i}" for i in range(WIDE)) + " FROM part"
)
def zip_records(spark, d):
    """A member of 60 columns and more whose texts hold line ends, commas, quotes and blanks, through archives of the shared folder."""
    part = M.table(spark, d, "part")
    name = F.concat("p_name", F.lit('\r\n"'), "p_brand", F.lit('", '), "p_type")
    note = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 5 == 1, "").otherwise(F.concat(F.lit("  "), "p_type", F.lit("\n")))
    wide = part.select(*((F.col("p_partkey") * i % 97).alias(f"c{i}") for i in range(WIDE)), F.col("p_partkey").alias("id"), name.alias("stop_name"), note.alias("stop_desc"))
    folder = work_dir(spark, "wide")
    gtfs_files.write_archives(wide.repartition(3), "stops.txt", folder)
    schema = ", ".join(["id long", "stop_name string", "stop_desc string", *(f"c{i} long" for i in range(WIDE))])
    return gtfs_files.read_member(spark, f"{folder}/stops-*.zip", "stops.txt", schema)


@query("SELECT CAST(r_regionkey AS VARCHAR) AS trip_id, NULL AS start_time, NULL AS end_time, NULL AS headway_secs FROM region WHERE false UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '00:00:00', '24:00:00', 3600 FROM orders")
def missing_member(spark, d):
    """Archives without frequencies: an empty table, so every trip takes the default."""
    folder = work_dir(spark, "feed")
    gtfs_files.write_archives(M.trips(spark, d).select("trip_id", "route_id"), "trips.txt", folder)
    trips = gtfs_files.read_member(spark, f"{folder}/trips-*.zip", "trips.txt", "trip_id string")
    known = gtfs_files.read_member(spark, f"{folder}/trips-*.zip", "frequencies.txt")
    rest = trips.join(known.select("trip_id"), "trip_id", "left_anti").select("trip_id", F.lit("00:00:00").alias("start_time"), F.lit("24:00:00").alias("end_time"), F.lit(3600).alias("headway_secs"))
    return known.unionByName(rest)


# --- map documents --------------------------------------------------------------------------------------------------


def _document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements as the lines of one document, as map servers lay it out."""
    yield pa.RecordBatch.from_pydict({"value": ['{"version": 0.6, "generator": "a {\\"braced\\"} name", "osm3s": {"copyright": "}{"},', '"elements": [']})
    first = True
    for batch in batches:
        lines = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_pydict({"value": [("" if first and not i else ",") + x for i, x in enumerate(lines)]})
        first = first and not lines
    yield pa.RecordBatch.from_pydict({"value": ["]", "}"]})


@query(M.sql("stops roads", "SELECT n AS gid, gid AS way_id, CASE WHEN gid % 3 = 0 THEN 'primary' ELSE 'residential' END AS road_type, name AS road_name, 2 AS vertices, round(sqrt((bx-ax)*(bx-ax)+(by2-ay)*(by2-ay)), 4) AS length FROM (SELECT row_number() OVER (ORDER BY gid) AS n, roads.*, '{' || name || '\"}' AS name FROM roads JOIN stops ON id = gid WHERE gid % 5 <> 0)"))
def overpass_roads(spark, d):
    """Roads out of documents of elements, read in blocks."""
    stops = M.stops(spark, d)
    last = stops.agg(F.max("id").alias("m"))
    pretty = {"pretty": "true"}
    nodes = stops.select(F.to_json(F.struct(F.lit("node").alias("type"), "id", F.col("x").alias("lon"), F.col("y").alias("lat")), pretty).alias("value"))
    name = F.concat(F.lit("{"), "name", F.lit('"}'))
    tags = F.when(F.col("id") % 5 != 0, F.create_map(F.lit("highway"), F.when(F.col("id") % 3 == 0, "primary").otherwise("residential"), F.lit("name"), name)).otherwise(F.create_map(F.lit("rail"), F.lit("yes")))
    ways = stops.crossJoin(F.broadcast(last)).where("id < m").select(F.to_json(F.struct(F.lit("way").alias("type"), "id", F.array(F.col("id"), F.col("id") + 1).alias("nodes"), tags.alias("tags")), pretty).alias("value"))
    path = work_dir(spark, "documents")
    nodes.unionByName(ways).repartition(2).mapInArrow(_document, "value string").write.text(path)
    found = osm.roads(osm.read_documents(spark, path))
    return found.select("gid", "way_id", "road_type", "road_name", F.size("line").alias("vertices"), F.round(geo.length(F.col("line")), 4).alias("length"))


@query(M.sql("stops roads", "SELECT gid, CASE WHEN gid % 3 = 0 THEN 'primary' ELSE 'residential' END AS road_type, ax, by2 FROM roads"))
def json_lines_roads(spark, d):
    """Elements of files with one a line, their roads in feature files, and these in collections, read back."""
    roads = M.roads(spark, d)
    nodes = roads.select(F.explode(F.array(F.struct(F.lit("node").alias("type"), (F.col("gid") * 2).alias("id"), F.get("line", F.lit(0)).alias("p")), F.struct(F.lit("node").alias("type"), (F.col("gid") * 2 + 1).alias("id"), F.get("line", F.lit(1)).alias("p")))).alias("e"))
    nodes = nodes.select(F.to_json(F.struct("e.type", "e.id", F.col("e.p.x").alias("lon"), F.col("e.p.y").alias("lat"))).alias("value"))
    kind = F.create_map(F.lit("highway"), F.when(F.col("gid") % 3 == 0, "primary").otherwise("residential"))
    ways = roads.select(F.to_json(F.struct(F.lit("way").alias("type"), F.col("gid").alias("id"), F.array(F.col("gid") * 2, F.col("gid") * 2 + 1).alias("nodes"), kind.alias("tags"))).alias("value"))
    folder = work_dir(spark, "lines")
    nodes.unionByName(ways).write.text(f"{folder}/elements")
    found = osm.roads(osm.read_elements(spark, f"{folder}/elements")).withColumn("gid", F.col("way_id"))
    geojson.write(found, f"{folder}/features", "line", ["gid", "road_type"])
    half = geojson.read(spark, f"{folder}/features", "gid bigint, road_type string")
    texts = geojson.features(found, "line", ["gid", "road_type"]).repartition(4).groupBy(F.spark_partition_id()).agg(F.array_join(F.collect_list("value"), ",").alias("v"))
    texts.select(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), "v", F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/collections")
    whole = geojson.read_collections(spark, f"{folder}/collections", "gid bigint, road_type string")
    p = lambda df, i, c: F.get(df["geometry"], F.lit(i))[c]
    return half.join(whole, ["gid", "road_type"]).select("gid", "road_type", p(half, 0, "x").alias("ax"), p(whole, 1, "y").alias("by2"))


# --- stored tables that change --------------------------------------------------------------------------------------

#: Partitions of the stored trips.
PARTS = 16


@query(M.sql("trips", f", found AS (SELECT trip_id, min(value) AS fare FROM (SELECT trip_id, value + 1 AS value FROM trips WHERE trip_id % {PARTS} IN (2, 3, 5) AND status = 'F' UNION ALL SELECT trip_id, value + 9 FROM trips WHERE trip_id % {PARTS} = 3 AND status = 'F') GROUP BY trip_id) SELECT t.trip_id, coalesce(fare, value) AS fare, status, t.trip_id % {PARTS} IN (SELECT trip_id % {PARTS} FROM found) AS rewritten FROM trips t LEFT JOIN found USING (trip_id)"))
def update_stored_fares(spark, d):
    """UPDATE ... FROM on a stored table, twice over: the rows, and whether their partition's files are others than before."""
    path = work_dir(spark, "trips")
    trips = M.trips(spark, d).select("trip_id", F.col("value").alias("fare"), "status", (F.col("trip_id") % PARTS).cast("int").alias("part"))
    before = store.write_partitioned(trips, path, "part").select("part", F.col("_metadata.file_name").alias("f")).distinct().groupBy("part").agg(F.array_sort(F.collect_set("f")).alias("f"))
    before = {r.part: r.f for r in before.collect()}
    rows = trips.where(F.col("part").isin(2, 3, 5) & (F.col("status") == "F")).select("trip_id", (F.col("fare") + 1).alias("fare"))
    found = rows.unionByName(trips.where((F.col("part") == 3) & (F.col("status") == "F")).select("trip_id", (F.col("fare") + 9).alias("fare")))
    for _ in range(2):
        store.update_from(spark, path, "part", found, "trip_id", ["fare"])
    after = spark.read.parquet(path).withColumn("f", F.col("_metadata.file_name"))
    old = spark.createDataFrame([(k, n) for k, names in before.items() for n in names], "part int, f string").withColumn("kept", F.lit(True))
    return after.join(F.broadcast(old), ["part", "f"], "left").select("trip_id", "fare", "status", F.col("kept").isNull().alias("rewritten"))


@query(M.sql("stops roads", "SELECT gid, ax + 1000 AS ax FROM roads WHERE gid % 4 = 0 UNION ALL SELECT gid, ax FROM roads WHERE gid % 4 <> 0"))
def update_geometry(spark, d):
    """Trips take the matched geometries of their surveys; those without one keep theirs."""
    roads = M.roads(spark, d)
    moved = roads.where("gid % 4 = 0").select(F.col("gid").alias("trip_id"), F.transform("line", lambda p: geo.point(p["x"] + 1000, p["y"])).alias("matched_geometry"))
    found = moved.unionByName(roads.where("gid % 4 = 1").select(F.col("gid").alias("trip_id"), F.lit(None).cast(geo.LINE).alias("matched_geometry")))
    trips = roads.select(F.col("gid").alias("trip_id"), F.col("line").alias("matched_geometry"))
    kept = migrate.replace_geometry(trips, found.where("matched_geometry is not null"), "trip_id", "matched_geometry")
    path = work_dir(spark, "geometry")
    store.write_partitioned(trips.withColumn("part", (F.col("trip_id") % PARTS).cast("int")), path, "part")
    store.update_from(spark, path, "part", found.where("matched_geometry is not null"), "trip_id", ["matched_geometry"])
    stored = spark.read.parquet(path)
    both = stored.join(kept.withColumnRenamed("matched_geometry", "other"), "trip_id").where(F.col("matched_geometry") == F.col("other"))
    return both.select(F.col("trip_id").alias("gid"), F.get("matched_geometry", F.lit(0))["x"].alias("ax"))


@query("SELECT row_number() OVER (ORDER BY n_name) AS gid, n_name AS name, 'nations' AS batch FROM nation UNION ALL SELECT (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY c_custkey), c_name, 'customers' FROM customer UNION ALL SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_name, 'suppliers' FROM supplier")
def append_batches(spark, d):
    """Three loads under running keys; the first two are repeated, and a repeated one changes nothing."""
    path = work_dir(spark, "agencies")
    nations = M.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(0).cast("long").alias("n"))
    customers = M.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("n"))
    suppliers = M.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("long").alias("n"))
    store.append_batch(nations, path, "nations", ["name"])
    for rows, name in ((customers, "customers"), (nations, "nations"), (suppliers, "suppliers"), (customers, "customers")):
        store.append_batch(rows, path, name, ["n", "name"])
    return spark.read.parquet(path).select("gid", "name", "batch")


@query(M.sql("trips", ", more AS (SELECT route_id, agency, headway FROM trips UNION ALL SELECT route_id, agency, 60 FROM trips WHERE status = 'P'), r AS (SELECT route_id, agency, count(*) AS n, sum(headway) AS total FROM more GROUP BY ALL) SELECT agency AS name, sum(n)::BIGINT AS n, sum(total)::BIGINT AS total, 'agencies,routes' AS refreshed FROM r GROUP BY agency UNION ALL SELECT r_name, r_regionkey, 0, 'agencies,routes' FROM region"))
def refresh_views(spark, d):
    """Views of views: after a change of one table only what depends on it is written anew."""
    folder = work_dir(spark, "views")
    paths = {"trips": f"{folder}/t/trips", "regions": f"{folder}/t/regions"}
    tables.replace_table(M.trips(spark, d).select("route_id", "agency", "headway", "status"), paths["trips"])
    tables.replace_table(M.table(spark, d, "region"), paths["regions"])
    views = [
        store.View("agencies", ["routes"], lambda r: r.groupBy(F.col("agency").alias("name")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))),
        store.View("routes", ["trips"], lambda t: t.groupBy("route_id", "agency").agg(F.count("*").alias("n"), F.sum("headway").alias("total"))),
        store.View("places", ["regions"], lambda r: r.select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("n"), F.lit(0).cast("long").alias("total"))),
    ]
    store.refresh(spark, views, paths, f"{folder}/v")
    tables.append_table(M.trips(spark, d).where("status = 'P'").select("route_id", "agency", F.lit(60).alias("headway"), "status"), paths["trips"])
    names = ",".join(sorted(store.refresh(spark, views, paths, f"{folder}/v") + store.refresh(spark, views, paths, f"{folder}/v")))
    both = store.read_view(spark, f"{folder}/v", "agencies").unionByName(store.read_view(spark, f"{folder}/v", "places"))
    return both.withColumn("refreshed", F.lit(names))


@query(M.sql("stops roads", "SELECT gid, 'layer ' || (gid % 3) AS interval_name, CAST(CASE WHEN gid % 3 = 1 THEN gid * 2 ELSE gid END AS DOUBLE) AS value, ax, by2 FROM roads WHERE gid % 3 <> 1 OR gid % 2 = 0"))
def overwrite_layer(spark, d):
    """Three layers of GeoPackage parts, one of which is replaced by fewer rows with other values; the others' files stay."""
    folder = work_dir(spark, "layers")
    roads = M.roads(spark, d).withColumn("value", F.col("gid").cast("double"))
    for k in range(3):
        layers.overwrite_layer(roads.where(F.col("gid") % 3 == k).repartition(3), folder, f"layer {k}")
    before = layers.layer_parts(spark, folder)
    layers.overwrite_layer(roads.where("gid % 3 = 1 and gid % 2 = 0").withColumn("value", F.col("value") * 2).repartition(2), folder, "layer 1")
    after = layers.layer_parts(spark, folder)
    if any((before[k] == after[k]) != (k != "layer 1") for k in after):
        raise ValueError("a layer's files have changed that was not replaced")
    back = layers.read_geopackages(spark, [p for parts in after.values() for p in parts])
    return back.select("gid", "interval_name", "value", F.get("line", F.lit(0))["x"].alias("ax"), F.get("line", F.lit(1))["y"].alias("by2"))


@query("SELECT o_orderkey AS gid, o_orderpriority AS interval_name, o_totalprice AS value FROM orders WHERE o_orderpriority LIKE '1%'")
def parquet_layers(spark, d):
    """One layer of a flow that is partitioned by layers."""
    path = work_dir(spark, "flow")
    layers.write_layers(M.table(spark, d, "orders").select(F.col("o_orderkey").alias("gid"), F.col("o_orderpriority").alias("interval_name"), F.col("o_totalprice").alias("value")), path)
    return tables.read_table(spark, path).where("interval_name like '1%'")


# --- surveys of a setting -------------------------------------------------------------------------------------------


def _settings(spark, d):
    """Settings are regions, projects their names' initials."""
    return M.table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.substring("r_name", 1, 2).alias("project_id"), F.col("r_name").alias("setting_id"))


@query("SELECT n_nationkey AS id, n_name AS name, n_nationkey % 3 <> 0 AS active FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def interval_settings(spark, d):
    """Intervals of a project's setting, through a link table; deleted ones are not active."""
    nations = M.table(spark, d, "nation")
    intervals = nations.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("2024-01-01")).alias("deleted_at"))
    links = nations.select(F.col("n_nationkey").alias("interval_id"), F.col("n_regionkey").alias("frequency_setting_id"))
    settings = _settings(spark, d)
    found = migrate.with_settings(intervals, links.unionByName(links), settings, migrate.setting_of(settings, "AS"))
    return found.select("id", "name", "active")


@query("SELECT event_id AS id, c_custkey AS onboard_instance_id, c_mktsegment AS onboard_instance_status, c_acctbal > 0 AS onboard_instance_valid FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE') AND event_id % 7 <> 0")
def survey_trackpoints(spark, d):
    """Trackpoints of a setting's routes, trips and instances that are not deleted, with their instance's status and validity."""
    settings = _settings(spark, d).withColumnRenamed("id", "r")
    routes = M.table(spark, d, "nation").join(settings, F.col("n_regionkey") == F.col("r")).select(F.col("n_nationkey").alias("id"), "setting_id")
    trips = M.table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_nationkey").alias("route_id"))
    instances = M.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 100).alias("trip_id"), F.col("c_mktsegment").alias("status"), (F.col("c_acctbal") > 0).alias("valid"))
    points = M.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("onboard_instance_id"), F.when(F.col("event_id") % 7 == 0, F.col("ts")).alias("deleted_at"))
    return migrate.survey_rows(points, instances, trips, routes, migrate.setting_of(_settings(spark, d), "EU")).select("id", "onboard_instance_id", "onboard_instance_status", "onboard_instance_valid")


@query(M.sql("trips", "SELECT trip_id, route_id FROM trips JOIN customer ON c_custkey = route_id JOIN nation ON n_nationkey = c_nationkey WHERE n_name IN ('NATION_3', 'NATION_11')"))
def agency_filter(spark, d):
    """Trips whose route is run by one of two agencies."""
    routes = M.table(spark, d, "customer").join(M.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("route_id"), F.col("n_name").alias("agency_id"))
    return flow.trips_of_agencies(M.trips(spark, d), routes, ["NATION_3", "NATION_11"]).select("trip_id", "route_id")


@query(M.sql("stops roads", "SELECT gid, ax, by2, false AS absent FROM roads WHERE gid % 5 <> 0 UNION ALL SELECT gid, NULL, NULL, true FROM roads WHERE gid % 5 = 0"))
def geometry_texts(spark, d):
    """Lines out of texts with a reference system before them; texts of no line give none."""
    text = F.when(F.col("gid") % 5 == 0, None).otherwise(F.concat(F.lit("SRID=4326;"), geo.to_wkt(F.col("line"))))
    found = migrate.geometry_from_text(M.roads(spark, d).select("gid", text.alias("geom")), "geom")
    return found.select("gid", F.get("geom", F.lit(0))["x"].alias("ax"), F.get("geom", F.lit(1))["y"].alias("by2"), F.col("geom").isNull().alias("absent"))


@query(M.sql("calls", ", t AS (SELECT stop_id % 40 AS o_id, supplier % 40 AS d_id, seq % 3 AS interval_id, CASE WHEN board > 5 THEN q END AS duration FROM calls), w AS (SELECT DISTINCT o_id, d_id, interval_id FROM t), r AS (SELECT o_id, d_id, interval_id, duration, CASE WHEN (o_id + d_id) % 2 = 0 THEN CAST(o_id * 100 + d_id AS DOUBLE) END AS length_m FROM w JOIN t USING (o_id, d_id, interval_id)) SELECT o_id, d_id, interval_id, length_m, count(*) AS n, round(sum(coalesce(duration, m)), 4) AS total FROM (SELECT *, avg(duration) OVER (PARTITION BY o_id, d_id) AS m FROM r) GROUP BY ALL"))
def travel_times_with_lengths(spark, d):
    """Completed travel times with the lengths of the pairs that have one."""
    rows = M.calls(spark, d).select((F.col("stop_id") % 40).alias("o_id"), (F.col("supplier") % 40).alias("d_id"), (F.col("seq") % 3).alias("interval_id"), F.when(F.col("board") > 5, F.col("q")).alias("duration"))
    lengths = rows.where("(o_id + d_id) % 2 = 0").select("o_id", "d_id", (F.col("o_id") * 100 + F.col("d_id")).cast("double").alias("length_m")).distinct()
    found = gtfs.estimate_missing_times(rows, by_vehicle=False, lengths=lengths)
    return found.groupBy("o_id", "d_id", "interval_id", "length_m").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("total"))


# --- clocks of several zones ----------------------------------------------------------------------------------------

ZONES = ("Europe/Paris", "America/New_York")


@query(
    f"WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{ZONES[0]}' ELSE '{ZONES[1]}' END AS zone, timezone(CASE WHEN event_id % 2 = 0 THEN '{ZONES[0]}' ELSE '{ZONES[1]}' END, timezone('UTC', CAST(ts AS TIMESTAMP) + to_days(CAST(event_id % 366 AS INTEGER)))) AS l FROM events), "
    "s AS (SELECT event_id, zone, CAST(hour(l) * 3600 + minute(l) * 60 + floor(second(l)) AS BIGINT) AS tod FROM t), "
    "i AS (SELECT * FROM (VALUES ('night', 79200, 86400), ('night', 0, 7200), ('morning', 7200, 43200), ('day', 43200, 79200)) v(interval_name, a, b)) "
    "SELECT zone, interval_name, count(*) AS n, CAST(sum(tod) AS BIGINT) AS total FROM s JOIN i ON tod >= a AND tod < b GROUP BY ALL"
)
def local_intervals(spark, d):
    """Events of a year, with the days on which clocks change, by the interval that their own agency's clocks show; one is over midnight."""
    events = M.table(spark, d, "events")
    zone = F.when(F.col("event_id") % 2 == 0, ZONES[0]).otherwise(ZONES[1])
    moment = F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 366 * 86_400_000_000
    rows = events.select(zone.alias("zone"), times.seconds_of_day(F.timestamp_micros(moment), zone).cast("long").alias("tod"))
    named = spark.createDataFrame([("night", 79200, 93600), ("morning", 7200, 43200), ("day", 43200, 79200)], "interval_name string, s long, e long")
    parts = times.split_at_midnight(named)
    inside = rows.join(F.broadcast(parts), (F.col("tod") >= F.col("s")) & (F.col("tod") < F.col("e")))
    return inside.groupBy("zone", "interval_name").agg(F.count("*").alias("n"), F.sum("tod").alias("total"))


@query(M.sql("stops trips intervals calls legs runs", ", " + C.FLOW.replace("coalesce(v, 0) AS DOUBLE", "coalesce(v, 0) * 3600.0 / 14400 AS DOUBLE")))
def vehicle_flow_per_hour(spark, d):
    """Vehicle flow by the hour of each interval."""
    counts = flow.interval_counts(C._frequencies(spark, d), C._matched(spark, d), M.intervals(spark, d))
    return flow.vehicle_flow(C._roads(spark, d), counts, per_hour=True)


@query(M.sql("stops trips intervals calls legs runs", ", " + C.FLOW))
def flow_of_feeds(spark, d):
    """The appearances of two feeds, of trips by their status, together."""
    trips = M.trips(spark, d)
    counts = None
    for feed in (trips.where("status = 'F'"), trips.where("status <> 'F'")):
        found = flow.interval_counts(C._frequencies(spark, d).join(feed.select("trip_id"), "trip_id", "left_semi"), C._matched(spark, d), M.intervals(spark, d))
        counts = found if counts is None else counts.unionByName(found)
    return flow.vehicle_flow(C._roads(spark, d), counts)


# --- streams --------------------------------------------------------------------------------------------------------


@query(M.sql("intervals", "SELECT strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H') AS window_start, user_id % 50 AS gid, interval_name, count(*) AS value FROM events JOIN intervals ON CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) > s AND CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) < e GROUP BY ALL"))
def hourly_flow(spark, d):
    """Counts of appearances by road, interval and hour: what the streaming query gives for a bounded table."""
    time = F.col("ts").cast("timestamp")
    appearances = M.table(spark, d, "events").select((F.col("user_id") % 50).alias("gid"), time.alias("ts"), times.seconds_of_day(time).cast("long").alias("timeofday_secs"))
    return streaming_vehicle_flow(appearances, M.intervals(spark, d)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))
