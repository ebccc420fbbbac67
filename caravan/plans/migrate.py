"""From survey records to transit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravan.functions import geo, kernels, spheroid
from caravan.operators import relational as R
from caravan.operators import spatial as S
from caravan.session import written

#: Metres of the stop pipeline, on the projected plane.
EPS, MIN_POINTS, CELL, SNAP, TERMINAL = 150.0, 3, 120.0, 30.0, 75.0


def live(df: DataFrame, **equal) -> DataFrame:
    """Rows not soft-deleted, with the given values."""
    out = df.where(F.col("deleted_at").isNull())
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    return out


def with_settings(intervals: DataFrame, links: DataFrame, settings: DataFrame, setting_id: str) -> DataFrame:
    """Intervals of a setting, through their link table; deleted ones stay, flagged not active."""
    chosen = settings.where(F.col("setting_id") == setting_id).select(F.col("id").alias("frequency_setting_id"))
    ids = links.join(chosen, "frequency_setting_id").select(F.col("interval_id").alias("id")).distinct()
    return intervals_active(intervals.join(ids, "id", "left_semi"))


def setting_of(settings: DataFrame, project_id: str) -> str:
    """The setting of a project, the first by id; an error if there is none."""
    row = settings.where(F.col("project_id") == project_id).orderBy("id").select("setting_id").first()
    if row is None:
        raise ValueError(f"project {project_id} has no setting")
    return row["setting_id"]


def active_intervals(intervals: DataFrame) -> DataFrame:
    """Active intervals in order of their start; an error if there is none."""
    rows = intervals.where("active").orderBy("start_time")
    if rows.isEmpty():
        raise ValueError("no interval is active")
    return rows


def stops_with_time(stops: DataFrame, created: DataFrame) -> DataFrame:
    """Raw stops with when they were recorded: created(observer_id, created_at); stops without stay."""
    return stops.join(created.select("observer_id", "created_at"), "observer_id", "left")


def reattach_geometry(trips: DataFrame, source: DataFrame, key: str = "observer_id", column: str = "geom") -> DataFrame:
    """Trips with the source's geometry by key, one row a key: the first by the trips' other columns."""
    rows = trips.drop(column).join(source.select(key, column), key)
    order = [c for c in trips.columns if c not in (key, column)]
    return R.first_by(rows, [key], order or [key])


def onboard_instances(instances: DataFrame, agencies: DataFrame) -> DataFrame:
    """Surveys with a valid geometry, with their agency's vehicle: instances(agency, geom, ...), agencies(agency_id, vehicle_id)."""
    kept = instances.where(geo.is_valid(F.col("geom")))
    return kept.join(agencies.select(F.col("agency_id").alias("agency"), "vehicle_id"), "agency")


def geometry_from_text(rows: DataFrame, column: str) -> DataFrame:
    """The text column's WKT as a geometry under the same name."""
    return rows.withColumn(column, geo.from_wkt(F.col(column)))


def survey_rows(rows: DataFrame, instances: DataFrame, trips: DataFrame, routes: DataFrame, setting_id: str) -> DataFrame:
    """Onboard rows of a setting, with their instance's status and validity: routes, trips, instances, rows."""
    chosen = trips.join(routes.where(F.col("setting_id") == setting_id).select(F.col("id").alias("route_id")), "route_id", "left_semi").select(F.col("id").alias("trip_id"))
    kept = instances.join(chosen, "trip_id", "left_semi").select(F.col("id").alias("onboard_instance_id"), F.col("status").alias("onboard_instance_status"), F.col("valid").alias("onboard_instance_valid"))
    return live(rows).join(kept, "onboard_instance_id")


def clean_terminals(terminals: DataFrame) -> DataFrame:
    """Accepted terminals without nulls and without a test name."""
    return terminals.where(F.col("status") == "accepted").na.drop().where(R.not_test("name"))


def map_agencies_vehicles(agencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vehicles: one for each agency name, agencies: one for each id, with its vehicle's gid)."""
    once = R.first_by(agencies, ["id"], ["name", "serial"])
    vehicles = R.surrogate_key(once.select("name").distinct(), ["name"])
    linked = once.join(vehicles.select("name", F.col("gid").alias("vehicle_id")), "name", "left")
    columns = [F.col("name").alias(c) for c in ("agency_id", "agency_name", "common_name")]
    return vehicles, R.surrogate_key(linked.select("id", *columns, F.col("serial").isNotNull().alias("has_serial"), "vehicle_id"), ["id"])


def intervals_active(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("active", F.col("deleted_at").isNull())


def impute_fare(trips: DataFrame) -> DataFrame:
    """Fares that are no number, or missing, take the ceiling of the mean."""
    return R.ceil_mean_impute(trips.withColumn("fare", F.col("fare").try_cast("double")), "fare")


def attach_terminals(trips: DataFrame, terminals: DataFrame) -> DataFrame:
    """Trips with the gids and names of both terminals; trips without either go."""
    side = lambda k: terminals.select(F.col("observer_id").alias(f"{k}_id"), F.col("gid").alias(f"{k[0]}_id_gid"), F.col("name").alias(k))
    return trips.join(side("origin"), "origin_id").join(side("destination"), "destination_id")


def estimate_headways(trips: DataFrame, intervals: DataFrame, surveys: DataFrame) -> DataFrame:
    """Final headway of every trip in every interval.

    trips(trip_id, route_id, agency_id), intervals(interval_id), surveys(trip_id, interval_id, headway, status, origin,
    destination) -> trips' columns, interval_id, headway (own or of the route, else null), method, final_headway.
    """
    valid = surveys.where((F.col("status") == "finished") & R.not_test("origin") & R.not_test("destination"))
    means = valid.groupBy("trip_id", "interval_id").agg(F.avg("headway").alias("headway"))
    grid = trips.crossJoin(R.few(intervals.select("interval_id"))).join(means, ["trip_id", "interval_id"], "left")
    filled = R.fill_forward_back(grid, "headway", ["route_id", "interval_id"], ["trip_id"])
    agency = F.avg("headway").over(Window.partitionBy("agency_id", "interval_id"))
    shares = filled.withColumn("agency_headway", agency).withColumn("ratio", F.col("headway") / F.nullif(F.col("agency_headway"), F.lit(0.0)))
    routed = shares.withColumn("route_ratio", F.avg("ratio").over(Window.partitionBy("route_id")))
    own = F.col("headway").isNotNull()
    return routed.withColumn("method", F.when(own, "from_own_freq_surveys").otherwise("from_similar_agency_interval")).withColumn(
        "final_headway", F.floor(F.coalesce("headway", F.col("route_ratio") * F.col("agency_headway")))
    ).drop("ratio")


def route_long(origin: Column, destination: Column) -> Column:
    """Both names in alphabetical order."""
    name = lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.lit(" - "), F.coalesce(b, F.lit("")))
    return F.when(F.lower(origin) > F.lower(destination), name(destination, origin)).otherwise(name(origin, destination))


def trips_view(trips: DataFrame, agencies: DataFrame, vehicles: DataFrame, terminals: DataFrame) -> DataFrame:
    """Trips with the names that feeds and reports show."""
    a = agencies.select(F.col("gid").alias("_a"), F.col("agency_id").alias("agency"), "common_name", "vehicle_id")
    v = vehicles.select(F.col("gid").alias("vehicle_id"), F.col("name").alias("vehicle_name"), "passenger_capacity")
    t = lambda k: terminals.select(F.col("gid").alias(f"{k[0]}_id"), F.col("name").alias(k))
    rows = trips.withColumnRenamed("agency_id", "_a").join(a, "_a", "left").join(v, "vehicle_id", "left").join(t("origin"), "o_id", "left").join(t("destination"), "d_id", "left")
    text = lambda *c: F.concat(*(F.coalesce(x, F.lit("")) for x in c))
    return rows.select(
        "gid", F.col("observer_route_id").alias("route_id"), "route_type", "service_id", text(F.col("common_name"), F.lit(" "), F.col("agency_serial")).alias("route_short"), route_long(F.col("origin"), F.col("destination")).alias("route_long"),
        "observer_id", "direction_id", "o_id", "d_id", "geom", "origin", "destination", F.col("agency").alias("agency_id"), "vehicle_name", "passenger_capacity", text(F.col("origin"), F.lit("-"), F.col("destination")).alias("trip_short"), "fare", (spheroid.geodesic_length(F.col("geom")) / 1000).alias("len_km"),
    )


def unpack_gender_counts(stops: DataFrame, column: str, name: str) -> DataFrame:
    """JSON counts {"male", "female"} as two integers."""
    parsed = F.from_json(column, "male int, female int")
    return stops.withColumn(f"{name}_male", parsed["male"]).withColumn(f"{name}_female", parsed["female"])


def stop_clusters(stops: DataFrame, eps: float = EPS, min_points: int = MIN_POINTS) -> DataFrame:
    """(cluster, n_points, x, y, mode_name) of raw stops(id, name, x, y)."""
    placed = stops.join(S.dbscan(stops, eps, min_points), "id")
    shape = placed.groupBy("cluster").agg(F.count("*").alias("n_points"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    names = R.mode_by(placed.withColumn("_name", R.blank_to_null("name")), ["cluster"], "_name", "mode_name")
    return shape.join(names, "cluster", "left").withColumn("mode_name", F.coalesce("mode_name", F.lit("Unnamed")))


def process_stops(stops: DataFrame, trips: DataFrame, cell: float = CELL, snap: float = SNAP, terminal: float = TERMINAL) -> DataFrame:
    """Stops from raw stops(id, name, x, y) and trips(trip_id, line): cluster, thin, snap, flag terminals, bin directions."""
    thin = S.grid_thin(stop_clusters(stops), cell, [F.col("n_points").desc(), "cluster"])
    near = S.nearest_within(thin.withColumn("point", geo.point("x", "y")), trips.select("trip_id", "line"), snap, "cluster", "trip_id")
    line = F.col("line")
    at = near.withColumn("geom", F.col("near")).withColumn("_at", _fraction())
    ends = F.least(geo.distance(F.col("geom"), geo.start_point(line)), geo.distance(F.col("geom"), geo.end_point(line)))
    before = geo.interpolate(line, F.greatest(F.col("_at") - 0.0005, F.lit(0.0)) * F.col("total"))
    after = geo.interpolate(line, F.least(F.col("_at") + 0.0005, F.lit(1.0)) * F.col("total"))
    flagged = at.withColumn("location_type", F.when(ends <= terminal, 2).otherwise(0)).withColumn("double", geo.direction_bin(geo.azimuth(before, after)))
    return flagged.select("cluster", F.col("mode_name").alias("stop_name"), F.concat("mode_name", F.lit(" (Dir "), F.col("double").cast("string"), F.lit(")")).alias("stop_desc"), "location_type", "double", "trip_id", "dist", "geom")


def stops_table(processed: DataFrame) -> DataFrame:
    """The table of stops: gid by cluster, stop_id its text, place in degrees; processed: process_stops() on the projected plane."""
    rows = R.surrogate_key(processed, ["cluster"])
    degrees = geo.inverse_mercator(F.col("geom"))
    return rows.select("gid", F.col("gid").cast("string").alias("stop_id"), "stop_name", "stop_desc", degrees["y"].alias("stop_lat"), degrees["x"].alias("stop_lon"), "location_type", "double", "geom")


def _fraction() -> Column:
    return F.when(F.col("total") > 0, F.col("along") / F.col("total")).otherwise(F.lit(0.0))


def trip_stops_sequence(stops: DataFrame, trips: DataFrame, reach: float = 1.0, spacing: float = 100.0, metres=geo.length, agencies: DataFrame | None = None, vehicles: DataFrame | None = None) -> DataFrame:
    """Stops along trips: stops(stop_id, point), trips(trip_id, line, ...) -> distance along, fraction, sequence.

    Sequences are numbered before stops nearer than the spacing to the one before go, and the first stop of a trip is compared
    with the last of the trip before it, as in the tables this reproduces. With agencies(agency_id, vehicle_id, ...) and
    vehicles(gid, name), the trips' vehicle_name comes from their agency; trips without one stay.
    """
    if agencies is not None and vehicles is not None:
        named = agencies.select("agency_id", "vehicle_id").join(vehicles.select(F.col("gid").alias("vehicle_id"), F.col("name").alias("vehicle_name")), "vehicle_id", "left").drop("vehicle_id")
        trips = trips.join(named, "agency_id", "left")
    # narrow rows are numbered; the other columns come back for the stops that are left
    measured = trips.select("trip_id", "line", metres(F.col("line")).alias("_metres"))
    place = lambda found: found.withColumn("distance_frac", _fraction()).select("trip_id", "stop_id", "distance_frac", (F.col("distance_frac") * F.col("_metres")).alias("distance"))
    if spacing > 0:
        parts = S.distance_join(stops.select("stop_id", "point"), measured, reach, "stop_id", "trip_id", each=lambda found, cells: _parts(found, cells, spacing))
        kept = _spaced(parts, measured.select("trip_id", "_metres"), spacing)
        again = S.distance_join(stops.select("stop_id", "point"), measured.join(kept.select("trip_id").distinct(), "trip_id", "left_semi"), reach, "stop_id", "trip_id")
        first = place(again).select("trip_id", "stop_id", "distance_frac").join(kept, ["trip_id", "distance_frac"])
        rows = first.groupBy("trip_id", "distance_frac", "distance", "stop_sequence", "distance_from_prev").agg(F.min("stop_id").alias("stop_id"))
    else:
        found = S.distance_join(stops.select("stop_id", "point"), measured, reach, "stop_id", "trip_id")
        rows = R.lag_across_groups(place(found), "trip_id", ["distance_frac", "stop_id"], "distance", "_lag", "stop_sequence", lambda value, before: value - before >= spacing)
        rows = rows.withColumn("distance_from_prev", F.col("distance") - F.col("_lag")).drop("_lag")
    if len(stops.columns) > 2:
        rows = rows.join(stops.drop("point"), "stop_id")
    return rows.join(trips, "trip_id")


def _parts(found: DataFrame, cells: list[str], spacing: float) -> DataFrame:
    """(trip_id, _part, _n, _first, _last): the number of stops, and the first and last fraction, of parts of trips shorter than the
    spacing; of what a task has of them, if cells tell how pairs are dealt."""
    part = F.floor(_fraction() * F.col("_metres") / (spacing * 0.999)).alias("_part")
    rows = found.select(*cells, "trip_id", part, _fraction().alias("_at"))
    return rows.groupBy(*cells, "trip_id", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.max("_at").alias("_last")).drop(*cells)


def _spaced(parts: DataFrame, metres: DataFrame, spacing: float) -> DataFrame:
    """(trip_id, distance_frac, distance, stop_sequence, distance_from_prev) of the stops in parts, of _parts(), that are a spacing or more
    from the one before, over all trips; the first of several at one place. metres(trip_id, _metres).

    Of stops within a part only the first can be such a stop, and only the last can come before another: the many stops of dense trips
    are neither shuffled nor sorted. Parts are dealt by trip once.
    """
    spark = parts.sparkSession
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "trip_id")
    whole = dealt.groupBy("trip_id", "_part").agg(F.sum("_n").alias("_n"), F.min("_first").alias("distance_frac"), F.max("_last").alias("_last")).join(metres.hint("merge"), "trip_id")
    before = Window.partitionBy("trip_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    span = F.struct((F.col("distance_frac") * F.col("_metres")).alias("first"), (F.col("_last") * F.col("_metres")).alias("last"))
    spans = whole.withColumn("stop_sequence", F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).select("trip_id", "_part", "distance_frac", "stop_sequence", span.alias("_span"))
    kept = R.lag_across_groups(spans, "trip_id", ["_part"], "_span", "_before", keep=lambda span, before: span["first"] - before["last"] >= spacing)
    return written(kept.select("trip_id", "distance_frac", F.col("_span.first").alias("distance"), "stop_sequence", (F.col("_span.first") - F.col("_before.last")).alias("distance_from_prev")), "spaced")


def od_segments(sequence: DataFrame) -> DataFrame:
    """Consecutive stops of trips with the mean distance; sequence(trip_id, stop_id, stop_sequence, distance, distance_frac, vehicle_name)."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    rows = sequence.where("distance_frac < 1").withColumn("d_id", F.lead("stop_id").over(w)).withColumn("dist", F.lead("distance").over(w) - F.col("distance"))
    return rows.where("d_id is not null").groupBy(F.col("stop_id").alias("o_id"), "d_id", "vehicle_name").agg(F.avg("dist").alias("dist"), F.count("*").alias("n"))


def stop_visits(trackpoints: DataFrame, instances: DataFrame, stops: DataFrame, reach: float = 30.0) -> DataFrame:
    """When surveyed vehicles were near stops: (stop_id, instance_id, vehicle_name, time, trip_id), the last time of each.

    trackpoints(id, instance_id, time, point) of valid, finished instances(id, status, valid, trip_id, vehicle_name);
    stops(stop_id, point). trip_id is the smallest of the instance's.
    """
    ran = instances.where((F.col("status") == "finished") & F.col("valid")).groupBy(F.col("id").alias("instance_id"), "vehicle_name").agg(F.min("trip_id").alias("trip_id"))
    points = trackpoints.select("instance_id", "time", "point").join(ran, "instance_id")
    near = S.latest_near(points, stops, reach, ["instance_id", "vehicle_name", "trip_id"], "stop_id", "time")
    return near.select("instance_id", "stop_id", "vehicle_name", "time", "trip_id")


def od_durations(visits: DataFrame, segments: DataFrame, intervals: DataFrame) -> DataFrame:
    """Mean seconds between stops by interval: visits(stop_id, instance_id, vehicle_name, time), intervals(interval_id, s, e, active)."""
    last = visits.groupBy("instance_id", "stop_id", "vehicle_name").agg(F.max("time").alias("time"))
    o_ids, d_ids = segments.select(F.col("o_id").alias("stop_id")).distinct(), segments.select(F.col("d_id").alias("stop_id")).distinct()
    o = last.join(o_ids, "stop_id", "left_semi").select(F.col("stop_id").alias("o_id"), "instance_id", "vehicle_name", F.col("time").alias("o_time"))
    d = last.join(d_ids, "stop_id", "left_semi").select(F.col("stop_id").alias("d_id"), "instance_id", F.col("time").alias("d_time"))
    # only pairs that are segments can matter, so they are joined before times are compared
    pairs = o.join(segments.select("o_id", "d_id", "vehicle_name"), ["o_id", "vehicle_name"]).join(d, ["instance_id", "d_id"])
    timed = pairs.withColumn("seconds", F.col("d_time") - F.col("o_time")).where("seconds > 0")
    inside = R.interval_join(timed, intervals.where("active"), F.pmod("o_time", F.lit(86400)), "s", "e", inclusive=True)
    return inside.groupBy("o_id", "d_id", "interval_id", "vehicle_name").agg(F.min("s").alias("interval_start"), F.round(F.avg("seconds")).cast("int").alias("duration"))


def od_stats(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Distance, duration and speed in km/h of segments by interval and vehicle."""
    return segments.join(durations, ["o_id", "d_id", "vehicle_name"]).withColumn("speed", F.try_divide("dist", "duration") * 3.6)


#: Lines of a bundle, of which pairs are compared in one task.
BUNDLE = 64


def representative_lines(instances: DataFrame) -> DataFrame:
    """Of each trip's survey lines the one with the smallest mean Frechet distance to the others; instances(id, trip_id, line).

    Each pair of a trip is compared once. A trip's lines are numbered and go into bundles, and pairs of bundles meet in tasks of their
    own, however many lines a trip has; a row is a bundle of lines then, not a line, and sums come back. Means are compared to the
    nanometre, ties go to the smaller id. Trips of one line have no pair and no row.
    """
    numbered = instances.where("line is not null").select("trip_id", "id").withColumn("_n", F.row_number().over(Window.partitionBy("trip_id").orderBy("id")) - 1)
    placed = numbered.withColumn("_b", F.floor(F.col("_n") / BUNDLE)).drop("_n")
    rows = instances.join(placed, ["trip_id", "id"]).groupBy("trip_id", "_b").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), "line"))).alias("_l"))
    bundles = written(rows.select("trip_id", "_b", F.transform("_l", lambda x: x["id"]).alias("ids"), F.transform("_l", lambda x: x["line"]).alias("lines")), "bundles")
    counts = bundles.groupBy("trip_id").agg(F.max("_b").alias("_last"))
    # each bundle says which others it meets; a trip's pairs of bundles are dealt by both numbers
    asked = bundles.select("trip_id", "_b").join(counts, "trip_id").select("trip_id", F.col("_b").alias("a"), F.explode(F.sequence("_b", "_last")).alias("b"))
    pairs = asked.join(bundles.select("trip_id", F.col("_b").alias("a"), "ids", "lines"), ["trip_id", "a"])
    pairs = pairs.join(bundles.select("trip_id", F.col("_b").alias("b"), F.col("ids").alias("ids2"), F.col("lines").alias("lines2")), ["trip_id", "b"])
    sums = pairs.select("trip_id", F.explode(kernels.frechet_sums(F.col("ids"), F.col("lines"), F.col("ids2"), F.col("lines2"))).alias("s"))
    sizes = bundles.groupBy("trip_id").agg(F.sum(F.size("ids")).alias("_k")).where("_k > 1")
    totals = sums.groupBy("trip_id", F.col("s.id").alias("id")).agg(F.sum("s.d").alias("_d")).join(sizes, "trip_id")
    means = totals.select("trip_id", "id", (F.col("_d") / (F.col("_k") - 1)).alias("mean"))
    return R.first_by(means, ["trip_id"], [F.round("mean", 9), "id"])


def replace_geometry(trips: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """UPDATE ... FROM: rows with a match take its column."""
    new = found.select(key, F.col(column).alias("_new"))
    return trips.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
