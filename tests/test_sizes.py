"""Steps whose work must not outgrow their input: their plans, and odd rows through them."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from caravan.functions import geo, kernels
from caravan.operators import relational as R
from caravan.operators import spatial as S
from caravan.plans import flow


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_not_broadcast(spark):
    frequencies = spark.createDataFrame([(1, 0, 100, 10), (1, 50, 100, 10), (2, 0, 95, 10)], "trip_id long, start_time long, end_time long, headway_secs long")
    matched = spark.createDataFrame([(1, 0, 7, 5), (1, 1, 7, 5), (1, 2, 8, 5), (2, 0, 7, 0), (3, 0, 7, 0)], "trip_id long, segment_order long, gid long, timestamp long")
    found = flow.vehicle_appearances(flow.expand_frequencies(frequencies), matched)
    assert "Broadcast" not in plan(found)
    got = sorted(tuple(r) for r in found.select("gid", "trip_id", "instance_no", "timeofday_secs", "segment_order").collect())
    runs = [(1, i, i * 10) for i in range(10)] + [(1, i, 50 + i * 10) for i in range(5)] + [(2, i, i * 10) for i in range(9)]
    want = {}
    for t, i, at in runs:
        for u, order, gid, ts in [(1, 0, 7, 5), (1, 1, 7, 5), (1, 2, 8, 5), (2, 0, 7, 0)]:
            if t == u:
                key = (gid, t, i, at + ts)
                want[key] = min(order, want.get(key, order))
    assert got == sorted((*k, v) for k, v in want.items())


LINE = "array<struct<x:double,y:double>>"
POINT = "struct<x:double,y:double>"


def test_pairs_of_short_lines_are_not_shuffled(spark):
    points = [(i, (float(i % 20), float(i // 20))) for i in range(200)] + [(900, None), (901, (None, 1.0))]
    lines = [(1, [(0.0, 0.0), (19.0, 9.0)]), (2, [(5.0, 5.0)]), (3, []), (4, None), (5, [(0.0, 9.0), (10.0, 0.0), (19.0, 9.0)]), (6, [(3.0, 3.0), (3.0, 3.0)])]
    found = S.distance_join(spark.createDataFrame(points, f"id long, point {POINT}"), spark.createDataFrame(lines, f"gid long, line {LINE}"), 1.5)
    assert not re.search(r"hashpartitioning\(id#\d+L, gid#", plan(found))

    def nearest(p, line):
        edges = [(line[0], line[0])] if len(line) == 1 else list(zip(line, line[1:], strict=False))
        best, before = None, 0.0
        for a, b in edges:
            d = (b[0] - a[0], b[1] - a[1])
            square = d[0] ** 2 + d[1] ** 2
            t = min(1.0, max(0.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / square)) if square else 0.0
            at = math.dist(p, (a[0] + t * d[0], a[1] + t * d[1]))
            if best is None or at < best[0]:
                best = (at, before + t * math.sqrt(square))
            before += math.sqrt(square)
        return best

    want = {(i, g): nearest(p, line) for i, p in points if p and None not in p for g, line in lines if line}
    want = {k: v for k, v in want.items() if v[0] <= 1.5}
    got = {(r.id, r.gid): (r.dist, r.along) for r in found.collect()}
    assert set(got) == set(want) and all(math.isclose(got[k][i], want[k][i], abs_tol=1e-9) for k in got for i in (0, 1))
    near = S.nearest_within(spark.createDataFrame(points, f"id long, point {POINT}"), spark.createDataFrame(lines, f"gid long, line {LINE}"), 1.5, "id", "gid")
    assert {r.id: r.gid for r in near.collect()} == {i: min((want[k][0], k[1]) for k in want if k[0] == i)[1] for i, _ in want}


def test_lag_writes_wanted_rows_alone(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(R, "written", lambda df, label: sizes.append((label, df.count())) or df.localCheckpoint())
    rows = spark.createDataFrame([(g, i, g * 50 + i) for g in range(20) for i in range(100)], "g int, i int, v int")
    found = R.lag_across_groups(rows, "g", ["i"], "v", "before", "n", lambda v, before: v - before < 0)
    assert sorted((r.g, r.i, r.v, r.before, r.n) for r in found.collect()) == [(g, 0, g * 50, (g - 1) * 50 + 99, 1) for g in range(1, 20)]
    assert dict(sizes)["lagged"] == 40


def test_pairs_of_lines_meet_once(spark):
    rng = np.random.default_rng(3)
    lines = [(i, [tuple(map(float, v)) for v in rng.integers(0, 400, (2, 2)) * (1, 0.2)]) for i in range(60)] + [(60 + i, [tuple(map(float, v)) for v in rng.integers(0, 900, (1 + i % 4, 2))]) for i in range(20)]
    rows = spark.createDataFrame(lines, f"id_1 long, line {LINE}")
    found = S.line_pairs(rows, rows.withColumnRenamed("id_1", "id_2"), 5.0, ["id_1"], ["id_2"])
    assert "BroadcastHashJoin" not in plan(found)
    t = np.linspace(0, 1, 2001)[:, None]
    spread = {i: np.concatenate([np.array(a) + t * (np.array(b) - np.array(a)) for a, b in (zip(v, v[1:], strict=False) if len(v) > 1 else [(v[0], v[0])])]) for i, v in lines}
    got = {(r.id_1, r.id_2): r.dist for r in found.collect()}
    assert len(got) == found.count()
    for i, a in lines[::5]:
        for j, _ in lines:
            d = min(float(np.hypot(*(spread[j] - p).T).min()) for p in spread[i][:: 1 if len(a) < 2 else 20])
            if d < 4.9:
                assert (i, j) in got and got[i, j] <= d + 1e-9
            if d > 5 + 10:
                assert (i, j) not in got


def test_clips_take_all_pairs_at_once():
    rng = np.random.default_rng(0)
    lines, others = ([rng.integers(0, 60, (int(rng.integers(0, 6)), 2)).astype(float) for _ in range(400)] for _ in "ab")
    flat = lambda rows: (np.concatenate(rows), np.r_[0, np.cumsum([len(x) for x in rows])])
    xy, sizes, parts = kernels.clips(*flat(lines), *flat(others), 10.0)
    each = [kernels.clip_near(a, b, 10.0) for a, b in zip(lines, others, strict=True)]
    assert parts.tolist() == [len(x) for x in each] and sizes.tolist() == [len(p) for x in each for p in x]
    assert np.array_equal(xy, np.concatenate([p for x in each for p in x]))
    t = np.linspace(0, 1, 200)[:, None]
    for found, other in zip(each, others, strict=True):
        if len(other) > 1:
            dense = np.concatenate([a + t * (b - a) for a, b in zip(other, other[1:], strict=False)])
            assert all(np.hypot(*(dense - v).T).min() < 10.2 for part in found for v in part)


def test_lines_of_a_batch_are_simplified_at_once():
    rng = np.random.default_rng(0)
    lines = [rng.integers(0, 60, (int(rng.integers(0, 9 if k % 50 else 80)), 2)).astype(float) for k in range(600)]
    xy, at = np.concatenate(lines), np.r_[0, np.cumsum([len(x) for x in lines])]
    for apart, one in ((False, kernels.kept), (True, kernels.kept_apart)):
        found = kernels.kept_all(xy, at, 10.0, apart)
        assert all(np.array_equal(found[at[k] : at[k + 1]], one(x, 10.0) if len(x) > 2 else np.ones(len(x), bool)) for k, x in enumerate(lines))
    assert len(kernels.kept_all(np.empty((0, 2)), np.array([0, 0]), 1.0, True)) == 0


def test_cut_edges_are_measured_segments(spark):
    rows = [(1, [(0.0, 0.0), (1000.0, 1.0), (1000.0, 1.0), (900.0, 50.0)]), (2, [(1.0, 1.0)]), (3, []), (4, None), (5, [(0.1, 0.2), (0.3, 700.0)])]
    frame = spark.createDataFrame(rows, f"id long, line {LINE}").coalesce(1)
    both = frame.select("id", kernels.cut_edges(F.col("line"), 300.0).alias("a"), geo.measured_edges(geo.segmentize(F.col("line"), 300.0)).alias("b")).collect()
    assert all(r.a == r.b for r in both if r.id != 4) and {r.id: len(r.a) for r in both if r.a is not None} == {1: 6, 2: 0, 3: 0, 5: 3}


def test_model_runs_on_over_segments_without_speed(spark):
    a, b, c = (0.0, 0.0), (600.0, 0.0), (600.0, 300.0)
    rows = [(1, 0, 10.0, [a, b]), (1, 1, None, [b, c]), (1, 2, 5.0, [b, c, a]), (2, 0, 1.0, [b, c]), (3, 0, 2.0, [])]
    frame = spark.createDataFrame(rows, f"trip_id long, segment_order int, speed double, line {LINE}")
    found = flow.transport_model(frame).orderBy("trip_id", "point_order").collect()
    assert [(r.trip_id, r.segment_order, r.point_order) for r in found] == [(1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 2, 4), (1, 2, 5), (1, 2, 6), (2, 0, 0)]
    assert np.allclose([r.timestamp for r in found[:5]], [0, 30, 60, 60, 120]) and found[2].duration is None
    shifted = {(r.trip_id, r.point_order): r.timestamp for r in flow.transport_model(frame, compat_shift=True).collect()}
    assert math.isclose(shifted[2, 0], found[6].timestamp + found[6].duration) and shifted[1, 0] == 0 and shifted[1, 1] == 30


def test_cores_of_dense_cells_are_not_sorted(spark, monkeypatch):
    from test_distributed import brute_dbscan

    plans = []
    monkeypatch.setattr(S, "written", lambda df, label: plans.append((label, plan(df))) or df.localCheckpoint())
    rng = np.random.default_rng(8)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (500, 2)) * (1, 0.7))]
    points += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate([*rng.uniform(90, 160, (60, 2)), *[(69.9, 20.0)] * 9])]
    found = S.dbscan(spark.createDataFrame(points, "id long, x double, y double"), 10.0, 4).collect()
    assert {(r.id, r.cluster, r.core) for r in found} == brute_dbscan(points, 10.0, 4)
    assert len([1 for label, _ in plans if label in ("cells", "facing", "boxes")]) >= 3
    assert not any("SortAggregate" in text for label, text in plans if label in ("cells", "facing", "boxes"))


def test_visits_are_not_shuffled(spark):
    from caravan.plans import migrate

    rng = np.random.default_rng(2)
    stops = [(i, tuple(map(float, v))) for i, v in enumerate(rng.integers(0, 200, (60, 2)))] + [(7, (150.0, 10.0)), (7, (20.0, 20.0)), (None, (100.0, 100.0)), (None, (40.0, 40.0)), (90, None)]
    track = [(i, int(rng.integers(0, 6)), int(rng.integers(0, 1000)), tuple(map(float, v))) for i, v in enumerate(rng.integers(-10, 210, (300, 2)))]
    track += [(500, 1, None, (30.0, 30.0)), (501, None, 5, (30.0, 30.0)), (502, 1, 5, None), (503, 1, 3000, (None, 1.0)), (504, 5, None, (9000.0, 9000.0)), (505, 4, 7, (60.0, 0.0))]
    stops += [(80, (9010.0, 9000.0)), (81, (60.0, 30.0)), (82, (60.0, -30.000001))]
    runs = [(0, "finished", True, 5, "Bus"), (1, "finished", True, 9, "Bus"), (1, "finished", True, 8, "Bus"), (1, "finished", True, 4, None), (2, "open", True, 1, "Bus"), (3, "finished", False, 1, "Bus"), (4, "finished", True, None, "Van"), (5, "finished", True, 2, "Bus"), (None, "finished", True, 2, "Bus")]
    frames = spark.createDataFrame(track, f"id long, instance_id long, time long, point {POINT}"), spark.createDataFrame(runs, "id long, status string, valid boolean, trip_id long, vehicle_name string"), spark.createDataFrame(stops, f"stop_id long, point {POINT}")
    found = migrate.stop_visits(*frames, 30.0)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan(found))
    assert not any(re.match(r"id#\d+L, \d", keys) for keys in dealt)  # pairs, to meet their points again
    assert sum("stop_id" in keys and "instance_id" in keys for keys in dealt) <= 1  # that of stops whose key isn't theirs alone
    want = {}
    for _, instance, time, p in track:
        for run, status, valid, trip, vehicle in runs:
            if instance is not None and run == instance and status == "finished" and valid and p and None not in p:
                for stop, q in stops:
                    if q and math.dist(p, q) <= 30:
                        want.setdefault((instance, stop, vehicle), []).append((time, trip))
    least = lambda values, pick: pick((v for v in values if v is not None), default=None)
    want = {k: (least([t for t, _ in v], max), least([t for _, t in v], min)) for k, v in want.items()}
    rows = found.collect()
    assert {(r.instance_id, r.stop_id, r.vehicle_name): (r.time, r.trip_id) for r in rows} == want and len(rows) == len(want)


def test_segments_are_made_in_tasks_that_are_not_coalesced(spark):
    from caravan.plans import catalog

    text = plan(catalog.lead_od_segments(spark, "/root/testdata/sf0.001"))
    assert re.search(r"hashpartitioning\(trip_id#\d+L, \d+\), REPARTITION_BY_NUM", text) and text.count("Exchange") == 3


def odd_trips(spark, trips=60):
    """Stop times, lines and stops with what is rare: stops without a place or a row, times without a value, lines that are short, and
    calls at a stop that the line passes twice."""
    rng = np.random.default_rng(4)
    places = {k: (float(rng.integers(0, 3000)), float(rng.integers(0, 3000))) for k in range(12)}
    stops = [(k, p) for k, p in places.items() if k != 7] + [(90, None)]
    calls, lines = [], []
    for t in range(trips):
        at = [int(k) for k in rng.integers(0, 12, int(rng.integers(1, 9)))]
        lines.append((t, [places[k] for k in at] if t % 9 else [places[k] for k in at][:1]))
        for i, k in enumerate(at):
            stop = None if (t, i) == (3, 1) else 90 if (t + i) % 17 == 0 else k
            calls.append((t, stop, i + 1, None if (t + i) % 13 == 0 else f"{t % 30:02d}:{i * 7 % 60:02d}:{(t * i) % 60:02d}"))
    lines[1], lines[2] = (1, []), (2, None)
    frames = spark.createDataFrame(calls, "trip_id long, stop_id long, stop_sequence long, arrival_time string"), spark.createDataFrame(lines, f"trip_id long, line {LINE}"), spark.createDataFrame(stops, f"stop_id long, point {POINT}")
    return frames, calls, dict(lines), dict(stops)


def test_legs_are_parts_of_lines(spark):
    (stop_times, lines, stops), calls, line_of, place = odd_trips(spark)
    found = flow.trip_segments(stop_times, lines, stops)
    assert not re.search(r"hashpartitioning\((from|to)_id", plan(found)) and plan(found).count("Exchange hashpartitioning") <= 4
    seconds = lambda text: None if text is None else sum(int(x) * k for x, k in zip(text.split(":"), (3600, 60, 1), strict=True))
    asked, first = [], {}
    for a, b in zip(calls, calls[1:], strict=False):
        if a[0] == b[0] and a[1] is not None and a[3] is not None:
            first[a[0]] = min(seconds(a[3]), first.get(a[0], math.inf))
            if place.get(a[1]) and place.get(b[1]) and line_of[a[0]]:
                asked.append((a[0], b[2] - 1, line_of[a[0]], place[a[1]], place[b[1]], seconds(a[3]), seconds(b[3])))
    frame = spark.createDataFrame(asked, f"trip_id long, segment_order int, line {LINE}, p {POINT}, q {POINT}, t long, u long").coalesce(1)
    part = geo.substring(F.col("line"), geo.locate(F.col("line"), F.col("p"))["along"], geo.locate(F.col("line"), F.col("q"))["along"])
    want = {(r.trip_id, r.segment_order): r for r in frame.select("trip_id", "segment_order", "t", "u", part.alias("part"), geo.length(part).alias("length")).where("length > 0").collect()}
    got = {(r.trip_id, r.segment_order): r for r in found.collect()}
    assert set(got) == set(want) and len(got) > 80 and any(len(r.line) > 2 for r in got.values())
    for k, r in got.items():
        assert np.allclose(r.line, want[k].part, rtol=0, atol=1e-9) and math.isclose(r.length, want[k].length)
        assert r.trip_start_time == first[k[0]] and r.start_time == want[k].t - first[k[0]] and r.duration == (None if want[k].u is None else want[k].u - want[k].t)


def test_model_of_legs_is_not_shuffled(spark):
    (stop_times, lines, stops), *_ = odd_trips(spark)
    segments = flow.trip_segments(stop_times, lines, stops)
    found = flow.transport_model(segments)
    assert plan(found).count("Exchange") == plan(segments).count("Exchange")
    plain = segments.select("trip_id", "segment_order", "speed", "line")
    rows = lambda df: sorted((r.trip_id, r.point_order, r.segment_order, r.timestamp, r.length, r.line[0].x, r.line[1].x) for r in df.collect())
    assert np.allclose(rows(found), rows(flow.transport_model(plain)), rtol=0, atol=1e-6)


def test_shift_over_trips_carries_no_lines(spark, monkeypatch):
    kinds = {}
    monkeypatch.setattr(R, "written", lambda df, label: kinds.update({label: df.dtypes}) or df.localCheckpoint())
    (stop_times, lines, stops), *_ = odd_trips(spark)
    segments = flow.trip_segments(stop_times, lines, stops)
    found = {(r.trip_id, r.point_order): r.timestamp for r in flow.transport_model(segments, compat_shift=True).collect()}
    assert not any("array" in kind for _, kind in kinds["lagged"])
    totals = {r.trip_id: r.s for r in flow.transport_model(segments).groupBy("trip_id").agg(F.coalesce(F.sum("duration"), F.lit(0.0)).alias("s")).collect()}
    trips = sorted(totals)
    assert all(math.isclose(found[t, 0], totals[before] if before is not None else 0.0, abs_tol=1e-6) for before, t in zip([None, *trips], trips, strict=False))


def test_calls_are_dealt_to_trips_once(spark):
    from caravan.plans import mapping as M

    calls = M.calls(spark, "/root/testdata/sf0.001")
    assert plan(calls.withColumn("d", R.running_sum("q", ["trip_id"], ["seq"]))).count("Exchange") == 1


def test_rounding_is_that_of_sql(spark):
    import duckdb

    rng = np.random.default_rng(5)
    values = [*rng.uniform(-9000, 9000, 500).tolist(), 0.03125, -0.03125, 2.5, 1e300, -1e17, 0.0, 0.00005, 1.0005, 5e-324, None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").coalesce(1)
    got = [r.r for r in frame.select("i", geo.rounded(F.col("v"), 4).alias("r")).orderBy("i").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    assert got == [r[0] for r in con.execute("SELECT round(v, 4) FROM t ORDER BY i").fetchall()]


def test_long_edges_are_few_rows_and_meet_leaves(spark):
    rng = np.random.default_rng(6)
    spots = [*rng.uniform(0, 1000, (400, 2)), *rng.uniform(300, 310, (300, 2)), *[(500.0, 500.0)] * 80]
    points = spark.createDataFrame([(i, tuple(map(float, v))) for i, v in enumerate(spots)], f"id long, point {POINT}")
    ends = rng.uniform(0, 1000, (40, 2, 2))
    lines = spark.createDataFrame([(g, [tuple(map(float, v)) for v in line]) for g, line in enumerate(ends)], f"gid long, line {LINE}")
    edges = S.edge_table(lines, "line", "gid")
    cell = S._cell_size(edges, 2.0)
    assert S.edge_cells(edges, 2.0, cell).count() < 25 * len(ends)
    leaves = S._leaves(S._placed(points, cell, "point"), F.lit(2.0), cell).collect()
    assert sum(len(r._points) for r in leaves) == len(spots) and max(len(r._points) for r in leaves) <= S.LEAF
    assert all(r._x1 <= p._x <= r._x2 and r._y1 <= p._y <= r._y2 for r in leaves for p in r._points)
    d = ends[:, 1] - ends[:, 0]
    t = np.clip(((np.array(spots)[:, None] - ends[None, :, 0]) * d).sum(2) / (d * d).sum(1), 0, 1)
    far = np.hypot(*np.moveaxis(np.array(spots)[:, None] - ends[None, :, 0] - t[..., None] * d, 2, 0))
    got = {(r.id, r.gid): r.dist for r in S.distance_join(points, lines, 2.0).collect()}
    assert set(got) == set(zip(*map(list, np.nonzero(far <= 2.0)), strict=True)) and all(math.isclose(v, far[k], abs_tol=1e-9) for k, v in got.items())


def test_short_geodesics_need_no_python(spark):
    from caravan.functions import spheroid

    rng = np.random.default_rng(7)
    at = np.column_stack([rng.uniform(-180, 180, 400), rng.uniform(-79, 79, 400)])
    points = [(i, tuple(map(float, v))) for i, v in enumerate(at)]
    lines = [(i, [tuple(map(float, v + rng.uniform(-3e-4, 3e-4, 2))), tuple(map(float, v + rng.uniform(-3e-4, 3e-4, 2)))]) for i, v in enumerate(at)]
    found = S.geodesic_join(spark.createDataFrame(points, f"id long, point {POINT}"), spark.createDataFrame(lines, f"gid long, line {LINE}"), 30.0).select("id", "gid", "point", "near", "dist")
    assert "ArrowEvalPython" not in plan(found)
    rows = found.collect()
    exact = spheroid.distances(*np.array([(r.point.x, r.point.y, r.near.x, r.near.y) for r in rows]).T)
    assert len(rows) > 200 and np.abs(exact - [r.dist for r in rows]).max() < 5e-9
    assert "ArrowEvalPython" in plan(S.geodesic_join(spark.createDataFrame(points, f"id long, point {POINT}"), spark.createDataFrame(lines, f"gid long, line {LINE}"), 3000.0).select("id", "gid", "dist"))


def test_nearest_lines_are_looked_for_near_first(spark, monkeypatch):
    rng = np.random.default_rng(8)
    spots, ends = rng.uniform(0, 200, (150, 2)), rng.uniform(0, 200, (500, 2, 2))
    spots[:3] = [(260.0, 260.0), (-50.0, -90.0), ends[7, 0]]
    points = spark.createDataFrame([(i, tuple(map(float, v))) for i, v in enumerate(spots)], f"id long, point {POINT}")
    lines = spark.createDataFrame([(g, [tuple(map(float, v)) for v in line]) for g, line in enumerate(ends)], f"gid long, line {LINE}")
    asked, meet = [], S._meet
    monkeypatch.setattr(S, "_meet", lambda placed, cells, reach, cell: asked.append(placed.count()) or meet(placed, cells, reach, cell))
    got = {r.id: (r.gid, r.dist) for r in S.nearest_within(points, lines, 100.0, "id", "gid").collect()}
    assert len(asked) >= 3 and asked[0] == 150 and asked[-2] < 75  # fewer look as far as the reach
    d = ends[:, 1] - ends[:, 0]
    t = np.clip(((spots[:, None] - ends[None, :, 0]) * d).sum(2) / (d * d).sum(1), 0, 1)
    far = np.hypot(*np.moveaxis(spots[:, None] - ends[None, :, 0] - t[..., None] * d, 2, 0))
    assert set(got) == set(np.flatnonzero(far.min(1) <= 100)) and all(g == far[i].argmin() and math.isclose(v, far[i].min(), abs_tol=1e-9) for i, (g, v) in got.items())


def test_stops_of_dense_trips_are_neither_shuffled_nor_sorted(spark, monkeypatch):
    from caravan.plans import migrate

    rng = np.random.default_rng(9)
    stops = [(i, tuple(map(float, v))) for i, v in enumerate(rng.integers(0, 500, (150, 2)) * (1, 0.02))] + [(1000 - i, (40.0 + i % 2, 3.0)) for i in range(300)]
    trips = [(1, [(0.0, 0.0), (500.0, 10.0)]), (2, [(500.0, 0.0), (0.0, 5.0)]), (3, [(60.0, 0.0), (40.0, 9.0)]), (4, [(5.0, 5.0)]), (5, [(0.0, 9.0), (200.0, 9.0), (0.0, 9.0)]), (6, [(460.0, 2.0), (490.0, 2.0)])]
    frames = spark.createDataFrame(stops, f"stop_id long, point {POINT}"), spark.createDataFrame(trips, f"trip_id long, line {LINE}")
    sizes = []
    monkeypatch.setattr(R, "written", lambda df, label: sizes.append((label, df.count())) or df.localCheckpoint())
    found = migrate.trip_stops_sequence(*frames, reach=12.0, spacing=8.0)
    assert dict(sizes)["lagged"] < 250
    rows = sorted((r.trip_id, r.along / r.total if r.total else 0.0, r.stop_id, r.total) for r in S.distance_join(*frames, 12.0, "stop_id", "trip_id").collect())
    want, number, before, last = [], 0, None, None
    for trip, frac, stop, total in rows:
        number = number + 1 if trip == last else 1
        if before is not None and frac * total - before >= 8.0:
            want.append((trip, stop, number, frac * total, frac * total - before))
        before, last = frac * total, trip
    got = sorted((r.trip_id, r.stop_id, r.stop_sequence, r.distance, r.distance_from_prev) for r in found.collect())
    assert len(rows) > 1000 and len(want) > 5 and [w[:3] for w in sorted(want)] == [g[:3] for g in got] and np.allclose([w[3:] for w in sorted(want)], [g[3:] for g in got])


def test_only_stops_of_segments_are_visited(spark, monkeypatch):
    from caravan.plans import catalog as C
    from caravan.plans import catalog_sdi, migrate

    asked, visits = [], migrate.stop_visits
    monkeypatch.setattr(migrate, "stop_visits", lambda points, instances, stops: asked.append(stops.count()) or visits(points, instances, stops))
    C.QUERIES["od_stats_trackpoints"](spark, "/root/testdata/sf0.01")
    segments = migrate.od_segments(C._sequence(spark, "/root/testdata/sf0.01").withColumn("vehicle_name", F.lit("Bus")))
    assert asked == [segments.select(F.explode(F.array("o_id", "d_id"))).distinct().count()] and catalog_sdi.C is C


def test_matched_pairs_are_not_shuffled(spark):
    rng = np.random.default_rng(10)
    ends = rng.uniform(0, 300, (40, 2, 2))
    segments = spark.createDataFrame([(i, 0, 10.0, [tuple(map(float, v)) for v in line + 2]) for i, line in enumerate(ends)], f"trip_id long, segment_order int, speed double, line {LINE}")
    roads = spark.createDataFrame([(i, [tuple(map(float, v)) for v in line]) for i, line in enumerate(ends)], f"gid long, line {LINE}")
    found = flow.match_to_roads(segments, flow.transport_model(segments), roads)
    assert "WindowGroupLimit" not in plan(found)
    assert {(r.trip_id, r.gid) for r in found.collect()} >= {(i, i) for i in range(40)}


def test_boxes_are_not_shuffled(spark):
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (5.0, 5.0)])], f"id_1 long, line {LINE}")
    text = S.line_pairs(lines, lines.withColumnRenamed("id_1", "id_2"), 5.0, ["id_1"], ["id_2"])._jdf.queryExecution().optimizedPlan().toString()
    below = [text.splitlines()[i + 1] for i, line in enumerate(text.splitlines()) if "RepartitionByExpression [cx" in line or "RepartitionByExpression [o_cx" in line]
    assert below and not any(re.search(r"[xy][12]#\d+", re.sub(r"\(.*?\)", "", line.split("[", 1)[1].split("]")[0])) for line in below if "Project" in line)


def test_short_frechet_distances_are_those_of_tables():
    rng = np.random.default_rng(11)
    p, q = rng.uniform(0, 9, (300, 2, 2)), rng.uniform(0, 9, (300, 2, 2))
    at = np.arange(0, 601, 2)
    d = np.hypot(*np.moveaxis(p[:, :, None] - q[:, None], 3, 0))
    want = np.maximum(d[:, 1, 1], np.minimum(d[:, 0, 0], np.minimum(np.maximum(d[:, 0, 0], d[:, 0, 1]), np.maximum(d[:, 0, 0], d[:, 1, 0]))))
    assert np.array_equal(kernels.frechet_distances(p.reshape(-1, 2), at, q.reshape(-1, 2), at), want)


def test_boardings_and_places_are_not_shuffled_in_pairs(spark):
    segments = spark.createDataFrame([(1, 0, 10.0, 0, [(0.0, 0.0), (900.0, 0.0)])], f"trip_id long, segment_order int, speed double, start_time long, line {LINE}")
    model = flow.transport_model(segments).join(segments.select("trip_id", "segment_order", "start_time"), ["trip_id", "segment_order"])
    boardings = spark.createDataFrame([(1, 5, 100, 1, 7, 2, (300.0, 4.0)), (1, 5, 200, 2, 1, 0, (-5.0, 0.0))], f"trip_id long, instance_id long, departed long, created_at long, board long, alight long, point {POINT}")
    intervals = spark.createDataFrame([("a", 0, 1000)], "interval_name string, s long, e long")
    _, occupied = flow.segment_occupancy(model, boardings, intervals)
    assert not re.search(r"hashpartitioning\(_n#\d+L", plan(occupied))
    assert [(r.point_order, r.occupancy) for r in occupied.orderBy("point_order", "occupancy").collect()] == [(0, 5), (0, 6), (1, 11), (2, 11)]
