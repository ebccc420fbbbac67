"""Lines and geodesics against published values, plain recursion and brute force."""

import math
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from caravan.functions import geo, kernels, spheroid, times
from caravan.operators import spatial as S
from caravan.plans import migrate

LINE = "array<struct<x:double,y:double>>"


def degrees(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


#: Published geodesics: longitude, latitude, longitude, latitude, metres.
PUBLISHED = [
    (-73.8, 40.6, -0.5, 51.6, 5551759.400),
    (0, 40, 137.84490004377, 41.79331020506, 10000000.0),
    (0, -30, 179.8, 29.9, 19989832.827610),  # nearly opposite
    (0, 0, 179.5, 0.5, 19936288.578965),
    (0, 0, 180, 0, 20003931.458625),
    (0, 90, 77, -90, 20003931.458625),
    (degrees(144, 25, 29.5244), degrees(-37, 57, 3.7203), degrees(143, 55, 35.3839), degrees(-37, 39, 10.1561), 54972.271),
]


def test_published_geodesics():
    *at, metres = map(np.array, zip(*PUBLISHED, strict=True))
    assert np.allclose(spheroid.distances(*at), metres, rtol=0, atol=1e-3)
    assert np.allclose(spheroid.distances(*at[2:], *at[:2]), metres, rtol=0, atol=1e-3)
    across = spheroid.distances([179.9, 539.9], [10, 10], [-179.9, -179.9], [10, 10])
    assert np.allclose(across, spheroid.distances([0, 0], [10, 10], [0.2, 0.2], [10, 10]), atol=1e-6)
    assert np.isnan(spheroid.distances([np.nan], [0], [0], [0]))[0] and spheroid.distances([5], [6], [5], [6])[0] == 0


def test_short_geodesics_to_ten_nanometres():
    rng = np.random.default_rng(1)
    x1, y1 = rng.uniform(-180, 180, 5000), rng.uniform(-80, 80, 5000)
    x2, y2 = x1 + rng.uniform(-2e-4, 2e-4, 5000), y1 + rng.uniform(-2e-4, 2e-4, 5000)
    wide = np.longdouble
    e2 = (2 - 1 / wide("298.257223563")) / wide("298.257223563")
    lon1, lat1, lon2, lat2 = (v.astype(wide) * np.arctan(wide(1)) / 45 for v in (x1, y1, x2, y2))
    n1, n2 = (6378137 / np.sqrt(1 - e2 * np.sin(v) ** 2) for v in (lat1, lat2))
    sides = (n2 * np.cos(lat2) * np.cos(lon2) - n1 * np.cos(lat1) * np.cos(lon1), n2 * np.cos(lat2) * np.sin(lon2) - n1 * np.cos(lat1) * np.sin(lon1), (n2 * np.sin(lat2) - n1 * np.sin(lat1)) * (1 - e2))
    chord = np.sqrt(sum(v**2 for v in sides))  # shorter than the geodesic by less than 1e-9 m here
    assert np.abs(spheroid.distances(x1, y1, x2, y2) - chord).max() < 1e-8


def test_lengths_of_lines(spark):
    rows = [(1, [(0.0, 40.0), (137.84490004377, 41.79331020506), (0.0, 40.0)]), (2, []), (3, None), (4, [(1.0, 1.0)]), (5, [(0.0, 0.0), (179.5, 0.5)])]
    found = {r.id: r.m for r in spark.createDataFrame(rows, f"id long, line {LINE}").coalesce(1).select("id", spheroid.geodesic_length(F.col("line")).alias("m")).collect()}
    assert abs(found[1] - 2e7) < 1e-3 and found[2] == found[4] == 0 and found[3] is None and abs(found[5] - 19936288.578965) < 1e-3


def test_geodesic_join_at_all_latitudes(spark):
    rng = np.random.default_rng(6)
    lines, points = [], []
    for k, (lon, lat) in enumerate([(31.2, 30.0), (10.0, 70.0), (20.0, 84.0), (179.9999, -50.0), (-179.9998, 12.0), (179.9, 65.0), (0.0, 88.5)]):
        east = lon + 0.002 / math.cos(math.radians(lat))
        lines.append((k, [(lon, lat), ((east + 180) % 360 - 180, lat + 0.001)]))
        for i in range(40):
            x = lon + rng.normal(0, 0.002) / math.cos(math.radians(lat))
            points.append((100 * k + i, ((x + 180) % 360 - 180, lat + rng.normal(0, 0.0007))))
    found = S.geodesic_join(spark.createDataFrame(points, "id long, point struct<x:double,y:double>"), spark.createDataFrame(lines, f"gid long, line {LINE}"), 60.0).select("id", "gid", "dist").collect()
    t = np.linspace(0, 1, 4001)
    near, unsure = {}, set()
    for gid, ((x1, y1), (x2, y2)) in lines:
        dx = (x2 - x1 + 180) % 360 - 180
        for i, (px, py) in points:
            if i // 100 == gid:
                d = spheroid.distances(np.full(len(t), px), np.full(len(t), py), x1 + t * dx, y1 + t * (y2 - y1)).min()
                unsure |= {(i, gid)} if abs(d - 60) < 0.5 else set()
                near |= {(i, gid): d} if d <= 60 else {}
    got = {(r.id, r.gid): r.dist for r in found}
    assert len(got) == len(found) and set(got) - unsure == set(near) - unsure and len(near) > 60
    assert all(abs(got[k] - near[k]) < 0.5 for k in got if k in near)
    with pytest.raises(ValueError, match="89"):
        S.geodesic_join(spark.createDataFrame([(1, (0.0, 89.5))], "id long, point struct<x:double,y:double>"), spark.createDataFrame(lines, f"gid long, line {LINE}"), 60.0)


def frechet(p, q):
    @cache
    def c(i, j):
        d = math.dist(p[i], q[j])
        before = [c(a, b) for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0]
        return max(d, min(before)) if before else d

    return c(len(p) - 1, len(q) - 1)


def test_frechet_by_diagonals(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, *([tuple(map(float, v)) for v in rng.integers(0, 20, (int(rng.integers(1, 60)), 2))] for _ in range(2))) for i in range(60)]
    monkeypatch.setattr(kernels, "CELLS", 5000)
    flat = lambda k: (np.array([v for r in rows for v in r[k]]), np.cumsum([0, *(len(r[k]) for r in rows)]))
    assert np.allclose(kernels.frechet_distances(*flat(1), *flat(2)), [frechet(p, q) for _, p, q in rows])
    frame = spark.createDataFrame([*rows, (60, None, [(0.0, 0.0)]), (61, [], [(0.0, 0.0)])], f"id long, p {LINE}, q {LINE}")
    got = {r.id: r.d for r in frame.select("id", kernels.frechet(F.col("p"), F.col("q"), either=True).alias("d")).collect()}
    assert got[60] is None and got[61] == math.inf and all(abs(got[i] - min(frechet(p, q), frechet(p[::-1], q))) < 1e-9 for i, p, q in rows)


def test_medoids_of_a_hot_trip(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 1 if i < 150 else i % 40, [tuple(map(float, v)) for v in np.cumsum(rng.normal(0, 1, (50 if i % 30 == 0 else 5, 2)), axis=0)]) for i in range(260)]
    got = {r.trip_id: (r.id, r.mean) for r in migrate.representative_lines(spark.createDataFrame(rows, f"id long, trip_id long, line {LINE}")).collect()}
    for trip in {t for _, t, _ in rows}:
        mine = [(i, line) for i, t, line in rows if t == trip]
        means = sorted((round(sum(frechet(a, b) for j, b in mine if j != i) / (len(mine) - 1), 9), i) for i, a in mine) if len(mine) > 1 else []
        assert (trip in got) == bool(means) and (not means or (got[trip][0] == means[0][1] and abs(got[trip][1] - means[0][0]) < 1e-6))


def crossed(points):
    return len(kernels.crossings(points))


def test_simplified_lines_stay_apart():
    rng = np.random.default_rng(4)
    changed = 0
    for _ in range(200):
        turn, steps = rng.normal(0, 0.9, 40), rng.uniform(0.2, 3, 40)
        points = np.cumsum(np.column_stack([np.cos(np.cumsum(turn)), np.sin(np.cumsum(turn))]) * steps[:, None], axis=0)
        brute = sum(1 for i in range(39) for j in range(i + 2, 39) if crossed_pair(points, i, j))
        assert crossed(points) == brute
        plain, apart = kernels.kept(points, 2.5), kernels.kept_apart(points, 2.5)
        assert not (plain & ~apart).any()
        if crossed(points) == 0:
            assert crossed(points[apart]) == 0
            changed += crossed(points[plain]) > 0
    assert changed >= 3


def crossed_pair(points, i, j):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    p, q, r, s = points[i], points[i + 1], points[j], points[j + 1]
    return side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0


def test_chains_are_merged():
    rng = np.random.default_rng(3)
    whole = np.cumsum(rng.normal(0, 1, (3001, 2)), axis=0)
    parts = [whole[i : i + 2] if rng.random() < 0.5 else whole[i : i + 2][::-1] for i in rng.permutation(3000)]
    (line,) = kernels.merged(parts)
    assert np.array_equal(line, whole) or np.array_equal(line[::-1], whole)
    cross = [np.array([[0, 0], [1, 0]], float), np.array([[1, 0], [2, 0]], float), np.array([[1, 0], [1, 5]], float)]
    assert len(kernels.merged(cross)) == 3  # three meet
    ring = [np.array([[0, 0], [1, 0]], float), np.array([[1, 1], [1, 0]], float), np.array([[1, 1], [0, 0]], float)]
    (loop,) = kernels.merged(ring)
    assert len(loop) == 4 and np.array_equal(loop[0], loop[-1])


def test_parts_of_lines(spark):
    comb = [(0.0, 0.0), (0.0, 10.0), (5.0, 10.0), (5.0, 0.0), (10.0, 0.0), (10.0, 10.0)]
    rows = [(1, comb, [(-5.0, 9.5), (20.0, 9.5)]), (2, comb, [(50.0, 50.0), (60.0, 50.0)]), (3, None, comb), (4, comb, comb)]
    got = {r.id: r.p for r in spark.createDataFrame(rows, f"id long, a {LINE}, b {LINE}").select("id", kernels.clip_parts(F.col("a"), F.col("b"), 1.0).alias("p")).collect()}
    assert [[tuple(v) for v in part] for part in got[1]] == [[(0.0, 8.5), (0.0, 10.0), (5.0, 10.0), (5.0, 8.5)], [(10.0, 8.5), (10.0, 10.0)]]
    assert got[2] == [] and got[3] is None and sum(len(p) for p in got[4]) >= 6


def test_dense_cells_side_by_side(spark):
    """Two cells of 20,000 points whose nearest points to each other's middle are apart, one that touches and one that doesn't."""
    rng = np.random.default_rng(7)
    side = 10 / math.sqrt(2)
    a = rng.uniform(0, 0.4, (20_000, 2)) * side
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(a)]
    b = np.column_stack([rng.uniform(2.2, 2.6, 20_000) * side, rng.uniform(0, 0.4, 20_000) * side])  # all of them over eps away
    points += [(30_000 + i, float(x), float(y)) for i, (x, y) in enumerate(b)]
    c = np.column_stack([rng.uniform(0, 0.4, 20_000) * side, rng.uniform(1.5, 1.9, 20_000) * side])
    c[0] = (0.0, a[:, 1][a[:, 0].argmin()] + 0.0)
    c[0] = (a[a[:, 0].argmin()][0], a[a[:, 0].argmin()][1] + 9.9999)
    points += [(60_000 + i, float(x), float(y)) for i, (x, y) in enumerate(c)]
    near = (c[:, None, 1].min() - a[:, 1].max()) <= 10
    found = S.dbscan(spark.createDataFrame(points, "id long, x double, y double"), 10.0, 3)
    clusters = {r.cluster: r.n for r in found.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert near and clusters == {0: 40_000, 30_000: 20_000}


def test_clocks_and_midnight(spark):
    moment = "2024-03-31 00:59:59", "2024-03-31 01:00:00", "2024-10-27 00:30:00", "2024-10-27 01:30:00"
    rows = spark.createDataFrame([(m,) for m in moment], "m string").withColumn("t", F.to_timestamp("m"))
    got = [r.s for r in rows.select("m", times.seconds_of_day(F.col("t"), F.lit("Europe/Paris")).alias("s")).orderBy("m").collect()]
    assert got == [7199, 10800, 9000, 9000]  # an hour is left out in spring and comes twice in autumn
    named = spark.createDataFrame([("n", 79200, 7200), ("d", 7200, 79200), ("w", 0, 86400), ("l", 79200, 93600), ("e", 3600, 86400), (None, None, 5)], "name string, s long, e long")
    cut = sorted((str(r.name), str(r.s), str(r.e)) for r in times.split_at_midnight(named).collect())
    assert cut == [("None", "None", "5"), ("d", "7200", "79200"), ("e", "3600", "86400"), ("l", "0", "7200"), ("l", "79200", "86400"), ("n", "0", "7200"), ("n", "79200", "86400"), ("w", "0", "86400")]
