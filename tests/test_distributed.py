"""Operators on tables of several partitions, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caravan.functions import geo
from caravan.operators import relational as R
from caravan.operators import spatial as S


def test_surrogate_keys_lose_no_row_of_wide_tables(spark):
    n = 200_000
    rows = spark.range(0, n, 1, 8).select((F.xxhash64("id")).alias("k"), F.col("id"), F.repeat(F.hex("id"), 512 // 6).alias("payload"))
    found = R.surrogate_key(rows, ["k", "id"], "gid", start=11)
    stats = found.agg(F.count("*").alias("n"), F.countDistinct("gid").alias("d"), F.min("gid").alias("lo"), F.max("gid").alias("hi")).first()
    assert tuple(stats) == (n, n, 11, n + 10)
    order = [r.id for r in found.orderBy("gid").select("id").limit(500).collect()]
    assert order == [r.id for r in rows.orderBy("k", "id").select("id").limit(500).collect()]
    assert R.surrogate_key(rows.where("id < 0"), ["k"]).count() == 0


def test_lag_runs_on_over_groups_and_partitions(spark):
    rows = spark.createDataFrame([(g, i, None if (g + i) % 7 == 0 else g * 100 + i) for g in range(300) for i in range(1 + g % 4)], "g int, i int, v int").repartition(7)
    found = {(r.g, r.i): r["before"] for r in R.lag_across_groups(rows, "g", ["i"], "v", "before").collect()}
    ordered = sorted((r.g, r.i, r.v) for r in rows.collect())
    assert found == {(g, i): (ordered[k - 1][2] if k else None) for k, (g, i, _) in enumerate(ordered)}


def brute_dbscan(points, eps, least):
    xy = np.array([p[1:] for p in points])
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    cluster = {}
    for i in range(len(points)):
        if core[i] and i not in cluster:
            todo, members = [i], {i}
            while todo:
                for k in np.flatnonzero(near[todo.pop()] & core):
                    if k not in members:
                        members.add(k)
                        todo.append(k)
            smallest = min(points[k][0] for k in members)
            cluster |= dict.fromkeys(members, smallest)
    out = {(points[i][0], c, True) for i, c in cluster.items()}
    for i in range(len(points)):
        if not core[i] and (reached := [cluster[k] for k in np.flatnonzero(near[i] & core)]):
            out.add((points[i][0], min(reached), False))
    return out


@pytest.mark.parametrize("least", [1, 3, 6])
def test_dbscan_of_dense_and_sparse_cells(spark, least):
    rng = np.random.default_rng(least)
    xy = [*rng.normal(0, 12, (150, 2)), *rng.normal((60, 10), 6, (60, 2)), *rng.uniform(-200, 200, (150, 2)), *[np.array([300.0, 300.0])] * 40, *[np.array([-300.0 + 10 * i, 0.0]) for i in range(12)]]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    found = S.dbscan(spark.createDataFrame(points, "id long, x double, y double"), 10.0, least).collect()
    assert {(r.id, r.cluster, r.core) for r in found} == brute_dbscan(points, 10.0, least) and len(found) == len({r.id for r in found})


def test_distance_join_of_lines_with_many_vertices(spark):
    rng = np.random.default_rng(4)
    points = [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-100, 100, (200, 2)))]
    lines = [(i, [(float(x), float(y)) for x, y in np.cumsum(rng.normal(0, 25, (n, 2)), 0)]) for i, n in enumerate([1, 2, 2, 5, 9, 30])] + [(9, [(0.0, -50.0), (0.0, 50.0)]), (10, [(5.0, 5.0), (5.0, 5.0)])]
    p = spark.createDataFrame(points, "id long, x double, y double").select("id", geo.point("x", "y").alias("point"))
    table = spark.createDataFrame(lines, "gid long, line array<struct<x:double,y:double>>")
    found = {(r.id, r.gid): r for r in S.distance_join(p, table, 15.0).collect()}
    want = {}
    for i, x, y in points:
        for gid, vertices in lines:
            best, done = (1e9, 0.0), 0.0
            for (ax, ay), (bx, by) in zip(vertices, vertices[1:] or vertices):
                d2 = (bx - ax) ** 2 + (by - ay) ** 2
                t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d2)) if d2 else 0
                best = min(best, (np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)), done + t * d2**0.5))
                done += d2**0.5
            if best[0] <= 15:
                want[i, gid] = (*best, done)
    assert set(found) == set(want)
    assert all(np.allclose((r.dist, r.along, r.total), want[k]) for k, r in found.items())
    nearest = {r.id: r.gid for r in S.nearest_within(p, table, 15.0, "id", "gid").collect()}
    assert nearest == {i: min((d[0], g) for (k, g), d in want.items() if k == i)[1] for i in {k for k, _ in want}}
