"""Kernels against values worked out by hand."""

import math

import numpy as np
from pyspark.sql import functions as F

from caravan.functions import geo, kernels, times
from caravan.plans import flow


def line(*points):
    return F.array(*(geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in points))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_frechet(spark):
    p, q = line((0, 0), (1, 0), (2, 0)), line((0, 1), (2, 1))
    assert value(spark, geo.frechet(p, q)) == math.sqrt(2)
    assert value(spark, geo.frechet_any(p, F.reverse(p))) == 0
    assert kernels.discrete_frechet(np.array([[0, 0], [1, 0], [2, 0]], float), np.array([[0, 1], [2, 1]], float)) == math.sqrt(2)


def test_substring_reverses_and_inverts_locate(spark):
    whole = line((0, 0), (10, 0), (10, 10))
    assert [(p["x"], p["y"]) for p in value(spark, geo.substring(whole, F.lit(5.0), F.lit(15.0)))] == [(5, 0), (10, 0), (10, 5)]
    assert [(p["x"], p["y"]) for p in value(spark, geo.substring(whole, F.lit(15.0), F.lit(5.0)))] == [(10, 5), (10, 0), (5, 0)]
    for along in (0.0, 3.0, 10.0, 17.5, 20.0):
        assert value(spark, geo.locate(whole, geo.interpolate(whole, F.lit(along))))["along"] == along


def test_segmentize_cuts_evenly(spark):
    assert np.allclose([p["x"] for p in value(spark, geo.segmentize(line((0, 0), (700, 0)), 300.0))], [0, 700 / 3, 1400 / 3, 700])


def test_capsule_clip():
    parts = kernels.clip_near(np.array([[5, -5], [5, 5]], float), np.array([[0, 0], [10, 0]], float), 1.0)
    assert len(parts) == 1 and np.allclose(parts[0], [[5, -1], [5, 1]])


def test_direction_bins(spark):
    assert [value(spark, geo.direction_bin(F.lit(float(b)))) for b in (44, 45, 225, 226)] == [0, 1, 1, 0]


def test_mercator_round_trip(spark):
    p = value(spark, geo.inverse_mercator(geo.mercator(geo.point(F.lit(31.25), F.lit(30.05)))))
    assert abs(p["x"] - 31.25) < 1e-9 and abs(p["y"] - 30.05) < 1e-9


def test_wkt_and_geojson_round_trip(spark):
    whole = line((0, 0.5), (10, -2))
    assert value(spark, geo.from_wkt(geo.to_wkt(whole)) == whole)
    assert value(spark, geo.from_geojson(geo.to_geojson(whole)) == whole)


def test_times(spark):
    assert value(spark, times.parse_hms(F.lit("25:10:05"))) == 90605
    assert value(spark, times.format_hms(F.lit(90605))) == "25:10:05"
    assert value(spark, times.format_hms(F.lit(90605), wrap=True)) == "01:10:05"
    assert value(spark, times.parse_hms(F.lit("no"))) is None


def test_expand_frequencies(spark):
    rows = spark.createDataFrame([("a", 0, 1000, 300), ("b", 0, 100, 300)], "trip_id string, start_time long, end_time long, headway_secs long")
    assert sorted(r.trip_start_time for r in flow.expand_frequencies(rows).collect()) == [0, 300, 600]
