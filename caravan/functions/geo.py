"""Planar and spherical geometry as Column expressions.

A point is struct<x:double,y:double>, a line array<point>. All expressions stay in the JVM. Null in, null out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: radius of the sphere of EPSG:3857, metres.
RADIUS = 6378137.0

LINE = "array<struct<x:double,y:double>>"


def point(x, y) -> Column:
    return F.struct(F.expr(str(x)).cast("double").alias("x") if not isinstance(x, Column) else x.cast("double").alias("x"), F.expr(str(y)).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    """A double to so many decimals, halves away from 0, by scaling, as SQL engines do; F.round() goes through the decimal text of
    each value, which takes longer than all else that is done with it. Doubles too large to have such decimals stay."""
    scale = 10.0**digits
    whole = F.floor(F.abs(value) * scale + 0.5).cast("double") / scale
    return F.when(F.abs(value) < 2.0**52 / scale, F.when(value < 0, -whole).otherwise(whole)).otherwise(value)


def mercator(p: Column) -> Column:
    """Longitude and latitude in degrees -> EPSG:3857 metres."""
    return point(F.radians(p["x"]) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(p["y"]) / 2)) * RADIUS)


def inverse_mercator(p: Column) -> Column:
    return point(F.degrees(p["x"] / RADIUS), F.degrees(F.atan(F.exp(p["y"] / RADIUS)) * 2 - F.lit(math.pi / 2)))


def mercator_line(line: Column) -> Column:
    return F.transform(line, mercator)


def distance(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


def haversine(p: Column, q: Column, radius: float = 6371008.8) -> Column:
    """Metres on the mean sphere; up to 0.5 % off the spheroid."""
    a = F.pow(F.sin(F.radians(q["y"] - p["y"]) / 2), 2) + F.cos(F.radians(p["y"])) * F.cos(F.radians(q["y"])) * F.pow(F.sin(F.radians(q["x"] - p["x"]) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * 2 * radius


def is_valid(line: Column) -> Column:
    """At least two distinct points, all finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.coalesce((F.size(F.array_distinct(line)) >= 2) & F.forall(line, lambda p: finite(p["x"]) & finite(p["y"])), F.lit(False))


def is_empty(line: Column) -> Column:
    return F.coalesce(F.size(line) == 0, F.lit(True))


def start_point(line: Column) -> Column:
    return F.get(line, F.lit(0))


def end_point(line: Column) -> Column:
    return F.try_element_at(line, F.lit(-1))


def edges(line: Column) -> Column:
    """array<struct<a,b>> of consecutive vertices."""
    n = F.size(line) - 1
    return F.when(n <= 0, F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")).otherwise(
        F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    )


def measured_edges(line: Column) -> Column:
    """array<struct<a,b,at,len>>: at is the length before the edge."""
    empty = F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>,at:double,len:double>>")
    start = F.struct(empty.alias("out"), F.lit(0.0).alias("at"))

    def step(state: Column, e: Column) -> Column:
        n = distance(e["a"], e["b"])
        row = F.struct(e["a"].alias("a"), e["b"].alias("b"), state["at"].alias("at"), n.alias("len"))
        return F.struct(F.concat(state["out"], F.array(row)).alias("out"), (state["at"] + n).alias("at"))

    return F.aggregate(edges(line), start, step, lambda s: s["out"])


def length(line: Column) -> Column:
    return F.aggregate(edges(line), F.lit(0.0), lambda s, e: s + distance(e["a"], e["b"]))


def centroid(line: Column) -> Column:
    """Centre of a line's edges, weighted by their lengths; of a line without length, its first point."""
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("l"))

    def step(s: Column, e: Column) -> Column:
        n = distance(e["a"], e["b"])
        return F.struct((s["x"] + n * (e["a"]["x"] + e["b"]["x"]) / 2).alias("x"), (s["y"] + n * (e["a"]["y"] + e["b"]["y"]) / 2).alias("y"), (s["l"] + n).alias("l"))

    return F.aggregate(edges(line), start, step, lambda s: F.when(s["l"] > 0, point(s["x"] / s["l"], s["y"] / s["l"])).otherwise(start_point(line)))


def clamped_parameter(p: Column, a: Column, b: Column) -> Column:
    """Where on the edge a-b, from 0 to 1, is nearest to p."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    dot = (p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy
    return F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / square)))


def on_edge(a: Column, b: Column, t: Column) -> Column:
    return point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"]))


def point_edge_distance(p: Column, a: Column, b: Column) -> Column:
    return distance(p, on_edge(a, b, clamped_parameter(p, a, b)))


def locate(line: Column, p: Column) -> Column:
    """struct<dist, along, total>: distance from p to the line, length up to the nearest place, length of the line.

    Of places at the same distance the first one counts.
    """

    def step(s: Column, e: Column) -> Column:
        n = distance(e["a"], e["b"])
        t = clamped_parameter(p, e["a"], e["b"])
        d = distance(p, on_edge(e["a"], e["b"], t))
        nearer = s["dist"].isNull() | (d < s["dist"])
        return F.struct(F.when(nearer, d).otherwise(s["dist"]).alias("dist"), F.when(nearer, s["total"] + t * n).otherwise(s["along"]).alias("along"), (s["total"] + n).alias("total"))

    start = F.struct(F.lit(None).cast("double").alias("dist"), F.lit(None).cast("double").alias("along"), F.lit(0.0).alias("total"))
    return F.aggregate(edges(line), start, step)


def locate_fraction(line: Column, p: Column) -> Column:
    return let(locate(line, p), lambda found: F.when(found["total"] > 0, found["along"] / found["total"]).otherwise(F.lit(0.0)))


def point_line_distance(line: Column, p: Column) -> Column:
    return F.coalesce(locate(line, p)["dist"], distance(start_point(line), p))


def _at(line: Column, parts: Column, along: Column) -> Column:
    inside = F.filter(parts, lambda e: (e["at"] + e["len"] >= along) & (e["len"] > 0))
    on = let(F.get(inside, F.lit(0)), lambda e: F.when(e.isNull(), end_point(line)).otherwise(on_edge(e["a"], e["b"], F.greatest(F.lit(0.0), (along - e["at"]) / e["len"]))))
    return F.when(along <= 0, start_point(line)).otherwise(on)


def interpolate(line: Column, along: Column) -> Column:
    """The point at a length along a line, clamped to its ends."""
    return let(along, lambda d: let(measured_edges(line), lambda parts: _at(line, parts, d)))


def closest_point(line: Column, p: Column) -> Column:
    return interpolate(line, locate(line, p)["along"])


def substring(line: Column, d1: Column, d2: Column) -> Column:
    """The part of a line between two lengths along it; reversed where d1 is over d2, and two equal points where they meet."""

    def part(ends: Column, parts: Column) -> Column:
        lo, hi = F.least(ends["a"], ends["b"]), F.greatest(ends["a"], ends["b"])
        inner = F.transform(F.filter(parts, lambda e: (e["at"] > lo) & (e["at"] < hi)), lambda e: e["a"])
        forward = F.concat(F.array(_at(line, parts, lo)), inner, F.array(_at(line, parts, hi)))
        return let(forward, lambda f: F.when(ends["a"] > ends["b"], F.reverse(f)).otherwise(f))

    return let(F.struct(d1.alias("a"), d2.alias("b")), lambda ends: let(measured_edges(line), lambda parts: part(ends, parts)))


def azimuth(p: Column, q: Column) -> Column:
    """Degrees clockwise from north, from 0 up to 360; null for equal points."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    a = F.degrees(F.atan2(dx, dy))
    return F.when((dx == 0) & (dy == 0), F.lit(None).cast("double")).otherwise(F.when(a < 0, a + 360).otherwise(a))


def direction_bin(bearing: Column) -> Column:
    """1 for bearings that round to 45 to 225 degrees, else 0, null included."""
    whole = F.round(bearing + 360).cast("int") % 360
    return F.when(whole.between(45, 225), F.lit(1)).otherwise(F.lit(0))


def segmentize(line: Column, longest) -> Column:
    """The line with vertices added so that no edge is over a length."""

    def cut(e: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(distance(e["a"], e["b"]) / F.lit(longest))).cast("int")
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == n, e["b"]).otherwise(on_edge(e["a"], e["b"], i / n)))

    return F.when(F.size(line) < 2, line).otherwise(F.concat(F.slice(line, 1, 1), F.flatten(F.transform(edges(line), cut))))


def frechet(p: Column, q: Column) -> Column:
    """Discrete Frechet distance: an aggregate over p carries the row of the dynamic programme over q."""
    huge = F.lit(float("inf"))

    def row(before: Column, a: Column, first: Column) -> Column:
        def step(done: Column, i: Column) -> Column:
            d = distance(a, F.get(q, i))
            left = F.coalesce(F.get(done, i - 1), huge)
            up = F.when(first, huge).otherwise(F.coalesce(F.get(before, i), huge))
            corner = F.when(first, huge).otherwise(F.coalesce(F.get(before, i - 1), huge))
            origin = first & (i == 0)
            return F.concat(done, F.array(F.when(origin, d).otherwise(F.greatest(d, F.least(left, up, corner)))))

        return F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), F.array().cast("array<double>"), step)

    rows = F.aggregate(p, F.array().cast("array<double>"), lambda before, a: row(before, a, F.size(before) == 0))
    return F.when((F.size(p) == 0) | (F.size(q) == 0), huge).otherwise(F.try_element_at(rows, F.lit(-1)))


def frechet_any(p: Column, q: Column) -> Column:
    """The smaller of the distances with p as it is and reversed."""
    return F.least(frechet(p, q), frechet(F.reverse(p), q))


def bounds(line: Column) -> Column:
    """struct<x1,y1,x2,y2>."""
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def clip_edge(a: Column, b: Column, box: Column) -> Column:
    """struct<t0,t1>, the part of an edge within a box by its four half-planes; null where there is none."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    sides = [(-dx, a["x"] - box["x1"]), (dx, box["x2"] - a["x"]), (-dy, a["y"] - box["y1"]), (dy, box["y2"] - a["y"])]
    enter = [F.when(p < 0, q / F.nullif(p, F.lit(0.0))) for p, q in sides]
    leave = [F.when(p > 0, q / F.nullif(p, F.lit(0.0))) for p, q in sides]
    t0, t1 = F.greatest(F.lit(0.0), *enter), F.least(F.lit(1.0), *leave)
    outside = F.lit(False)
    for p, q in sides:
        outside = outside | ((p == 0) & (q < 0))
    return F.when(~outside & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def to_wkt(line: Column) -> Column:
    pair = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    return F.when(F.size(line) == 0, F.lit("LINESTRING EMPTY")).otherwise(F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, pair), ", "), F.lit(")")))


def from_wkt(text: Column) -> Column:
    """A line from LINESTRING text, or of one point from POINT text."""
    inner = F.regexp_extract(text, r"(?i)^\s*(?:SRID=\d+;)?\s*(?:LINESTRING|POINT)\s*\(([^)]*)\)", 1)
    pair = lambda t: point(F.try_element_at(F.split(F.trim(t), r"\s+"), F.lit(1)).cast("double"), F.try_element_at(F.split(F.trim(t), r"\s+"), F.lit(2)).cast("double"))
    return F.when(text.isNull(), None).when(inner == "", F.array().cast(LINE)).otherwise(F.transform(F.split(inner, ","), pair))


def geometry_type(text: Column) -> Column:
    """The type that a WKT text names, in upper case, without its dimension; null for other texts."""
    found = F.upper(F.regexp_extract(text, r"(?i)^\s*(?:SRID=\d+;)?\s*([a-z]+)\s*(?:Z|M|ZM)?\s*(?:\(|EMPTY)", 1))
    return F.nullif(found, F.lit(""))


def to_geojson(line: Column) -> Column:
    """GeoJSON text of a LineString."""
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["x"], p["y"])).alias("coordinates")))


def from_geojson(text: Column) -> Column:
    parsed = F.from_json(text, "type string, coordinates array<array<double>>")
    return F.transform(parsed["coordinates"], lambda c: point(F.get(c, F.lit(0)), F.get(c, F.lit(1))))
