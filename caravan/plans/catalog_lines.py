"""Queries for lines of several vertices and of several parts, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravan.functions import geo, kernels
from caravan.operators import spatial as S
from caravan.plans import catalog as C
from caravan.plans import mapping as M

query = C.query


@query(
    M.sql(
        "stops calls",
        ", v AS (SELECT trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY trip_id) AS n, x, y FROM calls JOIN stops ON stop_id = id), "
        "d AS (SELECT a.trip_id, a.i, b.i AS j, a.n, b.n AS m, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM v a JOIN v b ON b.trip_id = a.trip_id + 1), "
        "r(trip_id, i, j, w) AS (SELECT trip_id, i, j, d FROM d WHERE i = 1 AND j = 1 UNION SELECT d.trip_id, d.i, d.j, greatest(w, d.d) FROM r JOIN d ON d.trip_id = r.trip_id AND d.i BETWEEN r.i AND r.i + 1 AND d.j BETWEEN r.j AND r.j + 1 AND d.i + d.j > r.i + r.j) "
        "SELECT trip_id, round(min(w), 4) AS frechet FROM r JOIN d USING (trip_id, i, j) WHERE i = n AND j = m GROUP BY trip_id",
        recursive=True,
    )
)
def frechet_lines(spark, d):
    """The discrete Frechet distance of each trip's line to the next one's."""
    lines = M.lines(spark, d)
    other = lines.select((F.col("trip_id") - 1).alias("trip_id"), F.col("line").alias("other"))
    return lines.join(other, "trip_id").select("trip_id", F.round(kernels.frechet(F.col("line"), F.col("other")), 4).alias("frechet"))


def _bent(spark, d):
    """Streets of four vertices that turn back towards where they begin."""
    k, at = F.col("gid"), lambda i, c: F.get("line", F.lit(i))[c]
    third = geo.point(at(1, "x") + k * 29 % 401 - 200, at(1, "y") + k * 43 % 301 - 150)
    return M.streets(spark, d).select("gid", F.concat("line", F.array(third, geo.point(at(0, "x") + 20, at(0, "y") + 30))).alias("line"))


#: The same streets' edges: gid, seq, ax, ay to bx, by2, with the length before them.
BENT = (
    "bv AS (SELECT gid, 1 AS seq, ax AS x, ay AS y FROM streets UNION ALL SELECT gid, 2, bx, by2 FROM streets UNION ALL SELECT gid, 3, bx + (gid*29%401-200), by2 + (gid*43%301-150) FROM streets UNION ALL SELECT gid, 4, ax + 20, ay + 30 FROM streets), "
    "bw AS (SELECT gid, seq, x AS px, y AS py, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM bv WINDOW w AS (PARTITION BY gid ORDER BY seq)), "
    "bl AS (SELECT *, sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)) AS len FROM bw WHERE qx IS NOT NULL), be AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY gid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM bl)"
)
_CUTS = C.CLIPPED[C.CLIPPED.index("dd AS") : C.CLIPPED.index("cut AS")].rstrip(", ")


@query(
    M.sql(
        "probes streets",
        f", {BENT}, side AS (SELECT a.gid, b.gid AS other, a.seq, a.pos, a.len AS elen, a.px, a.py, a.qx, a.qy, b.px AS ax, b.py AS ay, b.qx AS bx, b.qy AS by2 FROM be a JOIN be b ON a.gid < b.gid AND least(a.px, a.qx) - 10 <= greatest(b.px, b.qx) AND greatest(a.px, a.qx) + 10 >= least(b.px, b.qx) AND least(a.py, a.qy) - 10 <= greatest(b.py, b.qy) AND greatest(a.py, a.qy) + 10 >= least(b.py, b.qy)), "
        f"{_CUTS}, iv AS (SELECT gid, other, pos + t0 * elen AS s, pos + t1 * elen AS e, px + t0 * dx AS x, py + t0 * dy AS y FROM cc WHERE t0 <= t1), "
        "io AS (SELECT *, max(e) OVER (PARTITION BY gid, other ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM iv), "
        "ig AS (SELECT *, sum(CASE WHEN reached IS NULL OR s > reached + 1e-7 THEN 1 ELSE 0 END) OVER (PARTITION BY gid, other ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM io), "
        "ip AS (SELECT gid, other, island, min(s) AS s, max(e) AS e, arg_min(x, s) AS x, arg_min(y, s) AS y FROM ig GROUP BY ALL HAVING max(e) - min(s) > 1e-6) "
        "SELECT gid, other, row_number() OVER (PARTITION BY gid, other ORDER BY s) - 1 AS part, round(e - s + 0.0000137, 3) AS length, round(x + 0.0000137, 3) AS x, round(y + 0.0000137, 3) AS y FROM ip",
    )
)
def clip_parts(spark, d):
    """The numbered parts of bent streets within 10 m of other ones."""
    bent = _bent(spark, d)
    other = bent.select(F.col("gid").alias("other"), "line", F.col("line").alias("line2"))
    both = S.line_pairs(bent.withColumn("line1", F.col("line")), other, 10.0, ["gid"], ["other"], 100.0, ("line1",), ("line2",)).where("gid < other")
    parts = both.select("gid", "other", F.posexplode(kernels.clip_parts(F.col("line1"), F.col("line2"), 10.0)).alias("part", "l"))
    long = parts.withColumn("length", geo.length(F.col("l"))).where("length > 1e-6")
    at = lambda c: geo.rounded(F.get("l", F.lit(0))[c] + 0.0000137, 3)
    return long.select("gid", "other", F.col("part").cast("long").alias("part"), geo.rounded(F.col("length") + 0.0000137, 3).alias("length"), at("x").alias("x"), at("y").alias("y"))


@query("SELECT c_custkey AS gid, 5 AS plain, CASE WHEN c_custkey % 2 = 0 THEN 6 ELSE 5 END AS apart, CASE WHEN c_custkey % 2 = 0 THEN -5.0 - c_custkey % 5 ELSE 0.0 END AS lowest FROM customer")
def simplify_topology(spark, d):
    """Lines with a bay into which their own end reaches, or doesn't: the bay goes plainly, and stays where its loss would make the line
    cross itself."""
    k = F.col("c_custkey")
    depth = -(F.lit(5.0) + k % 5)
    end = F.when(k % 2 == 0, depth + 1).otherwise(F.lit(4.0))
    p = lambda x, y: geo.point(F.lit(float(x)), y if isinstance(y, type(k)) else F.lit(float(y)))
    line = F.array(p(0, 0), p(40, 0), p(50, depth), p(60, 0), p(100, 0), p(100, 50), p(50, 50), p(50, end))
    rows = M.table(spark, d, "customer").select(k.alias("gid"), line.alias("line"))
    apart = rows.withColumn("apart", kernels.simplify(F.col("line"), 10.0, topology=True))
    low = F.array_min(F.transform(F.slice("apart", F.lit(1), F.size("apart") - 1), lambda v: v["y"]))
    return apart.select("gid", F.size(kernels.simplify(F.col("line"), 10.0)).alias("plain"), F.size("apart").alias("apart"), low.alias("lowest"))
