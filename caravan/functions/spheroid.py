"""Geodesics on the WGS 84 spheroid, as Arrow-batched functions over numpy arrays.

Vincenty's iteration finds the longitude on the auxiliary sphere for all pairs at once until each has settled; pairs that don't settle
are nearly opposite points, whose azimuth is found by bisection with the integrals taken by Gauss and Legendre's rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from caravan.functions.kernels import flat

#: The spheroid's larger radius in metres and its flattening.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257223563
_B = RADIUS * (1 - FLATTENING)
#: Rounds after which a pair counts as not settled, and the step in radians at which it is settled (one more round follows).
ROUNDS, SETTLED = 24, 1e-12
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(32)


def _reduced(lat: np.ndarray) -> np.ndarray:
    return np.arctan2((1 - FLATTENING) * np.sin(lat), np.cos(lat))


def distances(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres between points in degrees; longitudes of any turn, so lines across the antimeridian are as any other; nan for nan."""
    lon1, lat1, lon2, lat2 = (np.asarray(v, float) for v in (lon1, lat1, lon2, lat2))
    turn = lon2 - lon1
    turn = np.radians(turn - 360 * np.round(turn / 360))  # of short lines to the last bit
    u1, u2 = _reduced(np.radians(lat1)), _reduced(np.radians(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, settled, last = turn.copy(), np.zeros(turn.shape, bool), False
    out = np.full(turn.shape, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(ROUNDS + 1):
            sin_sigma = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
            cos_sigma = s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(sin_sigma, cos_sigma)
            sin_alpha = np.where(sin_sigma > 0, c1 * c2 * np.sin(lam) / sin_sigma, 0.0)
            cos2 = np.maximum(1 - sin_alpha**2, 0.0)
            middle = np.where(cos2 > 1e-15, cos_sigma - 2 * s1 * s2 / cos2, 0.0)
            c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
            new = turn + (1 - c) * FLATTENING * sin_alpha * (sigma + c * sin_sigma * (middle + c * cos_sigma * (2 * middle**2 - 1)))
            if last:  # a round more for all, so that sigma is that of the settled longitude
                break
            settled = np.abs(new - lam) <= SETTLED
            lam = new
            last = settled.all() or n == ROUNDS - 1
        # an equator's arc is the way only as long as no shorter one leaves it
        settled &= (np.abs(lam) <= np.pi) & ~((cos2 <= 1e-15) & (np.abs(turn) > np.pi * (1 - FLATTENING)))
        k = np.sqrt(1 + cos2 * (RADIUS**2 - _B**2) / _B**2)
        k = (k - 1) / (k + 1)
        a, b = (1 + k**2 / 4) / (1 - k), k * (1 - 3 * k**2 / 8)
        bend = b * sin_sigma * (middle + b / 4 * (cos_sigma * (2 * middle**2 - 1) - b / 6 * middle * (4 * sin_sigma**2 - 3) * (4 * middle**2 - 3)))
        out[settled] = (_B * a * (sigma - bend))[settled]
    rest = np.flatnonzero(~settled & ~np.isnan(turn + u1 + u2))
    if len(rest):
        out.flat[rest] = _opposite(u1.ravel()[rest], u2.ravel()[rest], np.abs(turn).ravel()[rest])
    return out


def _opposite(u1: np.ndarray, u2: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Distances of pairs in reduced latitudes and turns of 0 to pi, by the azimuth at which the geodesic's turn is the pair's."""
    swap = np.abs(u1) < np.abs(u2)
    b1, b2 = np.where(swap, u2, u1), np.where(swap, u1, u2)
    sign = np.where(b1 > 0, -1.0, 1.0)
    b1, b2 = np.minimum(b1 * sign, -1e-14), b2 * sign
    low, high = np.zeros(len(b1)), np.full(len(b1), np.pi)
    for _ in range(64):
        alpha = (low + high) / 2
        found, metres = _along(b1, b2, alpha)
        low, high = np.where(found < turn, alpha, low), np.where(found < turn, high, alpha)
    return metres


def _along(b1: np.ndarray, b2: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(turn, metres) of the geodesic that leaves b1 at an azimuth, to where it meets b2 going north."""
    sin0 = np.sin(alpha) * np.cos(b1)
    cos_end = np.sqrt(np.maximum((np.cos(alpha) * np.cos(b1)) ** 2 + np.cos(b2) ** 2 - np.cos(b1) ** 2, 0.0))
    sigma1, sigma2 = np.arctan2(np.sin(b1), np.cos(alpha) * np.cos(b1)), np.arctan2(np.sin(b2), cos_end)
    omega = np.arctan2(sin0 * np.sin(sigma2), np.cos(sigma2)) - np.arctan2(sin0 * np.sin(sigma1), np.cos(sigma1))
    half = (sigma2 - sigma1)[:, None] / 2
    at = (sigma1 + sigma2)[:, None] / 2 + half * _NODES
    k2 = ((RADIUS**2 - _B**2) / _B**2 * (1 - sin0**2))[:, None]
    root = np.sqrt(1 + k2 * np.sin(at) ** 2)
    metres = _B * (half * root * _WEIGHTS).sum(axis=1)
    inner = (half * (2 - FLATTENING) / (1 + (1 - FLATTENING) * root) * _WEIGHTS).sum(axis=1)
    return omega - FLATTENING * sin0 * inner, metres


#: Metres that short_geodesic() may be off.
OFF = 1e-9


def is_short(reach: float, latitude: float) -> bool:
    """Whether short_geodesic() is right to OFF for distances up to reach, in metres, at latitudes up to one in degrees."""
    return reach**3 / _B**2 / 24 * (1 + np.tan(np.radians(abs(latitude))) ** 2) <= OFF


def short_geodesic(sin: Column, cos: Column, east: Column, north: Column) -> Column:
    """Metres from a point, whose latitude has this sine and cosine, by short steps on the plane of EPSG:3857 in units of its radius.

    Without a Python worker: the step north in latitude is a series of the plane's, and the spheroid's radii of curvature are those of the
    middle latitude; what is left out is of the third order, see is_short().
    """
    e2 = FLATTENING * (2 - FLATTENING)
    turn = cos * north * (F.lit(1.0) - north * (sin / 2 + (cos * cos - sin * sin) * north / 6))
    sin_m, cos_m = sin + cos * turn / 2, cos * (F.lit(1.0) - turn * turn / 8) - sin * turn / 2
    w = F.lit(1.0) - sin_m * sin_m * e2
    y, x = turn * (1 - e2) / w, east * cos_m
    return F.sqrt((x * x + y * y) / w) * RADIUS


def geodesic(p: Column, q: Column) -> Column:
    """Metres between points of degrees; null for null."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        found = distances(*(x.flatten()[i].to_numpy(zero_copy_only=False) for x in (a, b) for i in (0, 1)))
        return pa.array(found, from_pandas=True)

    return run(p, q)


def geodesic_length(line: Column) -> Column:
    """Metres along a line of points of degrees; 0 for one point or none, null for null."""

    @F.arrow_udf("double")
    def run(lines: pa.Array) -> pa.Array:
        xy, at = flat(lines)
        total = np.zeros(len(lines))
        if len(xy) > 1:
            steps = distances(xy[:-1, 0], xy[:-1, 1], xy[1:, 0], xy[1:, 1])
            within = np.ones(len(steps), bool)
            within[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(xy))] - 1] = False
            owner = np.repeat(np.arange(len(lines)), np.diff(at))[:-1]
            total = np.bincount(owner[within], steps[within], minlength=len(lines))
        return pa.array(total, mask=lines.is_null().to_numpy(zero_copy_only=False))

    return run(line)
