"""Line kernels that Column expressions can't express, as Arrow-batched functions over numpy arrays."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "array<struct<x:double,y:double>>"


def flat(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (n, 2) of all lines of an Arrow array and the offsets of each line; a null line has none."""
    points = lines.flatten()
    sizes = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
    xy = np.column_stack([points.field(0).to_numpy(zero_copy_only=False), points.field(1).to_numpy(zero_copy_only=False)]) if len(points) else np.empty((0, 2))
    return xy, np.r_[0, np.cumsum(sizes)].astype(np.int64)


POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def _lines(xy: np.ndarray, sizes: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """The Arrow array of lines with so many vertices each, null where missing."""
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], ["x", "y"])
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=None if missing is None else np.r_[missing, False])
    return pa.ListArray.from_arrays(offsets, points)


def kept(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices matter: those farther than the tolerance from the chord of their stretch, without recursion."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = points[a], points[b] - points[a]
        rest = points[a + 1 : b] - p
        square = d @ d
        t = np.clip(rest @ d / square, 0, 1) if square else np.zeros(len(rest))
        far = np.hypot(*(rest - t[:, None] * d).T)
        i = int(far.argmax())
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def crossings(points: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of edges of a line that cross in their insides, found among edges whose boxes meet by a sweep along x."""
    p, q = points[:-1], points[1:]
    low, high = np.minimum(p, q), np.maximum(p, q)
    order = np.argsort(low[:, 0], kind="stable")
    at = np.arange(len(order))
    count = np.searchsorted(low[order, 0], high[order, 0], side="right") - at - 1
    i = np.repeat(order, count)
    j = order[np.repeat(at + 1, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    met = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1]) & (np.abs(i - j) > 1)
    i, j = i[met], j[met]

    def side(a, b, c):
        return (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])

    crossed = (side(p[i], q[i], p[j]) * side(p[i], q[i], q[j]) < 0) & (side(p[j], q[j], p[i]) * side(p[j], q[j], q[i]) < 0)
    return np.column_stack([i[crossed], j[crossed]])


def kept_apart(points: np.ndarray, tolerance: float) -> np.ndarray:
    """kept(), with vertices brought back until no edge that stands for several crosses another one.

    Of such an edge the vertex farthest from it comes back, so in the end only edges of the line itself cross.
    """
    keep = kept(points, tolerance)
    while True:
        at = np.flatnonzero(keep)
        found = np.unique(crossings(points[at])) if len(at) > 3 else np.zeros(0, int)
        found = found[at[found + 1] - at[found] > 1]
        if not len(found):
            return keep
        for e in found:
            a, b = at[e], at[e + 1]
            rest, p, d = points[a + 1 : b], points[a], points[b] - points[a]
            square = d @ d
            t = np.clip((rest - p) @ d / square, 0, 1) if square else np.zeros(len(rest))
            keep[a + 1 + int(np.hypot(*(rest - p - t[:, None] * d).T).argmax())] = True


#: Edges up to which all pairs of a line's edges are compared at once with those of other lines.
SMALL = 24


def _farthest(xy: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches from vertex a to b, with others between: the one farthest from the chord, the first of several, and how far."""
    n = b - a - 1
    starts = np.cumsum(n) - n
    of = np.repeat(np.arange(len(a)), n)
    i = a[of] + 1 + np.arange(n.sum()) - starts[of]
    d, rest = (xy[b] - xy[a])[of], xy[i] - xy[a][of]
    square = (d * d).sum(1)
    t = np.clip((rest * d).sum(1) / np.where(square > 0, square, 1.0), 0, 1) * (square > 0)
    far = np.hypot(*(rest - t[:, None] * d).T)
    most = np.maximum.reduceat(far, starts)
    return np.minimum.reduceat(np.where(far == most[of], i, len(xy)), starts), most


def kept_all(xy: np.ndarray, at: np.ndarray, tolerance: float, apart: bool = False) -> np.ndarray:
    """kept() or kept_apart() of all lines of flat vertices at once: each step takes a stretch of every line that has one left."""
    keep, sizes = np.zeros(len(xy), bool), np.diff(at)
    keep[at[:-1][sizes > 0]] = keep[at[1:][sizes > 0] - 1] = True
    a, b = at[:-1][sizes > 2], at[1:][sizes > 2] - 1
    while len(a):
        i, far = _farthest(xy, a, b)
        split = far > tolerance
        a, b, i = a[split], b[split], i[split]
        keep[i] = True
        a, b = np.r_[a, i], np.r_[i, b]
        wide = b - a > 1
        a, b = a[wide], b[wide]
    left = np.flatnonzero(sizes > 3) if apart else np.zeros(0, np.int64)
    while len(left):
        found, done = [], np.r_[0, np.cumsum(keep)]
        counts = done[at[left + 1]] - done[at[left]]
        few = left[counts - 1 <= SMALL]
        for k in left[counts - 1 > SMALL]:
            v = at[k] + np.flatnonzero(keep[at[k] : at[k + 1]])
            found.append(v[np.unique(crossings(xy[v]))])
        if len(few):
            n = counts[counts - 1 <= SMALL]
            chosen = np.zeros(len(at) - 1, bool)
            chosen[few] = True
            v = np.flatnonzero(keep & np.repeat(chosen, sizes))
            first, edges = np.cumsum(n) - n, n - 1
            cells = edges * edges
            of = np.repeat(np.arange(len(few)), cells)
            cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
            i, j = cell // edges[of], cell % edges[of]
            apart_by = j - i > 1
            i, j = (first[of] + i)[apart_by], (first[of] + j)[apart_by]
            p, q = xy[v[i]], xy[v[i + 1]] if len(i) else xy[v[i]]
            r, s = xy[v[j]], xy[v[j + 1]] if len(j) else xy[v[j]]
            side = lambda o, u, w: (u[:, 0] - o[:, 0]) * (w[:, 1] - o[:, 1]) - (u[:, 1] - o[:, 1]) * (w[:, 0] - o[:, 0])
            crossed = (side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)
            found.append(v[np.unique(np.r_[i[crossed], j[crossed]])])
        a = np.unique(np.concatenate(found)).astype(np.int64)
        vertices = np.flatnonzero(keep)
        b = vertices[np.searchsorted(vertices, a) + 1]
        a, b = a[b - a > 1], b[b - a > 1]
        if not len(a):
            break
        keep[_farthest(xy, a, b)[0]] = True
        left = np.unique(np.searchsorted(at, a, side="right") - 1)
    return keep


def simplify(line: Column, tolerance: float, topology: bool = False) -> Column:
    """Douglas and Peucker's simplification of all lines of a batch at once. With topology, a line that doesn't cross itself doesn't
    afterwards."""

    @F.arrow_udf(LINE)
    def run(lines: pa.Array) -> pa.Array:
        xy, at = flat(lines)
        keep = kept_all(xy, at, tolerance, topology)
        done = np.r_[0, np.cumsum(keep)]
        return _lines(xy[keep], done[at[1:]] - done[at[:-1]], lines.is_null().to_numpy(zero_copy_only=False))

    return run(line)


CUT = "array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>,at:double,len:double>>"


def cut_edges(line: Column, longest: float) -> Column:
    """geo.measured_edges(geo.segmentize(line, longest)) of all lines of a batch at once. Null for null."""

    @F.arrow_udf(CUT)
    def run(lines: pa.Array) -> pa.Array:
        xy, at = flat(lines)
        edges = np.maximum(np.diff(at) - 1, 0)
        i = np.repeat(at[:-1], edges) + np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges)
        p, d = xy[i], (xy[np.minimum(i + 1, len(xy) - 1)] - xy[i]) if len(i) else xy[i]
        n = np.maximum(1, np.ceil(np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) / longest)).astype(np.int64)
        of = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = lambda j: p[of] + (j / n[of])[:, None] * d[of]
        a, b = np.where((k == 0)[:, None], p[of], place(k)), np.where((k + 1 == n[of])[:, None], xy[np.minimum(i + 1, max(len(xy) - 1, 0))][of], place(k + 1))
        step = a - b
        size = np.sqrt(step[:, 0] * step[:, 0] + step[:, 1] * step[:, 1])
        parts = np.bincount(np.repeat(np.arange(len(edges)), edges), n, len(edges)).astype(np.int64) if len(n) else np.zeros(len(edges), np.int64)
        starts, before = np.cumsum(parts) - parts, np.zeros(len(size))
        for rank in range(1, int(parts.max(initial=0))):  # sums run within lines, so that they round as one line's does
            here = starts[parts > rank] + rank
            before[here] = before[here - 1] + size[here - 1]
        point = lambda v: pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v[:, c])) for c in (0, 1)], ["x", "y"])
        rows = pa.StructArray.from_arrays([point(a), point(b), pa.array(before), pa.array(size)], ["a", "b", "at", "len"])
        missing = lines.is_null().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(parts)].astype(np.int32), mask=np.r_[missing, False]), rows)

    return run(line)


def _edges(xy: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges of flat lines: how many each line has and its first one's number; of each edge the first vertex, the vector to the second
    one, the length and the length before it. Sums run within lines, so that they round as one line's does."""
    n = np.maximum(np.diff(at) - 1, 0)
    first = np.cumsum(n) - n
    i = np.repeat(at[:-1], n) + np.arange(n.sum()) - np.repeat(first, n)
    a = xy[i]
    d = xy[i + 1] - a if len(i) else a
    size = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1])
    before = np.zeros(len(size))
    for rank in range(1, int(n.max(initial=0))):
        here = first[n > rank] + rank
        before[here] = before[here - 1] + size[here - 1]
    return n, first, a, d, size, before


def _with_each(of: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that belong to lines, each with all edges of its line: (row, edge) of each such pair and where a row's pairs begin."""
    many = n[of]
    starts = np.cumsum(many) - many
    row = np.repeat(np.arange(len(of)), many)
    return row, first[of][row] + np.arange(len(row)) - starts[row], starts


def _first_of(hit: np.ndarray, edge: np.ndarray, starts: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The first edge that is hit among the pairs of each row that has some, -1 where there is none."""
    out = np.full(len(starts), -1)
    if some.any():
        low = np.minimum.reduceat(np.where(hit, edge, np.iinfo(np.int64).max), starts[some])
        out[some] = np.where(low == np.iinfo(np.int64).max, -1, low)
    return out


def legs_between(xy: np.ndarray, at: np.ndarray, points: np.ndarray, of_points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(legs of each line, length of each leg, vertices of each leg, the vertices): the parts of lines from each of its points to the
    next, points being moved to the nearest place of the line, the first of several. Legs without two places have no vertices."""
    n, first, a, d, size, before = _edges(xy, at)
    calls = np.diff(of_points)
    of = np.repeat(np.arange(len(calls)), calls)
    row, edge, starts = _with_each(of, n, first)
    some = n[of] > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        p, e, square = points[row] - a[edge], d[edge], (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1])[edge]
        t = np.where(square == 0, 0.0, np.clip((p[:, 0] * e[:, 0] + p[:, 1] * e[:, 1]) / square, 0, 1))
        off = points[row] - (a[edge] + t[:, None] * e)
        far = np.sqrt(off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1])
        least = np.full(len(of), np.nan)
        if some.any():
            least[some] = np.minimum.reduceat(far, starts[some])
        nearest = _first_of(far == least[row], edge, starts, some)
        known = nearest >= 0
        k = np.maximum(nearest, 0)
        pick = starts + k - first[of]
        along = np.where(known, before[k] + t[np.minimum(pick, len(t) - 1)] * size[k], np.nan) if len(t) else np.full(len(of), np.nan)
        on = _first_of((before[edge] + size[edge] >= along[row]) & (size[edge] > 0), edge, starts, some)
        k = np.maximum(on, 0)
        places = a[k] + np.maximum(0.0, (along - before[k]) / size[k])[:, None] * d[k] if len(a) else np.full((len(of), 2), np.nan)
        ends = xy[np.maximum(at[1:][of] - 1, 0)] if len(xy) else places
        places = np.where((along <= 0)[:, None], xy[np.minimum(at[:-1][of], max(len(xy) - 1, 0))] if len(xy) else places, np.where((on >= 0)[:, None], places, ends))
        legs = np.maximum(calls - 1, 0)
        last = np.zeros(len(of), bool)
        last[of_points[1:][calls > 0] - 1] = True
        i = np.flatnonzero(~last)
        lo, hi = (np.fmin(along[i], along[i + 1]), np.fmax(along[i], along[i + 1])) if len(i) else (along[i], along[i])
        whole = known[i] & known[np.minimum(i + 1, max(len(known) - 1, 0))] if len(i) else np.zeros(0, bool)
        row, edge, _ = _with_each(of[i], n, first)
        inside = whole[row] & (before[edge] > lo[row]) & (before[edge] < hi[row])
    row, edge = row[inside], edge[inside]
    inner = np.bincount(row, minlength=len(i))
    sizes = np.where(whole, inner + 2, 0)
    begin = np.cumsum(sizes) - sizes
    out = np.empty((sizes.sum(), 2))
    out[begin[whole]], out[begin[whole] + sizes[whole] - 1] = places[i[whole]], places[i[whole] + 1]
    rank = np.arange(len(row)) - (np.cumsum(inner) - inner)[row]
    back = along[i] > along[i + 1] if len(i) else np.zeros(0, bool)
    out[begin[row] + np.where(back[row], inner[row] - rank, rank + 1)] = a[edge]
    step = np.diff(out, axis=0)
    step = np.sqrt(step[:, 0] * step[:, 0] + step[:, 1] * step[:, 1])
    owner = np.repeat(np.arange(len(i)), sizes)
    within = owner[1:] == owner[:-1]
    return legs, np.bincount(owner[1:][within], step[within], minlength=len(i)), sizes, out


LEGS = f"array<struct<at:int,length:double,line:{LINE},duration:bigint,began:double,points:bigint>>"


def trip_legs(line: Column, points: Column, seconds: Column, spacing: float) -> Column:
    """The legs of trips longer than nothing, of all trips of a batch at once: array<struct<at: number of the point it leaves, length, line,
    duration, began, points>>.

    line is a trip's, points where it calls and seconds when; a leg's line is geo.substring() between places of geo.locate(). began is
    the sum of the durations before, points the number of parts no longer than spacing that the legs before are cut into. Legs without
    a begin, an end or a time to begin at are none. Null for null.
    """

    @F.arrow_udf(LEGS)
    def run(lines: pa.Array, calls: pa.Array, times: pa.Array) -> pa.Array:
        (xy, at), (places, of_places) = flat(lines), flat(calls)
        legs, lengths, sizes, out = legs_between(xy, at, places, of_places)
        clock = times.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        trip = np.repeat(np.arange(len(legs)), legs)
        number = np.arange(len(trip)) - np.repeat(np.cumsum(legs) - legs, legs)
        i = of_places[:-1][trip] + number
        start, end = clock[i], clock[np.minimum(i + 1, max(len(clock) - 1, 0))] if len(i) else clock[i]
        keep = (lengths > 0) & ~np.isnan(start)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        out = out[keep[owner]]
        trip, number, start, end, lengths, sizes = (v[keep] for v in (trip, number, start, end, lengths, sizes))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        step = np.diff(out, axis=0)
        parts = np.maximum(1, np.ceil(np.sqrt(step[:, 0] * step[:, 0] + step[:, 1] * step[:, 1]) / spacing))
        within = owner[1:] == owner[:-1]
        parts = np.bincount(owner[1:][within], parts[within], minlength=len(sizes)).astype(np.int64)
        duration = end - start
        counts = np.bincount(trip, minlength=len(legs)) if len(trip) else np.zeros(len(legs), np.int64)

        def sum_before(v: np.ndarray) -> np.ndarray:
            done = np.r_[0, np.cumsum(v)]
            return done[:-1] - done[np.repeat(np.cumsum(counts) - counts, counts)]

        rows = pa.StructArray.from_arrays([
            pa.array(number.astype(np.int32)), pa.array(lengths), _lines(out, sizes), pa.array(np.nan_to_num(duration).astype(np.int64), mask=np.isnan(duration)),
            pa.array(sum_before(np.nan_to_num(duration)).astype(float)), pa.array(sum_before(parts).astype(np.int64)),
        ], ["at", "length", "line", "duration", "began", "points"])
        missing = pc.or_(lines.is_null(), calls.is_null()).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32), mask=np.r_[missing, False]), rows)

    return run(line, points, seconds)


COUNTED = "array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>,at:double,len:double,n:int,before:int>>"


def counted_edges(line: Column, longest: float) -> Column:
    """The edges of a line, each with the length before it, its own, the number of equal parts that are no longer than longest, and the
    number of such parts before it. Null for null."""

    @F.arrow_udf(COUNTED)
    def run(lines: pa.Array) -> pa.Array:
        xy, at = flat(lines)
        edges, first, a, d, size, before = _edges(xy, at)
        n = np.maximum(1, np.ceil(size / longest)).astype(np.int32)
        until = np.cumsum(n) - n
        until -= np.repeat(until[first[edges > 0]], edges[edges > 0])
        i = np.repeat(at[:-1], edges) + np.arange(len(size)) - np.repeat(first, edges)
        point = lambda v: pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v[:, c])) for c in (0, 1)], ["x", "y"])
        rows = pa.StructArray.from_arrays([point(a), point(xy[i + 1] if len(i) else a), pa.array(before), pa.array(size), pa.array(n), pa.array(until.astype(np.int32))], ["a", "b", "at", "len", "n", "before"])
        missing = lines.is_null().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(edges)].astype(np.int32), mask=np.r_[missing, False]), rows)

    return run(line)


def capsule_intervals(p: np.ndarray, d: np.ndarray, a: np.ndarray, axis: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """For edges from p along d and other ones from a along axis, the parameters between which the first is within r of the second;
    nan where it isn't. A capsule, what is within r of an edge, is convex, so its parts in two disks and a box span one interval."""
    with np.errstate(divide="ignore", invalid="ignore"):
        square = (d * d).sum(-1)
        low, high = [], []
        for c in (a, a + axis):
            f = p - c
            half, rest = (f * d).sum(-1), (f * f).sum(-1) - r * r
            root = np.sqrt(half * half - square * rest)
            low.append(np.where(square > 0, (-half - root) / square, np.where(rest <= 0, 0.0, np.nan)))
            high.append(np.where(square > 0, (-half + root) / square, np.where(rest <= 0, 1.0, np.nan)))
        size = np.hypot(axis[..., 0], axis[..., 1])
        u = axis / size[..., None]
        n = np.stack([-u[..., 1], u[..., 0]], -1)
        begin, end = np.full(square.shape, -np.inf), np.full(square.shape, np.inf)
        for direction, lo, hi in ((u, 0.0, size), (n, -r, r)):
            start, speed = (direction * (p - a)).sum(-1), (direction * d).sum(-1)
            t1, t2 = (lo - start) / speed, (hi - start) / speed
            still, inside = speed == 0, (start >= lo) & (start <= hi)
            begin = np.maximum(begin, np.where(still, np.where(inside, -np.inf, np.inf), np.minimum(t1, t2)))
            end = np.minimum(end, np.where(still, np.where(inside, np.inf, -np.inf), np.maximum(t1, t2)))
        boxed = (size > 0) & (begin <= end)
        low.append(np.where(boxed, begin, np.nan))
        high.append(np.where(boxed, end, np.nan))
        t0, t1 = np.fmax(0.0, np.fmin.reduce(low)), np.fmin(1.0, np.fmax.reduce(high))
        met = ~np.isnan(np.fmin.reduce(low)) & (t0 <= t1)
    return np.where(met, t0, np.nan), np.where(met, t1, np.nan)


#: Pairs of edges that are compared at once.
EDGES = 500_000


def clips(xy: np.ndarray, at: np.ndarray, xy2: np.ndarray, at2: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertices, vertices of each part, parts of each pair): the parts of lines within r of other lines, longer than nothing, in
    order. Lines are flat vertices and offsets; all pairs are worked on at once, as many as fit."""
    n, m = np.maximum(np.diff(at) - 1, 0), np.maximum(np.diff(at2) - 1, 0)
    cost = np.cumsum(n * m)
    found, k = [], 0
    while k < len(n):
        stop = max(k + 1, int(np.searchsorted(cost, (cost[k - 1] if k else 0) + EDGES, side="right")))
        found.append(_clips(xy, at[k : stop + 1], n[k:stop], xy2, at2[k : stop + 1], m[k:stop], r))
        k = stop
    if not found:
        return np.empty((0, 2)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _clips(xy, at, n, xy2, at2, m, r):
    cells = n * m
    pair = np.repeat(np.arange(len(n)), cells)
    cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    i, j = at[:-1][pair] + cell // np.maximum(m[pair], 1), at2[:-1][pair] + cell % np.maximum(m[pair], 1)
    t0, t1 = capsule_intervals(xy[i], xy[np.minimum(i + 1, len(xy) - 1)] - xy[i], xy2[j], xy2[np.minimum(j + 1, len(xy2) - 1)] - xy2[j], r) if len(i) else (np.zeros(0), np.zeros(0))
    met = np.flatnonzero(~np.isnan(t0))
    met = met[np.lexsort((t1[met], t0[met], i[met], pair[met]))]
    pair, i, t0, t1 = pair[met], i[met], t0[met], t1[met]
    # spans of an edge that touch become one
    first = np.r_[True, (pair[1:] != pair[:-1]) | (i[1:] != i[:-1])][: len(pair)]
    begins = first.copy()
    for q in np.flatnonzero(~first):
        begins[q] = t0[q] > t1[q - 1] + 1e-12
        if not begins[q]:
            t1[q] = max(t1[q], t1[q - 1])
    starts = np.flatnonzero(begins)
    ends = np.r_[starts[1:], len(pair)][: len(starts)] - 1
    pair, i, t0, t1 = pair[starts], i[starts], t0[starts], t1[ends]
    p, d = xy[i], xy[np.minimum(i + 1, len(xy) - 1)] - xy[i]
    a, b = p + t0[:, None] * d, p + t1[:, None] * d
    # spans that go on from the one before belong to its part
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | ~(np.abs(b[:-1] - a[1:]) <= 1e-9).all(1)
    part = np.cumsum(new) - 1
    step = b - a
    step[~new] = b[~new] - b[np.flatnonzero(~new) - 1]
    kept = np.bincount(part, np.hypot(step[:, 0], step[:, 1])) > 0 if len(part) else np.zeros(0, bool)
    sizes, owner = np.bincount(part) + 1 if len(part) else np.zeros(0, np.int64), pair[new]
    out = np.empty((len(pair) + int(new.sum()), 2))
    place = np.arange(len(pair)) + part + 1
    out[place], out[place[new] - 1] = b, a[new]
    return out[np.repeat(kept, sizes)], sizes[kept], np.bincount(owner[kept], minlength=len(n))


def clip_near(line: np.ndarray, other: np.ndarray, r: float) -> list[np.ndarray]:
    """The parts of a line within r of another line, longer than nothing, in order."""
    xy, sizes, _ = clips(line, np.array([0, len(line)]), other, np.array([0, len(other)]), r)
    return np.split(xy, np.cumsum(sizes)[:-1]) if len(sizes) else []


def length(line: np.ndarray) -> float:
    return float(np.hypot(*np.diff(line, axis=0).T).sum()) if len(line) > 1 else 0.0


def longest(parts: list[np.ndarray]) -> np.ndarray | None:
    return max(parts, key=length, default=None)


def merged(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Lines that share an end which no third line has become one, in either direction: chains are followed from end to end."""
    lines, key = [p for p in parts if len(p)], (lambda v: (round(float(v[0]), 9), round(float(v[1]), 9)))
    ends: dict[tuple, list[tuple[int, bool]]] = {}
    for i, line in enumerate(lines):
        ends.setdefault(key(line[0]), []).append((i, True))
        ends.setdefault(key(line[-1]), []).append((i, False))

    def onward(i: int, first: bool) -> tuple[int, bool] | None:
        """The line that goes on from an end of line i, and whether it does so from its first vertex."""
        met = ends[key(lines[i][0] if first else lines[i][-1])]
        if len(met) != 2 or met[0][0] == met[1][0]:
            return None
        return met[1] if met[0] == (i, first) else met[0]

    out, used = [], [False] * len(lines)
    for i in range(len(lines)):
        if used[i]:
            continue
        at, forward, seen = i, True, {i}
        while (step := onward(at, forward)) and step[0] not in seen:  # back to where the chain begins
            at, forward = step[0], not step[1]
            seen.add(at)
        chain, forward = [], not forward
        while True:
            used[at] = True
            chain.append(lines[at] if not forward else lines[at][::-1])
            step = onward(at, forward)
            if step is None or used[step[0]]:
                break
            at, forward = step[0], not step[1]
        out.append(np.concatenate([chain[0], *(c[1:] for c in chain[1:])]))
    return out


#: Cells of padded distance tables that are worked on at once.
CELLS = 2_000_000


def frechet_distances(p: np.ndarray, at_p: np.ndarray, q: np.ndarray, at_q: np.ndarray) -> np.ndarray:
    """Discrete Frechet distances of pairs of lines, as flat vertices and offsets; infinite where either has none.

    Pairs of like sizes go together, and their tables are filled by diagonals: every cell of a diagonal depends on the two before it
    alone, so a step is a few operations on whole arrays.
    """
    n, m = np.diff(at_p), np.diff(at_q)
    out = np.full(len(n), np.inf)
    short = np.flatnonzero((n == 2) & (m == 2))  # both ends decide
    if len(short):
        i, j = at_p[short], at_q[short]
        first, last = p[i] - q[j], p[i + 1] - q[j + 1]
        out[short] = np.maximum(np.hypot(first[:, 0], first[:, 1]), np.hypot(last[:, 0], last[:, 1]))
    order = np.flatnonzero((n > 0) & (m > 0) & ((n != 2) | (m != 2)))
    order = order[np.lexsort((m[order], n[order]))]
    i = 0
    while i < len(order):
        wide, high, j = 0, 0, i
        while j < len(order):
            high, wide_j = int(n[order[j]]), max(wide, int(m[order[j]]))
            if j > i and (j - i + 1) * high * wide_j > CELLS:
                break
            wide, j = wide_j, j + 1
        chosen = order[i:j]
        high = int(n[chosen].max())
        rows, columns = np.minimum(np.arange(high)[None], n[chosen, None] - 1), np.minimum(np.arange(wide)[None], m[chosen, None] - 1)
        a, b = p[at_p[chosen, None] + rows], q[at_q[chosen, None] + columns]
        before = last = np.full((len(chosen), high + 1), np.inf)  # place 0 stands for what is before the first row
        for k in range(high + wide - 1):
            lo, hi = max(0, k - wide + 1), min(high - 1, k)
            x, y = a[:, lo : hi + 1], b[:, k - hi : k - lo + 1][:, ::-1]
            d = np.hypot(x[..., 0] - y[..., 0], x[..., 1] - y[..., 1])
            row = np.full_like(last, np.inf)
            if k:
                d = np.maximum(d, np.minimum(np.minimum(last[:, lo + 1 : hi + 2], last[:, lo : hi + 1]), before[:, lo : hi + 1]))
            row[:, lo + 1 : hi + 2] = d
            ended = np.flatnonzero(n[chosen] + m[chosen] - 2 == k)
            out[chosen[ended]] = row[ended, n[chosen[ended]]]
            before, last = last, row
        i = j
    return out


def discrete_frechet(p: np.ndarray, q: np.ndarray) -> float:
    return float(frechet_distances(p, np.array([0, len(p)]), q, np.array([0, len(q)]))[0])


def _reversed(xy: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Vertices of lines with each line's order turned around."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return xy[at[owner] + at[owner + 1] - 1 - np.arange(len(xy))]


def frechet(p: Column, q: Column, either: bool = False) -> Column:
    """Discrete Frechet distance of two lines; with either, the smaller one of p as it is and reversed. Null for null."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (one, i), (two, j) = flat(a), flat(b)
        found = frechet_distances(one, i, two, j)
        if either:
            found = np.minimum(found, frechet_distances(_reversed(one, i), i, two, j))
        return pa.array(found, mask=pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False))

    return run(p, q)


def frechet_sums(ids: Column, lines: Column, other_ids: Column, other_lines: Column) -> Column:
    """array<struct<id,d>>: the distances of all lines of one bundle to all of another, summed up by line, for the lines of both; of
    a bundle with itself each pair counts once for either line. Bundles are arrays of ids and of lines."""

    @F.arrow_udf("array<struct<id:bigint,d:double>>")
    def run(ids_a: pa.Array, lines_a: pa.Array, ids_b: pa.Array, lines_b: pa.Array) -> pa.Array:
        out = []
        for i in range(len(ids_a)):
            a, b = ids_a[i].as_py(), ids_b[i].as_py()
            (one, at_a), (two, at_b) = flat(lines_a[i].values), flat(lines_b[i].values)
            x, y = (v.ravel() for v in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
            if a == b:
                x, y = x[x < y], y[x < y]

            def pick(xy, at, which):
                size = np.diff(at)[which]
                return xy[np.repeat(at[which], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)], np.r_[0, np.cumsum(size)]

            d = frechet_distances(*pick(one, at_a, x), *pick(two, at_b, y))
            sums = [*zip(a, np.bincount(x, d, len(a)).tolist(), strict=True), *zip(b, np.bincount(y, d, len(b)).tolist(), strict=True)]
            out.append([{"id": k, "d": v} for k, v in sums])
        return pa.array(out, pa.list_(pa.struct([("id", pa.int64()), ("d", pa.float64())])))

    return run(ids, lines, other_ids, other_lines)


def clip_parts(line: Column, other: Column, reach: float) -> Column:
    """array<line>: the parts of a line within reach of another, in order; a multipart line, of which posexplode gives numbers and
    parts and single_line() makes one again. Empty where the lines are apart, null for null."""

    @F.arrow_udf(f"array<{LINE}>")
    def run(lines: pa.Array, others: pa.Array) -> pa.Array:
        (one, i), (two, j) = flat(lines), flat(others)
        xy, sizes, parts = clips(one, i, two, j, reach)
        flat_lines = _lines(xy, sizes)
        missing = pc.or_(lines.is_null(), others.is_null()).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.r_[0, np.cumsum(parts)].astype(np.int32), mask=np.r_[missing, False])
        return pa.ListArray.from_arrays(offsets, flat_lines)

    return run(line, other)


MATCH = "struct<frechet:double,road_length:double,trip_length:double>"


def match_lines(road: Column, trip: Column, reach: float) -> Column:
    """struct<frechet, road_length, trip_length> of the parts of two lines near each other: the orientation-agnostic discrete
    Frechet distance of the longest parts, infinite where there is none, and the total lengths of the parts."""

    @F.arrow_udf(MATCH)
    def run(roads: pa.Array, trips: pa.Array) -> pa.Array:
        (road, r), (trip, t) = flat(roads), flat(trips)
        out, sides = np.full((len(roads), 3), np.inf), []
        for side, (line, i, other, j) in enumerate(((road, r, trip, t), (trip, t, road, r))):
            xy, sizes, parts = clips(line, i, other, j, reach)
            at = np.r_[0, np.cumsum(sizes)]
            steps = np.hypot(*np.diff(xy, axis=0).T) if len(xy) > 1 else np.zeros(0)
            inner = np.ones(len(steps), bool)
            inner[at[1:-1] - 1] = False
            part = np.repeat(np.arange(len(sizes)), sizes)[:-1]
            lengths = np.bincount(part[inner], steps[inner], minlength=len(sizes)) if len(sizes) else np.zeros(0)
            out[:, side + 1] = np.bincount(np.repeat(np.arange(len(parts)), parts), lengths, minlength=len(roads)) if len(sizes) else 0.0
            # one part is the longest; of several, those that meet are merged first
            before = np.r_[0, np.cumsum(parts)]
            if not (parts > 1).any():
                n = np.zeros(len(parts), np.int64)
                n[parts == 1] = sizes
                sides.append((xy, np.r_[0, np.cumsum(n)]))
                continue
            chosen = [np.empty((0, 2))] * len(roads)
            for k in np.flatnonzero(parts):
                several = [xy[at[q] : at[q + 1]] for q in range(before[k], before[k + 1])]
                chosen[k] = several[0] if len(several) == 1 else longest(merged(several))
            sides.append((np.concatenate(chosen), np.r_[0, np.cumsum([len(x) for x in chosen])]))
        if len(roads):
            (one, a), (two, b) = sides
            out[:, 0] = np.minimum(frechet_distances(one, a, two, b), frechet_distances(_reversed(one, a), a, two, b))
        return pa.StructArray.from_arrays([pa.array(out[:, k].copy()) for k in range(3)], ["frechet", "road_length", "trip_length"])

    return run(road, trip)


def from_wkb(binary: Column) -> Column:
    """A line from the WKB of a LineString, or of one point from that of a Point, of either byte order; an SRID is skipped. Null
    for null and for other geometries."""

    @F.arrow_udf(LINE)
    def run(values: pa.Array) -> pa.Array:
        xy, sizes, missing = [], np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        for i, data in enumerate(values.to_pylist()):
            order = "<" if data and data[0] else ">"
            kind = int(np.frombuffer(data, f"{order}u4", 1, 1)[0]) if data and len(data) >= 5 else 0
            at = 9 if kind & 0x20000000 else 5
            if kind & 0xFF not in (1, 2) or kind & 0xC0000000:
                missing[i] = True
                continue
            n = 1 if kind & 0xFF == 1 else int(np.frombuffer(data, f"{order}u4", 1, at)[0])
            xy.append(np.frombuffer(data, f"{order}f8", 2 * n, at if kind & 0xFF == 1 else at + 4).astype(float))
            sizes[i] = n
        return _lines(np.concatenate(xy).reshape(-1, 2) if xy else np.empty((0, 2)), sizes, missing)

    return run(binary)


def to_wkb(line: Column) -> Column:
    """The little-endian WKB of a LineString."""

    @F.arrow_udf("binary")
    def run(lines: pa.Array) -> pa.Array:
        xy, at = flat(lines)
        null = lines.is_null().to_pylist()
        return pa.array([None if null[i] else struct.pack("<BII", 1, 2, at[i + 1] - at[i]) + xy[at[i] : at[i + 1]].astype("<f8").tobytes() for i in range(len(lines))], pa.binary())

    return run(line)


def single_line(parts: Column) -> Column:
    """One line of array<line>: parts that meet end to end are merged; of what is left, the longest. Null without parts."""

    @F.arrow_udf(LINE)
    def run(values: pa.Array) -> pa.Array:
        inner = values.flatten()
        flat_xy, at = flat(inner)
        of = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False))].astype(np.int64)
        found = [longest(merged([flat_xy[at[q] : at[q + 1]] for q in range(of[k], of[k + 1]) if at[q + 1] > at[q]])) for k in range(len(values))]
        sizes = np.array([0 if x is None else len(x) for x in found], np.int64)
        xy = [x for x in found if x is not None]
        return _lines(np.concatenate(xy) if xy else np.empty((0, 2)), sizes, np.array([x is None for x in found], bool))

    return run(parts)
