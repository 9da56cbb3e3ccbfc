"""Geometry of vertex arrays and boxes: column expressions without a Python worker, but for two tests of whole rings in numpy."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

#: Edges of a ring that are held against all others at a time.
EDGES = 256


def turned(v: Column, by: int = 1) -> Column:
    """The vertices rotated, so that zipping with it walks the closed ring's edges."""
    return F.concat(F.slice(v, by + 1, F.greatest(F.size(v) - by, F.lit(0))), F.slice(v, 1, by))


def signed_area(v: Column) -> Column:
    """Shoelace area of the closed ring: positive if counter-clockwise."""
    cross = F.zip_with(v, turned(v), lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.aggregate(cross, F.lit(0.0), lambda s, x: s + x) / 2


def ring_length(v: Column, closed: Column) -> Column:
    """Length of the polyline, with the closing edge if closed."""
    steps = F.zip_with(v, turned(v), lambda a, b: F.sqrt((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1])))
    kept = F.when(closed, steps).otherwise(F.slice(steps, 1, F.greatest(F.size(v) - 1, F.lit(0))))
    return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)


def box(v: Column) -> Column:
    xs, ys = F.transform(v, lambda p: p[0]), F.transform(v, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def area_centroid(v: Column) -> Column:
    """Centroid of the ring's area; null where the area is 0."""
    part = lambda i: F.aggregate(F.zip_with(v, turned(v), lambda a, b: (a[i] + b[i]) * (a[0] * b[1] - b[0] * a[1])), F.lit(0.0), lambda s, x: s + x)
    a = signed_area(v)
    return F.when(a != 0, F.struct((part(0) / (6 * a)).alias("x"), (part(1) / (6 * a)).alias("y")))


def contains_point(v: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over the ring's edges."""
    crossed = F.zip_with(v, turned(v), lambda a, b: ((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]))
    return F.aggregate(crossed, F.lit(False), lambda s, c: s != F.coalesce(c, F.lit(False)))


@F.pandas_udf(BooleanType())
def is_simple(rings: pd.Series) -> pd.Series:
    """Whether the closed ring neither crosses nor touches itself; null where there are fewer than three places.

    Every edge is held against every other in numpy, a block of edges at a time. Neighbours may share their corner only.
    """

    def side(px, py, qx, qy, rx, ry):
        return np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))

    def within(px, py, qx, qy, rx, ry):
        return (np.minimum(px, qx) <= rx) & (rx <= np.maximum(px, qx)) & (np.minimum(py, qy) <= ry) & (ry <= np.maximum(py, qy))

    def one(ring) -> bool | None:
        if ring is None:
            return None
        p = np.array([[v[0], v[1]] for v in ring if v is not None], dtype=float).reshape(-1, 2)
        p = p[np.any(p != np.roll(p, 1, axis=0), axis=1)] if len(p) > 1 else p
        n = len(p)
        if n < 3:
            return None
        q = np.roll(p, -1, axis=0)
        i = np.arange(n)
        for start in range(0, n, EDGES):
            k = i[start : start + EDGES, None]
            ax, ay, bx, by = p[k, 0], p[k, 1], q[k, 0], q[k, 1]
            cx, cy, dx, dy = p[None, :, 0], p[None, :, 1], q[None, :, 0], q[None, :, 1]
            s1, s2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
            s3, s4 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
            meets = (s1 * s2 < 0) & (s3 * s4 < 0)
            meets |= ((s1 == 0) & within(ax, ay, bx, by, cx, cy)) | ((s2 == 0) & within(ax, ay, bx, by, dx, dy))
            meets |= ((s3 == 0) & within(cx, cy, dx, dy, ax, ay)) | ((s4 == 0) & within(cx, cy, dx, dy, bx, by))
            gap = (i[None, :] - k) % n
            if np.any(meets & (gap > 1) & (gap < n - 1)):
                return False
            # a neighbour that goes back along the edge
            back = (gap == 1) & (s2 == 0) & ((bx - ax) * (dx - cx) + (by - ay) * (dy - cy) < 0)
            if np.any(back):
                return False
        return True

    return pd.Series([one(r) for r in rings], dtype=object)


def widest_circle(vertices: Column, enough: float) -> Column:
    """Diameter of the largest circle within a simple ring, to a thousandth of its extent, or one that is ``enough``: cells are halved where they may hold a place farther from the outline."""

    def one(ring) -> float | None:
        if ring is None:
            return None
        p = np.array([[v[0], v[1]] for v in ring], dtype=float)
        q = np.roll(p, -1, axis=0)
        d = q - p
        length = np.maximum((d * d).sum(1), 1e-300)

        def depth(x: float, y: float) -> float:
            """Distance to the outline, negative outside."""
            t = np.clip(((x - p[:, 0]) * d[:, 0] + (y - p[:, 1]) * d[:, 1]) / length, 0, 1)
            far = np.hypot(x - p[:, 0] - t * d[:, 0], y - p[:, 1] - t * d[:, 1]).min()
            up = (p[:, 1] > y) != (q[:, 1] > y)
            cross = (x < d[up, 0] * (y - p[up, 1]) / d[up, 1] + p[up, 0]).sum()
            return far if cross % 2 else -far

        lo, hi = p.min(0), p.max(0)
        half = max(min(hi - lo), max(hi - lo) / 32) / 2
        if not min(hi - lo) > 0:
            return None
        best, work, slack = 0.0, [], max(hi - lo) / 1000
        for cx in np.arange(lo[0] + half, hi[0] + half, 2 * half):
            for cy in np.arange(lo[1] + half, hi[1] + half, 2 * half):
                work.append((-(depth(cx, cy) + half * 2**0.5), cx, cy, half))
        heapq.heapify(work)
        while work:
            bound, cx, cy, h = heapq.heappop(work)
            if -bound <= best + slack or 2 * best >= enough:
                break
            best = max(best, depth(cx, cy))
            h /= 2
            for sx in (-h, h):
                for sy in (-h, h):
                    reach = depth(cx + sx, cy + sy)
                    best = max(best, reach)
                    heapq.heappush(work, (-(reach + h * 2**0.5), cx + sx, cy + sy, h))
        return 2 * best

    @F.pandas_udf(DoubleType())
    def widest(rings: pd.Series) -> pd.Series:
        return pd.Series([one(r) for r in rings], dtype="float64")

    return widest(vertices)


def inner_point(v: Column) -> Column:
    """(x, y) inside the ring: the middle of the widest stretch at half of its height."""
    b = box(v)
    y = (b["ymin"] + b["ymax"]) / 2
    cuts = F.array_sort(F.filter(F.zip_with(v, turned(v), lambda a, c: F.when((a[1] > y) != (c[1] > y), a[0] + (y - a[1]) * (c[0] - a[0]) / (c[1] - a[1]))), lambda x: x.isNotNull()))
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.size(cuts) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.round(F.get(cuts, 2 * i + 1) - F.get(cuts, 2 * i), 6).alias("wide"), (-i).alias("o"), ((F.get(cuts, 2 * i + 1) + F.get(cuts, 2 * i)) / 2).alias("x")))
    return F.struct(F.array_max(spans)["x"].alias("x"), y.alias("y"))


def sharpest_concave(v: Column, least_degrees: float = 90.0) -> Column:
    """The least angle, in degrees, of the ring's concave vertices under ``least_degrees``, null without one; straight vertices (over 175 degrees) aside."""
    winding = F.signum(signed_area(v))
    corners = F.zip_with(F.arrays_zip(v.alias("p"), turned(v, 1).alias("q")), turned(v, 2), lambda t, r: F.struct(t["p"].alias("p"), t["q"].alias("q"), r.alias("r")))

    def angle(c: Column) -> Column:
        ax, ay = c["p"][0] - c["q"][0], c["p"][1] - c["q"][1]
        bx, by = c["r"][0] - c["q"][0], c["r"][1] - c["q"][1]
        length = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
        wide = F.degrees(F.acos(F.greatest(F.least((ax * bx + ay * by) / length, F.lit(1.0)), F.lit(-1.0))))
        return F.when((length > 1e-12) & (wide <= 175.0) & (wide < least_degrees) & (F.signum(-ax * by + ay * bx) == -winding), wide)

    return F.array_min(F.transform(corners, angle))


def edge_distance(x: Column, y: Column) -> Column:
    """Least distance to the sides of the panel's box, negative outside."""
    return F.least(x - F.col("xmin"), F.col("xmax") - x, y - F.col("ymin"), F.col("ymax") - y)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)
