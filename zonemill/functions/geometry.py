"""Plane geometry as column expressions. A point is two columns; a line or ring is array<struct<x:double,y:double>>."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_metres(lon: Column, lat: Column, lon0: float, lat0: float, per_lon: float = 111320.0, per_lat: float = 110540.0) -> tuple[Column, Column]:
    """Equirectangular projection around (lon0, lat0). Several conversions are in use, so the factors are parameters."""
    return (lon - lon0) * (F.lit(per_lon) * F.cos(F.radians(F.lit(lat0)))), (lat - lat0) * F.lit(per_lat)


def to_degrees(x: Column, y: Column, lon0: float, lat0: float, per_lon: float = 111320.0, per_lat: float = 110540.0) -> tuple[Column, Column]:
    return x / (F.lit(per_lon) * F.cos(F.radians(F.lit(lat0)))) + lon0, y / F.lit(per_lat) + lat0


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def segments(line: Column) -> Column:
    """array<struct<x1,y1,x2,y2>>; a single point is a segment of length 0."""
    pairs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(1))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(1))), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), F.coalesce(b["x"], a["x"]).alias("x2"), F.coalesce(b["y"], a["y"]).alias("y2")))
    return F.when(F.size(line) > 0, pairs)


def to_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length))).otherwise(0.0)
    return distance(px, py, x1 + t * dx, y1 + t * dy)


def to_line(px: Column, py: Column, line: Column) -> Column:
    return F.array_min(F.transform(segments(line), lambda s: to_segment(px, py, s["x1"], s["y1"], s["x2"], s["y2"])))


def covers(ring: Column, px: Column, py: Column) -> Column:
    """Whether a closed ring covers a point; the boundary counts as inside."""
    def crossing(s: Column) -> Column:
        over = (s["y1"] > py) != (s["y2"] > py)
        return (over & (px < (s["x2"] - s["x1"]) * (py - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"])).cast("int")

    def touching(s: Column) -> Column:
        cross = (s["x2"] - s["x1"]) * (py - s["y1"]) - (s["y2"] - s["y1"]) * (px - s["x1"])
        return (cross == 0) & px.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & py.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))

    parts = segments(ring)
    inside = F.aggregate(F.transform(parts, crossing), F.lit(0), lambda a, b: a + b) % 2 == 1
    return inside | F.exists(parts, touching)


def area(ring: Column) -> Column:
    """Shoelace area of a closed ring."""
    return F.abs(F.aggregate(F.transform(segments(ring), lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]), F.lit(0.0), lambda a, b: a + b)) / 2


def length(line: Column) -> Column:
    return F.aggregate(F.transform(segments(line), lambda s: distance(s["x1"], s["y1"], s["x2"], s["y2"])), F.lit(0.0), lambda a, b: a + b)


def centroid(ring: Column) -> Column:
    """struct(x, y) of the area's centre; of the vertices' mean where there is no area."""
    parts = segments(ring)
    cross = lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]
    total = lambda f: F.aggregate(F.transform(parts, f), F.lit(0.0), lambda a, b: a + b)
    twice = total(cross)
    mean = lambda k: F.aggregate(F.transform(ring, lambda p: p[k]), F.lit(0.0), lambda a, b: a + b) / F.size(ring)
    x = F.when(twice != 0, total(lambda s: (s["x1"] + s["x2"]) * cross(s)) / (3 * twice)).otherwise(mean("x"))
    y = F.when(twice != 0, total(lambda s: (s["y1"] + s["y2"]) * cross(s)) / (3 * twice)).otherwise(mean("y"))
    return F.struct(x.alias("x"), y.alias("y"))


def midpoint(line: Column) -> Column:
    """struct(x, y) half way along a line."""
    half = length(line) / 2
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def step(acc: Column, s: Column) -> Column:
        d = distance(s["x1"], s["y1"], s["x2"], s["y2"])
        t = F.when(d > 0, (half - acc["run"]) / d).otherwise(0.0)
        here = acc["x"].isNull() & (acc["run"] + d >= half)
        return F.struct((acc["run"] + d).alias("run"), F.when(here, s["x1"] + t * (s["x2"] - s["x1"])).otherwise(acc["x"]).alias("x"), F.when(here, s["y1"] + t * (s["y2"] - s["y1"])).otherwise(acc["y"]).alias("y"))

    return F.aggregate(segments(line), start, step, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y")))


def side_of_line(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 left of the directed line, -1 right of it, 0 on it."""
    return F.signum((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)).cast("int")


def extend_line(line: Column, by: float) -> Column:
    """A line of two points or more, longer by ``by`` at either end in the direction of its end segments. An end segment
    without length does not grow."""

    def beyond(end: Column, inner: Column) -> Column:
        d = distance(end["x"], end["y"], inner["x"], inner["y"])
        t = F.when(d > 0, by / d).otherwise(0.0)
        return F.struct((end["x"] + (end["x"] - inner["x"]) * t).alias("x"), (end["y"] + (end["y"] - inner["y"]) * t).alias("y"))

    at = lambda i: F.element_at(line, i)
    return F.when(F.size(line) >= 2, F.concat(F.array(beyond(at(1), at(2))), line, F.array(beyond(at(-1), at(-2))))).otherwise(line)


def corners_kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the points that stay when a line is thinned: both ends, and between two points that stay the farthest from
    their segment, as long as one is farther than the tolerance. A ring that would lose its area stays as it is."""
    n = len(x)
    stays = np.zeros(n, bool)
    stays[[0, -1]] = True
    spans = [(0, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
        square = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / square, 0, 1) if square > 0 else np.zeros(b - a - 1)
        away = np.hypot(px - t * dx, py - t * dy)
        if away.max() > tolerance:
            far = a + 1 + int(away.argmax())
            stays[far] = True
            spans += [(a, far), (far, b)]
    ring = n > 3 and x[0] == x[-1] and y[0] == y[-1]
    return np.arange(n) if ring and stays.sum() < 4 else np.flatnonzero(stays)


def simplify(line: Column, tolerance: float = 2.0) -> Column:
    """A line or ring without the points that lie within the tolerance of what is left; null stays null. The search for the
    farthest point recurses, so the places come from Arrow batches; the points are taken in the JVM."""

    @F.pandas_udf("array<int>")
    def places(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else corners_kept(np.asarray(a, float), np.asarray(b, float), tolerance) if len(a) else [] for a, b in zip(x, y, strict=True)], dtype=object)

    kept = places(F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"]))
    return F.transform(kept, lambda i: F.get(line, i))


def segments_meet(a: Column, b: Column) -> Column:
    """Whether two segments (structs of x1, y1, x2, y2) share a point."""
    def turn(s: Column, x: Column, y: Column) -> Column:
        return F.signum((s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"]))

    def on(s: Column, x: Column, y: Column) -> Column:
        return (turn(s, x, y) == 0) & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))

    crossing = (turn(a, b["x1"], b["y1"]) * turn(a, b["x2"], b["y2"]) < 0) & (turn(b, a["x1"], a["y1"]) * turn(b, a["x2"], a["y2"]) < 0)
    return crossing | on(a, b["x1"], b["y1"]) | on(a, b["x2"], b["y2"]) | on(b, a["x1"], a["y1"]) | on(b, a["x2"], a["y2"])


def segments_apart(a: Column, b: Column) -> Column:
    """Distance of two segments (structs of x1, y1, x2, y2); 0 where they meet."""
    ends = lambda s: [(s["x1"], s["y1"]), (s["x2"], s["y2"])]
    away = [to_segment(x, y, s["x1"], s["y1"], s["x2"], s["y2"]) for o, s in ((a, b), (b, a)) for x, y in ends(o)]
    return F.when(segments_meet(a, b), 0.0).otherwise(F.least(*away))


def simple_corners(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether a closed ring of four points or more bounds an area and meets itself nowhere but at its ends."""
    n = len(x) - 1
    if n < 3 or x[0] != x[-1] or y[0] != y[-1]:
        return False
    dx, dy = np.diff(x), np.diff(y)
    if ((dx == 0) & (dy == 0)).any() or (x[:-1] * y[1:] - x[1:] * y[:-1]).sum() == 0:
        return False
    # A step back over the last segment is a spike, though neighbours may share their corner.
    bx, by = np.roll(dx, -1), np.roll(dy, -1)
    if ((dx * by - dy * bx == 0) & (dx * bx + dy * by < 0)).any():
        return False
    for i in range(n - 2):  # against all later segments but the neighbours
        j = np.arange(i + 2, n - (i == 0))
        side = lambda k, px, py: np.sign(dx[k] * (py - y[k]) - dy[k] * (px - x[k]))
        inside = lambda k, px, py: (np.minimum(x[k], x[k + 1]) <= px) & (px <= np.maximum(x[k], x[k + 1])) & (np.minimum(y[k], y[k + 1]) <= py) & (py <= np.maximum(y[k], y[k + 1]))
        a, b, c, d = side(i, x[j], y[j]), side(i, x[j + 1], y[j + 1]), side(j, x[i], y[i]), side(j, x[i + 1], y[i + 1])
        touch = ((a == 0) & inside(i, x[j], y[j])) | ((b == 0) & inside(i, x[j + 1], y[j + 1])) | ((c == 0) & inside(j, x[i], y[i])) | ((d == 0) & inside(j, x[i + 1], y[i + 1]))
        if ((a * b < 0) & (c * d < 0) | touch).any():
            return False
    return True


def is_simple(ring: Column) -> Column:
    """simple_corners() of a ring, in Arrow batches; null is not simple. All segments are held against each other: for outlines
    of buildings, not of countries."""

    @F.pandas_udf("boolean")
    def simple(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([a is not None and simple_corners(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(x, y, strict=True)])

    return simple(F.transform(ring, lambda p: p["x"].cast("double")), F.transform(ring, lambda p: p["y"].cast("double")))


def line_meets_ring(line: Column, ring: Column) -> Column:
    """Whether a line crosses, touches or lies in a closed ring."""
    inside = covers(ring, F.element_at(line, 1)["x"], F.element_at(line, 1)["y"])
    return inside | F.exists(segments(line), lambda s: F.exists(segments(ring), lambda r: segments_meet(s, r)))


def line_to_area(line: Column, ring: Column) -> Column:
    """Distance of a line to a closed ring's area; 0 where they meet."""

    def corners(of: Column, to: Column) -> Column:
        return F.array_min(F.transform(of, lambda p: to_line(p["x"], p["y"], to)))

    ours, theirs = corners(line, ring), corners(ring, line)
    return F.when(line_meets_ring(line, ring), 0.0).otherwise(F.least(ours, theirs))


def spread_m(min_lon: Column, max_lon: Column, min_lat: Column, max_lat: Column, per_lon: float = 76000.0, per_lat: float = 111000.0) -> Column:
    return F.greatest((max_lon - min_lon) * per_lon, (max_lat - min_lat) * per_lat)
