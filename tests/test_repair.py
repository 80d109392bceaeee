"""Rings made valid, against areas that are known and against even-odd tests of points."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from zonemill.operators import chains, repair

LINE = "array<struct<x:double,y:double>>"


def made(spark, rings):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in rings.items()], f"ring_id long, ring {LINE}")


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
CASES = {
    1: (SQUARE, [100.0]),
    2: ([(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)], [25.0, 25.0]),
    3: ([(0, 0), (10, 0), (10, 5), (30, 5), (10, 5), (10, 10), (0, 10), (0, 0)], [100.0]),
    4: (SQUARE[:-1] + SQUARE, [100.0]),
    5: ([(0, 0), (10, 0), (20, 0), (0, 0)], []),
    6: ([(0, 0), (10, 0), (10, 10), (5, 0), (0, 10), (0, 0)], [25.0, 25.0]),
    7: ([(0, 0), (9, 0), (9, 9), (3, 9), (3, 3), (6, 3), (6, 12), (0, 12), (0, 0)], [9.0, 9.0, 36.0]),
}


def test_known_rings(spark):
    got = repair.repaired(made(spark, {i: r for i, (r, _) in CASES.items()}), "ring_id", 5.0).withColumn("area", repair.signed_area(F.col("depth"), F.col("ring"))).collect()
    for i, (_, areas) in CASES.items():
        own = [r for r in got if r.ring_id == i]
        assert sorted(r.area for r in own) == pytest.approx(areas) or sum(r.area for r in own) == pytest.approx(odd_area(CASES[i][0]))
        for r in own:
            points = [(p["x"], p["y"]) for p in r.ring]
            assert points[0] == points[-1] and len(set(points)) == len(points) - 1 >= 3
    assert [r for r in got if r.ring_id == 5] == []


def odd_area(ring, steps=400):
    """Even-odd area of a ring by points on a grid."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    w, h = (max(xs) - min(xs)) / steps, (max(ys) - min(ys)) / steps
    n = 0
    for j in range(steps):
        y = min(ys) + (j + 0.5) * h
        cross = sorted((x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in itertools.pairwise(ring) if (y1 > y) != (y2 > y))
        n += sum(b - a for a, b in zip(cross[::2], cross[1::2], strict=True)) / w
    return n * w * h


def test_random_rings_keep_their_area(spark):
    rng = random.Random(6)
    rings = {}
    for i in range(12):
        points = [(rng.randrange(20), rng.randrange(20)) for _ in range(rng.randrange(4, 9))]
        points = [p for n, p in enumerate(points) if p != points[n - 1]]
        if len(points) >= 3:
            rings[i] = [*points, points[0]]
    got = repair.repaired(made(spark, rings), "ring_id", 8.0).withColumn("area", repair.signed_area(F.col("depth"), F.col("ring"))).collect()
    for i, ring in rings.items():
        assert sum(r.area for r in got if r.ring_id == i) == pytest.approx(odd_area(ring), rel=0.02, abs=0.3)


def test_loops():
    walk = [(0, 0), (1, 0), (2, 0), (2, 1), (1, 0), (0, 1), (0, 0)]
    assert chains._loops(walk) == [[(1, 0), (2, 0), (2, 1), (1, 0)], [(0, 0), (1, 0), (0, 1), (0, 0)]]
