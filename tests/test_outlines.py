"""Chains, outlines, covers and nearest lines against plain code."""

import itertools
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonemill.errors import SpatialAuditUnavailable
from zonemill.operators import chains, cover, graph, outlines, spatial

LINE = "array<struct<x:double,y:double>>"


def test_rank_chains(spark):
    rng = random.Random(1)
    ids, want, links = list(range(200)), {}, []
    rng.shuffle(ids)
    at = 0
    for n, closed in ((1, False), (1, True), (2, True), (37, False), (64, True), (65, True), (20, False)):
        own, at = ids[at : at + n], at + n
        if closed:
            k = own.index(min(own))
            own = own[k:] + own[:k]
        links += [(v, own[i - 1] if i or closed else None) for i, v in enumerate(own)]
        want |= {v: (own[0], i, closed) for i, v in enumerate(own)}
    got = chains.rank_chains(spark.createDataFrame(links, "id long, before long"))
    assert {r.id: (r.chain, r.pos, r.closed) for r in got.collect()} == want


def plain_components(cells):
    left, out = set(cells), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            todo += [c for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if c in left]
            left.difference_update(todo)
        out.append(part)
    return out


def plain_holes(part):
    xs, ys = [x for x, _ in part], [y for _, y in part]
    box = set(itertools.product(range(min(xs) - 1, max(xs) + 2), range(min(ys) - 1, max(ys) + 2))) - part
    groups = []
    while box:
        group, todo = set(), [box.pop()]
        while todo:
            x, y = todo.pop()
            group.add((x, y))
            todo += [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (x + i, y + j) in box]
            box.difference_update(todo)
        groups.append(group)
    return len(groups) - 1


def shoelace(ring):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in itertools.pairwise(ring)) / 2


@pytest.fixture(scope="module")
def grids(spark):
    rng = random.Random(7)
    cells = {b: {(x, y) for x in range(-7, 8) for y in range(-7, 8) if rng.random() < share} for b, share in ((1, 0.45), (2, 0.7), (3, 0.9))}
    cells[4] = {(x, y) for x in range(9) for y in range(9) if max(abs(x - 4), abs(y - 4)) % 2 == 0}
    cells[None] = {(5, 5)}
    return cells, spark.createDataFrame([(b, x, y) for b, own in cells.items() for x, y in own], "band int, cx long, cy long")


def test_rings_of_cells(grids):
    cells, df = grids
    rings = outlines.rings_of_cells(df.unionByName(df.filter("band = 1")), ["band"], 10).collect()
    for band, own in cells.items():
        if band is None:
            continue
        mine = [r for r in rings if r.band == band]
        parts = plain_components(own)
        assert sum(not r.hole for r in mine) == len(parts)
        assert sum(r.hole for r in mine) == sum(map(plain_holes, parts))
        assert sum(r.area for r in mine) == 100.0 * len(own)
        for r in mine:
            assert r.ring[0] == r.ring[-1] and shoelace(r.ring) == r.area and (r.area < 0) == r.hole and len(r.ring) == r.corners + 1
            assert (r.ring[0]["x"], r.ring[0]["y"]) == min((p["x"], p["y"]) for p in r.ring) == (10.0 * r.x0, 10.0 * r.y0)
            turns = [(b["x"] - a["x"]) * (c["x"] - b["x"]) + (b["y"] - a["y"]) * (c["y"] - b["y"]) for a, b, c in zip(r.ring, r.ring[1:], r.ring[2:], strict=False)]
            assert all(t == 0 for t in turns)
    assert len({(r.band, r.x0, r.y0) for r in rings}) == len(rings)


def test_polygons_have_their_holes(grids):
    cells, df = grids
    polygons = outlines.polygons_of(outlines.rings_of_cells(df.filter("band IS NOT NULL"), ["band"], 10), ["band"], 10).collect()
    for band, own in cells.items():
        if band is None:
            continue
        mine = sorted((p.area, len(p.holes)) for p in polygons if p.band == band)
        assert mine == sorted((100.0 * len(part), plain_holes(part)) for part in plain_components(own))


def test_drawn_outline_of_nothing(spark):
    none = spark.createDataFrame([], "band int, cx long, cy long")
    assert outlines.rings_of_cells(none, ["band"], 10).count() == 0


def members(spark, rows):
    return spark.createDataFrame([(k, None if line is None else [{"x": float(x), "y": float(y)} for x, y in line]) for k, line in rows], f"relation_id long, line {LINE}")


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]


def test_assembled_multipolygon(spark):
    hole = [(2, 2), (4, 2), (4, 4), (2, 4)]
    island = [(x * 0.1 + 2.5, y * 0.1 + 2.5) for x, y in SQUARE]
    away = [(x + 100, y) for x, y in SQUARE]
    rows = [(1, SQUARE[:3]), (1, SQUARE[:1] + SQUARE[3:1:-1]), (1, hole[:2]), (1, [hole[0], hole[3], hole[2], hole[1]]), (1, island), (1, away), (2, SQUARE)]
    rings = outlines.require_areas(members(spark, rows))
    assert sorted((r.relation_id, len(r.ring), abs(shoelace(r.ring))) for r in rings.collect()) == [(1, 5, 1.0), (1, 5, 4.0), (1, 5, 100.0), (1, 5, 100.0), (2, 5, 100.0)]
    depth = {(r.relation_id, abs(shoelace(r.ring)), r.ring[0]["x"] > 50): r.depth for r in outlines.nested(rings).collect()}
    assert depth == {(1, 100.0, False): 0, (1, 100.0, True): 0, (1, 4.0, False): 1, (1, 1.0, False): 2, (2, 100.0, False): 0}
    spots = {1: (1, 1), 2: (3.8, 3.8), 3: (3, 3), 4: (105, 5), 5: (50, 5), 6: (2, 3), 7: (10, 10)}
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in spots.items()], "id long, x double, y double")
    got = {(r.id, r.relation_id) for r in spatial.containing(pts, rings, "id", "relation_id", 3).collect()}
    assert got == {(1, 1), (3, 1), (4, 1), (6, 1), (7, 1), (1, 2), (2, 2), (3, 2), (6, 2), (7, 2)}


@pytest.mark.parametrize(
    "rows", [[(1, SQUARE), (1, None)], [(1, SQUARE[:4])], [(1, SQUARE[:3]), (1, SQUARE[2:]), (1, [(10, 10), (20, 20)])], [(1, SQUARE), (2, [(0, 0), (1, 1), (0, 0)])], []]
)
def test_what_is_no_outline_is_an_error(spark, rows):
    with pytest.raises(SpatialAuditUnavailable):
        outlines.require_areas(members(spark, rows))


def test_rings_may_touch_in_a_point(spark):
    rings = outlines.require_areas(members(spark, [(1, SQUARE), (1, [(0, 0), (3, 1), (1, 3), (0, 0)])]))
    assert sorted(r.depth for r in outlines.nested(rings).collect()) == [0, 1]


def test_merged_streets(spark):
    lines = [("a", [(0, 0), (5, 0)]), ("a", [(9, 0), (5, 0)]), ("a", [(9, 0), (9, 3)]), ("a", [(50, 50), (51, 50)]), ("b", [(5, 0), (5, 5)]), ("c", [(0, 0), (1, 0)]), ("c", [(1, 0), (2, 1)]), ("c", [(1, 0), (2, -1)])]
    df = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in line]) for k, line in lines], f"street string, line {LINE}")
    got = {r.street: r for r in chains.merged_streets(df, "street").collect()}
    assert (got["a"].parts, got["a"].length, got["a"].longest) == (2, 13.0, 12.0) and len(got["a"].line) == 4
    assert got["b"].parts == 1 and got["c"].parts == 3


def plain_inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in itertools.pairwise(ring):
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_cover_matches_plain_test(spark):
    rng = random.Random(11)
    rings = []
    for n in range(12):
        around, far = rng.uniform(-50, 50), rng.choice([3, 40, 400])
        pts = [(around + far * rng.uniform(0.3, 1) * np.cos(t), far * rng.uniform(0.3, 1) * np.sin(t)) for t in np.linspace(0, 2 * np.pi, rng.choice([3, 8, 200]), endpoint=False)]
        pts = [(float(round(x)), float(round(y))) for x, y in pts] if n % 2 else [(float(x), float(y)) for x, y in pts]
        rings.append([*pts, pts[0]])
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)], f"ring_id long, ring {LINE}")
    pts = [(rng.uniform(-450, 450), rng.uniform(-450, 450)) for _ in range(300)] + [(float(rng.randint(-60, 60)), float(rng.randint(-60, 60))) for _ in range(300)] + [r[0] for r in rings]
    got = spatial.containing(spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id long, x double, y double"), df, "id", "ring_id", 7)
    want = {(i, k) for i, p in enumerate(pts) for k, r in enumerate(rings) if plain_inside(r, *p)}
    assert {(r.id, r.ring_id) for r in got.collect()} == want


def test_cover_follows_the_ring_not_its_area(spark):
    t = np.linspace(0, 2 * np.pi, 200)
    sizes = {}
    for far in (1_000.0, 100_000.0):
        sizes[far] = sum(len(c[1]) for c in cover.ring_cells(far * np.cos(t), far * np.sin(t), 10.0))
    assert sizes[100_000.0] < 1.5 * sizes[1_000.0] + 200
    inner = sum((10.0 * 2**level) ** 2 * i.sum() for level, _, _, i, _, _ in cover.ring_cells(1000 * np.cos(t), 1000 * np.sin(t), 10.0))
    assert 0.5 < inner / (np.pi * 1e6) < 1


def test_ring_area_cells(spark):
    ring = [(0, 0), (95, 0), (95, 95), (0, 95), (0, 0)]
    df = spark.createDataFrame([(1, [{"x": float(x), "y": float(y)} for x, y in ring])], f"ring_id long, ring {LINE}")
    assert {(r.cx, r.cy) for r in spatial.ring_area_cells(df, "ring_id", 10).collect()} == {(x, y) for x in range(10) for y in range(10) if 10 * x + 5 <= 95 and 10 * y + 5 <= 95}


def test_nearest_lines_however_far(spark):
    rng = random.Random(3)
    lines = [[(x := rng.uniform(-100, 100), y := rng.uniform(-100, 100)), (x + rng.uniform(-80, 80), y + 5), (x + 9, y - 30)] for _ in range(40)] + [[(0.0, 0.0)], [(5000.0, 5000.0), (5400.0, 5000.0)]]
    pts = [(rng.uniform(-120, 120), rng.uniform(-120, 120)) for _ in range(150)] + [(90_000.0, -3.0), (-7000.0, 80.0), (5200.0, 4000.0), (0.0, 0.0)]

    def away(x, y, line):
        best = np.hypot(x - line[0][0], y - line[0][1])
        for (x1, y1), (x2, y2) in itertools.pairwise(line):
            s = (x2 - x1) ** 2 + (y2 - y1) ** 2
            u = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / s)) if s else 0.0
            best = min(best, np.hypot(x - x1 - u * (x2 - x1), y - y1 - u * (y2 - y1)))
        return best

    p = spark.createDataFrame([(i, *q) for i, q in enumerate(pts)], "id long, x double, y double")
    s = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in line]) for i, line in enumerate(lines)], f"street long, line {LINE}")
    for size in (3.0, 50.0):
        got = {r.id: (r.street, r.distance) for r in cover.nearest_lines(p, s, "id", "street", size).collect()}
        for i, q in enumerate(pts):
            d = [away(*q, line) for line in lines]
            assert got[i][0] == int(np.argmin(d)) and got[i][1] == pytest.approx(min(d))
    assert [r.street for r in cover.nearest_lines(p.limit(2), s.limit(0), "id", "street", 3.0).collect()] == [None, None]


def test_clips(spark):
    cells = spark.createDataFrame([(x, y) for x in range(6) for y in range(6)], "cx long, cy long")
    kept, removed = spatial.clip_direction(cells, 30.0, 0.0, "east", 10)
    assert {r.cx for r in kept.collect()} == {0, 1, 2} and {r.cx for r in removed.collect()} == {3, 4, 5}
    line = [(30.0, -5.0), (30.0, 25.0), (50.0, 45.0)]
    left = spatial.clip_to_side(cells, line, (0.0, 10.0), 10).collect()
    assert all(r.applied for r in left) and {(r.cx, r.cy) for r in left} == {(x, y) for x in range(6) for y in range(6) if x < 3 or y >= x}
    for line, keep in (([(900.0, 0.0), (900.0, 9.0)], (1000.0, 0.0)), ([(30.0, 0.0), (30.0, 9.0)], (30.0, 50.0)), ([(3.0, 3.0)], (0.0, 0.0))):
        whole = spatial.clip_to_side(cells, line, keep, 10)
        assert whole.count() == 36 and whole.filter("applied").count() == 0


def test_tables_of_loops_are_deleted(spark):
    folder = Path(graph._folder(spark).removeprefix("file://"))
    before = set(folder.glob("loop-*"))
    graph.connected(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()
    chains.rank_chains(spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "id long, before long")).collect()
    assert len(set(folder.glob("loop-*")) - before) <= 2


def test_pairs_on_edges_and_points_without_places(spark):
    """A point that rounding moves off a slanted edge belongs to the area; a formula, where given, decides; NaN lies nowhere."""
    rows, points = [], []
    for n in range(200):
        cx, cy, h = (n * 731 % 12345) / 100 / 12 - 400, float(n * 37 % 400 - 200), 40.0 + n % 25
        rows.append((n, [(cx - h, cy), (cx, cy + h), (cx + h, cy), (cx, cy - h), (cx - h, cy)], cx, cy, h))
        points.append((n, cx + 30, cy + h - 30))
    points += [(900, float("nan"), 0.0), (901, 0.0, float("nan")), (902, float("inf"), 0.0), (903, None, 0.0)]
    rings = spark.createDataFrame(rows, f"r long, ring {LINE}, cx double, cy double, h double")
    at = spark.createDataFrame(points, "id long, x double, y double")
    got = {(g.id, g.r) for g in spatial.containing(at, rings, "id", "r", 50.0).collect()}
    assert all((n, n) in got for n in range(200)) and max(g[0] for g in got) < 200
    settled = {(g.id, g.r) for g in spatial.containing(at, rings, "id", "r", 50.0, settle="abs(x - cx) + abs(y - cy) <= h").collect()}
    assert settled == {(p, r) for p, x, y in points[:200] for r, _, cx, cy, h in rows if abs(x - cx) + abs(y - cy) <= h}


def test_full_cells_get_finer_and_counts_keep_nothing_twice(spark):
    """Many lines in one of the cells asked for make finer cells; nearest partners and counts are those of plain code."""
    rng = random.Random(7)
    lines = [(n, [(x := rng.uniform(0, 50), y := rng.uniform(0, 50)), (x + 3, y + 1), *([(x + 5, y)] if n % 3 == 0 else [])]) for n in range(400)]
    points = [(n, rng.uniform(-20, 70), rng.uniform(-20, 70)) for n in range(300)]
    streets, at = spark.createDataFrame(lines, f"s long, line {LINE}"), spark.createDataFrame([*points, (999, float("nan"), 1.0)], "id long, x double, y double")
    segs = spark.createDataFrame([(*a, *b) for _, line in lines for a, b in itertools.pairwise(line)], "x1 double, y1 double, x2 double, y2 double")
    assert cover._fine(segs, 100.0) < 10

    def away(x, y, line):
        out = []
        for (x1, y1), (x2, y2) in itertools.pairwise(line):
            t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            out.append(((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) ** 0.5)
        return min(out)

    got = {r.id: r.s for r in spatial.nearest_line(at, streets, "id", "s", 9.0).collect()}
    want = {i: min((away(x, y, line), s) for s, line in lines) for i, x, y in points}
    assert got == {i: s if d <= 9 else None for i, (d, s) in want.items()} | {999: None}
    counts = spatial.corridor_counts(streets, at, "s", "id", {"n": F.lit(True), "even": F.col("id") % 2 == 0}, 6.0)
    near = {s: [i for i, x, y in points if away(x, y, line) <= 6] for s, line in lines}
    assert {(r.s, r.n, r.even) for r in counts.collect()} == {(s, len(v), sum(i % 2 == 0 for i in v)) for s, v in near.items()}


def test_small_rings_are_covered_without_python(spark):
    """Rings of few corners in few cells are cut by expressions, larger ones by a function; both hold the same points."""
    rng = random.Random(3)
    rows = [(n, [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]) for n in range(300) for x, y, w in [(rng.uniform(-60, 60), rng.uniform(-60, 60), rng.choice((2.0, 6.0, 40.0)))]]
    points = [(n, rng.uniform(-70, 110), rng.uniform(-70, 110)) for n in range(500)]
    rings, at = spark.createDataFrame(rows, f"r long, ring {LINE}"), spark.createDataFrame(points, "id long, x double, y double")
    made = cover.ring_cover(rings.filter(F.col("ring")[1]["x"] - F.col("ring")[0]["x"] < 10), "r", 20.0)
    assert made.filter("size(segs) = 4").select("r").distinct().count() == made.select("r").distinct().count()  # all four, uncut
    got = {(g.id, g.r) for g in spatial.containing(at, rings, "id", "r", 20.0).collect()}
    assert got == {(i, r) for i, x, y in points for r, ring in rows if ring[0][0] <= x <= ring[2][0] and ring[0][1] <= y <= ring[2][1]}
