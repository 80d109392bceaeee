"""What joins look at where many areas lie over each other: the work is held against what it should grow with."""

import random

import pytest
from pyspark.sql import functions as F

from zonemill.operators import addresses, cover, graph, outlines, spatial, streets
from zonemill.plans import village

LINE = "array<struct<x:double,y:double>>"


def diamonds(spark, spots):
    rows = [(i, [{"x": float(x + a * h), "y": float(y + b * h)} for a, b in ((-1, 0), (0, 1), (1, 0), (0, -1), (-1, 0))]) for i, (x, y, h) in enumerate(spots)]
    return spark.createDataFrame(rows, f"ring_id long, ring {LINE}")


@pytest.fixture
def met(monkeypatch):
    """Rows (points in, pairs out) of every call of containing()."""
    seen, inner = [], spatial.containing

    def counted(points, *args, **more):
        out = inner(points, *args, **more)
        seen.append((points.count(), out.count()))
        return out

    monkeypatch.setattr(spatial, "containing", counted)
    return seen


def test_corners_meet_rings_of_their_own_key_alone(spark, met):
    rings = diamonds(spark, [(0, 0, 40 + i % 7) for i in range(120)]).select((F.col("ring_id") / 2).cast("long").alias("relation_id"), F.col("ring_id").alias("chain"), "ring")
    rings = rings.withColumn("relation_id", F.when(F.col("relation_id") > 0, F.col("relation_id")))
    got = {r.chain: r.depth for r in outlines.nested(rings, size=10.0).collect()}
    size = lambda i: 40 + i % 7
    assert got == {i: int(size(i) < size(i ^ 1)) for i in range(120)}
    assert sum(n for _, n in met) <= 120 * 5 * 2


def test_points_in_many_areas_meet_a_few_of_them(spark, met, monkeypatch):
    rng = random.Random(3)
    spots = [(rng.uniform(-20, 20), rng.uniform(-20, 20), 60) for _ in range(300)] + [(200, 0, 5)]
    places = [(i, rng.uniform(-110, 110), rng.uniform(-110, 110)) for i in range(200)] + [(900, 200.0, 5.0), (901, 200.0, 5.1), (902, float("nan"), 0.0)]
    points = spark.createDataFrame(places, "id long, x double, y double")
    monkeypatch.setattr(cover, "FIRST", 8, raising=False)
    monkeypatch.setattr(cover, "GROWS", 1000, raising=False)
    got = {r.id for r in spatial.inside(points, diamonds(spark, spots), "id", "ring_id", 20).collect()}
    assert got == {i for i, x, y in places if any(abs(x - a) + abs(y - b) <= h for a, b, h in spots)}
    assert sum(n for _, n in met) <= 200 * 60


def test_zones_are_met_by_units_of_their_own_first(spark, met, monkeypatch):
    monkeypatch.setattr(cover, "FIRST", 8, raising=False)
    monkeypatch.setattr(cover, "GROWS", 1000, raising=False)
    zones = diamonds(spark, [(0, 0, 50)] * 40 + [(300, 0, 50)] * 40).select(F.col("ring_id").alias("shape"), F.when(F.col("ring_id") < 40, 0).otherwise(1).alias("zone"), "ring")
    units = spark.createDataFrame([(i, float(300 * (i % 3)), 0.0, i % 2) for i in range(120)], "id long, x double, y double, band int")
    assert tuple(spatial.verify_zones(units, zones, "id", 20).first()) == (40, 40, 40)
    assert sum(n for _, n in met) <= 120 * 20


def test_land_far_from_homes_is_not_cut_into_cells(spark, met):
    homes = spark.createDataFrame([(5.0, 5.0)], "x double, y double")
    roads = spark.createDataFrame([], f"street_id long, line {LINE}")
    cells = spatial.composed_footprint(homes, roads, diamonds(spark, [(0, 0, 900), (5000, 0, 900)]), "street_id", "ring_id", 10, 12, 15, 10, 20)
    assert {(r.cx, r.cy) for r in cells.collect()} == {(i, j) for i in range(-3, 4) for j in range(-3, 4) if (abs(i), abs(j)) in {(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0), (0, 3), (3, 0), (1, 2), (2, 1)}}
    assert max(n for n, _ in met) <= 25


def test_small_blocks_are_settled_together(spark, monkeypatch):
    runs = []
    inner = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: runs.append(1) or inner(df))
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("w"))
    source = spark.range(1).withColumnRenamed("id", "node")
    got = graph.shortest_paths(edges, source, block=lambda n: graph.range_block(n, 10))
    assert got.agg(F.max("dist")).first()[0] == 300.0 and len(runs) <= 12
    monkeypatch.setattr(graph, "GATHER", 150, raising=False)
    again = graph.shortest_paths(edges, source, block=lambda n: graph.range_block(n, 10))
    assert {r.node: r.dist for r in again.collect()} == {i: float(i) for i in range(301)}


def test_blocks_follow_each_other(spark):
    node = lambda x, y: ((x + 2**30) << 31) | (y + 2**30)
    rows = [(x, y, node(x, y)) for x in range(-16, 16) for y in range(-16, 16)]
    got = {(r.x, r.y): r.b for r in spark.createDataFrame(rows, "x int, y int, node long").select("x", "y", graph.cell_block(F.col("node"), 8).alias("b")).collect()}
    assert {(x // 8, y // 8): b for (x, y), b in got.items()}.keys() == {(i, j) for i in range(-2, 2) for j in range(-2, 2)} and len(set(got.values())) == 16
    assert len({b for (x, y), b in got.items() if x >= 0 and y >= 0}) == 4
    quarter = sorted(b for b in {got[x, y] for x in range(0, 16) for y in range(0, 16)})
    assert quarter[-1] - quarter[0] == 3


def test_equal_searches_are_made_once(spark, monkeypatch):
    records = spark.createDataFrame([(f"Oak {i}", "s", "") for i in range(30)] + [("Elm", "t", "")], "street string, settlement string, district string")
    asked = spark.createDataFrame([(i, ("OAK", "oak ", "elm", "xx", "")[i % 5]) for i in range(50)], "query_id long, text string")
    totals = [F.count(F.lit(1)).alias("n"), F.min("street_norm").alias("first")]
    want = {(r.query_id, r.n, r["first"]) for r in addresses.search_many(records, asked).groupBy("query_id").agg(*totals).collect()}
    assert {tuple(r) for r in addresses.search_totals(records, asked, totals).select("query_id", "n", "first").collect()} == want
    assert len(want) == 30


def test_streets_meet_a_few_areas_of_a_crowded_core(spark, monkeypatch):
    monkeypatch.setattr(cover, "FIRST", 8, raising=False)
    monkeypatch.setattr(cover, "GROWS", 1000, raising=False)
    shown, inner = [], streets._touching

    def counted(*args, **more):
        out = inner(*args, **more)
        shown.append(out.count())
        return out

    monkeypatch.setattr(streets, "_touching", counted)
    core = diamonds(spark, [(i % 5, 0, 30) for i in range(200)] + [(500, 0, 5)])
    ends = [(0, 20), (480, 490), (300, 310)]
    rows = [(i % 4, [{"x": float(a), "y": 0.0}, {"x": float(b), "y": 0.0}]) for i in range(60) for a, b in [ends[min(i % 4, 2)]]]
    got = {r.street_id: r.connected for r in streets.connected_to_core(spark.createDataFrame(rows, f"street_id long, line {LINE}"), core, "street_id", "ring_id", 10.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}
    assert sum(shown) <= 60 * 4 * 16


def test_places_in_many_areas_are_covered_by_a_few(spark, met, monkeypatch):
    monkeypatch.setattr(cover, "FIRST", 8, raising=False)
    monkeypatch.setattr(cover, "GROWS", 1000, raising=False)
    places = spark.createDataFrame([(i, float(i % 10), 0.0) for i in range(50)] + [(90, 100.0, 0.0)], "id long, x double, y double")
    got = {r.id: r.distance_m for r in village.area_distance(places, diamonds(spark, [(0, 0, 60)] * 100), 20.0).collect()}
    assert {d for i, d in got.items() if i != 90} == {0.0} and got[90] == 40.0 and len(got) == 51
    assert sum(n for _, n in met) <= 50 * 30
