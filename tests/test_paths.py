"""Shortest paths in blocks, and clusters with crowded cells, against plain code."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from zonemill.operators import graph


def plain_paths(edges, sources, limit):
    near, best, heap = {}, {}, [(0.0, s) for s in sources]
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    while heap:
        d, a = heapq.heappop(heap)
        if a in best:
            continue
        best[a] = d
        for b, w in near.get(a, []):
            if b not in best and d + w < limit:
                heapq.heappush(heap, (d + w, b))
    return best


@pytest.mark.parametrize(("wide", "limit"), [(1000, float("inf")), (16, float("inf")), (16, 12.0)])
def test_paths_in_blocks(spark, wide, limit):
    rng = random.Random(wide)
    edges = [(i, i + 1, float(rng.randint(0, 5))) for i in range(150) if i % 31] + [(rng.randrange(160), rng.randrange(160), float(rng.randint(1, 9))) for _ in range(60)] + [(3, 4, 1.0), (4, 3, 0.5), (900, 901, 1.0)]
    sources = [0, 77, 900_000]
    got = graph.shortest_paths(spark.createDataFrame(edges, "a long, b long, w double"), spark.createDataFrame([(s,) for s in sources], "node long"), limit, block=lambda n: graph.range_block(n, wide))
    assert {r.node: r.dist for r in got.collect()} == plain_paths(edges, sources, limit)


def test_large_ids_keep_every_digit(spark):
    big = (1 << 61) + 7
    got = graph.shortest_paths(spark.createDataFrame([(big, big + 1, 1.0), (big + 1, big + 2, 1.0)], "a long, b long, w double"), spark.createDataFrame([(big,)], "node long"))
    assert {r.node: r.dist for r in got.collect()} == {big: 0.0, big + 1: 1.0, big + 2: 2.0}


def test_rounds_follow_blocks_not_hops(spark, monkeypatch):
    runs = []
    inner = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: runs.append(1) or inner(df))
    edges = spark.range(600).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("w"))
    got = graph.shortest_paths(edges, spark.range(1).withColumnRenamed("id", "node"), block=lambda n: graph.range_block(n, 200))
    assert got.agg(F.max("dist")).first()[0] == 600.0 and len(runs) <= 2 + 2 * 5 + 1


def plain_clusters(points, radius):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in enumerate(points):
        for j in range(i):
            if (p[0] - points[j][0]) ** 2 + (p[1] - points[j][1]) ** 2 <= radius**2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(points))}


def test_crowded_cells_are_refined(spark, monkeypatch):
    rng = random.Random(4)
    spots = [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(60)]
    points = [(x + rng.uniform(0, 3), y + rng.uniform(0, 3)) for x, y in spots for _ in range(6)] + [(200.0, 200.0), (204.9, 200.0), (205.1, 206.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double")
    want = plain_clusters(points, 5.0)
    for many in (4, 10**9):
        monkeypatch.setattr(graph, "MANY", many)
        assert {r.id: r.cluster for r in graph.radius_components(df, "id", 5.0).collect()} == want


def test_two_full_cells_cost_no_square(spark):
    # Two discs of 20,000 points each, 4.9 and 5.1 apart at their nearest: hundreds of millions of pairs if compared.
    ring = spark.range(20_000).select((F.col("id") * 0.618 % 1 * 2).alias("u"), (F.col("id") * 0.414 % 1 * 2).alias("v"), "id")
    places = [(0.0, 0, "u"), (6.9, 1, "u"), (14.0, 2, "u")]
    df = None
    for x, n, _ in places:
        own = ring.select((F.col("id") + n * 100_000).alias("id"), (F.col("u") + x).alias("x"), F.col("v").alias("y"))
        df = own if df is None else df.unionByName(own)
    got = {r.cluster: r["count"] for r in graph.radius_components(df, "id", 5.0).groupBy("cluster").count().collect()}
    assert got == {0: 40_000, 200_000: 20_000}
