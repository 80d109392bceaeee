"""Connected components by alternating large-star and small-star rounds on kept tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (a, b), two longs a row, in any order, repeats and loops allowed. Returns (node, root) for every node on an
    edge to another node; root is the smallest node of the component. Only a row count and a checksum of a round come to
    the driver. The minima stand in a kept table, so that both sides of the joins are dealt alike and a hub's rows can be
    split. An empty table gives an empty result."""
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = keep(pairs.distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "large-star")
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        later = keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(later)
        for old in (now, least, large, low):
            forget(old)
        now = later
        if mark == before:
            break
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
