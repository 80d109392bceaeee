"""Rings made valid: crossings become corners, what is told there and back goes, and rings are put together anew.

Segments of one ring meet where they lie in one cell; each is cut at its crossings with others and at corners of others that
lie on it. Corners are snapped to a grid, and as that may make segments meet anew, cutting goes on until nothing is cut. Pieces
that lie on one another an even number of times cancel out, which takes off spikes. At every corner an even number of pieces is
left, and joining neighbours by angle gives rings that cross nothing; those that touch themselves fall into loops. Inside is what an odd number of rings lies around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .chains import joined_lines, simple_loops
from .graph import cut_and_count, cut_lineage, drop_table
from .outlines import nested
from .spatial import line_cells


def _snapped(v: Column, snap: float) -> Column:
    return F.floor(v / snap + 0.5) * snap


def _turn(s: str, x: Column, y: Column) -> Column:
    c = {n: F.col(f"{s}.{n}") for n in ("x1", "y1", "x2", "y2")}
    return F.signum((c["x2"] - c["x1"]) * (y - c["y1"]) - (c["y2"] - c["y1"]) * (x - c["x1"]))


def _cuts(segs: DataFrame, key: str, size: float, snap: float) -> DataFrame:
    """(id, x, y): corners that segments get between their ends."""
    box = F.array(F.struct(F.col("s.x1").alias("x"), F.col("s.y1").alias("y")), F.struct(F.col("s.x2").alias("x"), F.col("s.y2").alias("y")))
    placed = segs.select(key, "id", "s", F.inline(line_cells(box, size, snap)))
    a, b = placed.withColumnsRenamed({"id": "ia", "s": "a"}), placed.withColumnsRenamed({"id": "ib", "s": "b"})
    met = a.join(b, [key, "cx", "cy"]).filter("ia < ib").drop("cx", "cy").distinct()
    end = lambda s, n: (F.col(f"{s}.x{n}"), F.col(f"{s}.y{n}"))
    crossing = (_turn("a", *end("b", 1)) * _turn("a", *end("b", 2)) < 0) & (_turn("b", *end("a", 1)) * _turn("b", *end("a", 2)) < 0)
    ax, ay, bx, by = F.col("a.x2") - F.col("a.x1"), F.col("a.y2") - F.col("a.y1"), F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    t = ((F.col("b.x1") - F.col("a.x1")) * by - (F.col("b.y1") - F.col("a.y1")) * bx) / (ax * by - ay * bx)
    at = F.struct(_snapped(F.col("a.x1") + t * ax, snap).alias("x"), _snapped(F.col("a.y1") + t * ay, snap).alias("y"))

    def on(s: str, x: Column, y: Column) -> Column:
        """Whether a corner lies on a segment, not at its ends; as corners are snapped, within half a step of the grid."""
        near = G.to_segment(x, y, *(F.col(f"{s}.{n}") for n in ("x1", "y1", "x2", "y2"))) <= snap / 2
        return near & ~((x == F.col(f"{s}.x1")) & (y == F.col(f"{s}.y1"))) & ~((x == F.col(f"{s}.x2")) & (y == F.col(f"{s}.y2")))

    spot = lambda i, p: F.struct(F.col(i).alias("id"), p["x"].alias("x"), p["y"].alias("y"))
    touch = [F.when(on(s, *end(o, n)), F.struct(F.col(i).alias("id"), end(o, n)[0].alias("x"), end(o, n)[1].alias("y"))) for s, i, o in (("a", "ia", "b"), ("b", "ib", "a")) for n in (1, 2)]
    found = met.select(F.explode(F.array_compact(F.array(F.when(crossing, spot("ia", at)), F.when(crossing, spot("ib", at)), *touch))).alias("c")).select("c.*")
    own = found.join(segs.select("id", "s"), "id")
    ends = ((F.col("x") == F.col("s.x1")) & (F.col("y") == F.col("s.y1"))) | ((F.col("x") == F.col("s.x2")) & (F.col("y") == F.col("s.y2")))
    return own.filter(~ends).select("id", "x", "y").distinct()


def repaired(rings: DataFrame, key: str, size: float, snap: float = 1e-6, rounds: int = 20) -> DataFrame:
    """(key, chain, ring, depth): valid rings that bound the same area as the closed ``ring`` of every key, even-odd; rings of even depth
    bound it from outside, others are holes. A ring that goes round twice over counts once. What has no area gives no rings.
    size: of the cells in which segments are compared, best about as long as they are; snap: the grid of all corners."""
    half = ((F.size("ring") - 1) / 2).cast("int")
    twice = ((F.size("ring") - 1) % 2 == 0) & (F.slice("ring", 1, F.greatest(half, F.lit(1))) == F.slice("ring", half + 1, F.greatest(half, F.lit(1)))) & (half >= 3)
    once = rings.filter(F.size("ring") >= 4).withColumn("ring", F.when(twice, F.slice("ring", F.lit(1), half + 1)).otherwise(F.col("ring")))
    grid = F.transform("ring", lambda p: F.struct(_snapped(p["x"], snap).alias("x"), _snapped(p["y"], snap).alias("y")))
    real = F.filter(G.segments(grid), lambda s: (s["x1"] != s["x2"]) | (s["y1"] != s["y2"]))
    segs = cut_lineage(once.select(key, F.explode(real).alias("s")).withColumn("id", F.monotonically_increasing_id()))
    for _ in range(rounds):
        cuts, found = cut_and_count(_cuts(segs, key, size, snap), F.lit(True))
        if not found:
            break
        along = G.distance(F.col("x"), F.col("y"), F.col("s.x1"), F.col("s.y1"))
        points = cuts.join(segs.select("id", "s"), "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(along.alias("d"), "x", "y"))).alias("c"))
        line = F.concat(F.array(F.struct(F.col("s.x1").alias("x"), F.col("s.y1").alias("y"))), F.coalesce(F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.array().cast("array<struct<x:double,y:double>>")), F.array(F.struct(F.col("s.x2").alias("x"), F.col("s.y2").alias("y"))))
        later = segs.join(points, "id", "left").select(key, F.explode(F.filter(G.segments(line), lambda s: (s["x1"] != s["x2"]) | (s["y1"] != s["y2"]))).alias("s"))
        later = cut_lineage(later.withColumn("id", F.monotonically_increasing_id()))
        for old in (segs, cuts):
            drop_table(old)
        segs = later
    else:
        raise RuntimeError(f"repaired: segments still meet after {rounds} rounds")
    p, q = (F.struct(F.col(f"s.x{n}").alias("x"), F.col(f"s.y{n}").alias("y")) for n in (1, 2))
    odd = segs.groupBy(key, F.least(p, q).alias("p"), F.greatest(p, q).alias("q")).agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    joined = joined_lines(odd.select(key, F.array("p", "q").alias("line")), [key], areas=True)
    loops = joined.select(key, "chain", F.posexplode(simple_loops(F.col("line"))).alias("n", "ring"))
    return nested(loops.select(key, F.xxhash64("chain", "n").alias("chain"), "ring"), key, size)


def signed_area(depth: Column, ring: Column) -> Column:
    """What a ring adds to its area: its own, taken off for a hole."""
    return F.when(depth % 2 == 0, G.area(ring)).otherwise(-G.area(ring))
