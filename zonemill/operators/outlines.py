"""Outlines: areas of square cells as rings, and rings assembled from the member lines of a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SpatialAuditUnavailable
from .chains import joined_lines, rank_chains
from .graph import cut_lineage

#: Border edges of a cell, run round it with the cell on the left: direction, start, and the neighbour beyond. Directions are
#: 0 east, 1 north, 2 west, 3 south.
_SIDES = [(0, 0, 0, 0, -1), (1, 1, 0, 1, 0), (2, 1, 1, 0, 1), (3, 0, 1, -1, 0)]


def _runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Longest straight stretches of the border: keys, dir, start (sx, sy), end (ex, ey) in cell corners, and an inner cell."""
    sides = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dir", "i", "j", "ni", "nj"), s, strict=True)]) for s in _SIDES])
    own = cells.select(*keys, "cx", "cy").distinct()
    edges = own.select(*keys, "cx", "cy", F.inline(sides))
    beyond = own.select(*keys, F.col("cx").alias("_nx"), F.col("cy").alias("_ny"))
    edges = edges.withColumns({"_nx": F.col("cx") + F.col("ni"), "_ny": F.col("cy") + F.col("nj")}).join(beyond, [*keys, "_nx", "_ny"], "left_anti")
    x, y = F.col("cx") + F.col("i"), F.col("cy") + F.col("j")
    level = F.col("dir") % 2 == 0  # east or west
    ahead = F.when(F.col("dir") < 2, 1).otherwise(-1)
    edges = edges.select(*keys, "dir", "cx", "cy", F.when(level, y).otherwise(x).alias("line"), (F.when(level, x).otherwise(y) * ahead).alias("t"))
    row = Window.partitionBy(*keys, "dir", "line").orderBy("t")
    edges = edges.withColumn("island", F.col("t") - F.row_number().over(row))
    runs = edges.groupBy(*keys, "dir", "line", "island").agg(F.min("t").alias("a"), (F.max("t") + 1).alias("b"), F.min(F.struct("cx", "cy")).alias("cell"))
    a, b = F.col("a") * ahead, F.col("b") * ahead
    return runs.select(
        *keys, "dir", "cell", F.when(level, a).otherwise(F.col("line")).alias("sx"), F.when(level, F.col("line")).otherwise(a).alias("sy"),
        F.when(level, b).otherwise(F.col("line")).alias("ex"), F.when(level, F.col("line")).otherwise(b).alias("ey"),
    )


def rings_of_cells(cells: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Rings of each key's cells (cx, cy): keys, x0, y0 (the least corner, which names the ring within its key), hole, corners, area
    (positive, of a hole negative), inner (a cell that the ring bords from inside) and ring (closed, counter-clockwise, holes
    clockwise; corners only). Cells that touch in a corner only lie in different rings. The signed areas of a key's rings sum up to its cells' area."""
    runs = cut_lineage(_runs(cells, keys).withColumn("id", F.monotonically_increasing_id()))
    # Where two stretches arrive at a corner, cells touch there diagonally: the border turns left, back along its own cell.
    came = runs.select(*keys, F.col("ex").alias("sx"), F.col("ey").alias("sy"), F.col("id").alias("before"), F.col("dir").alias("_dir"))
    turn = F.pmod(F.col("dir") - F.col("_dir") - 1, F.lit(4))
    links = runs.join(came, [*keys, "sx", "sy"]).groupBy("id").agg(F.min_by("before", turn).alias("before"))
    placed = runs.join(rank_chains(links), "id")
    twice = F.sum(F.col("sx") * F.col("ey") - F.col("ex") * F.col("sy"))
    found = placed.groupBy(*keys, "chain").agg(
        F.min(F.struct("sx", "sy")).alias("first"), F.min("cell").alias("inner"), F.count(F.lit(1)).alias("corners"), twice.alias("twice"),
        F.sort_array(F.collect_list(F.struct("pos", "sx", "sy"))).alias("at"),
    )
    # Every ring starts at its least corner; a corner stands once in a ring, but for two parts of a hole that touch there.
    start = F.array_position(F.transform("at", lambda p: F.struct(p["sx"].alias("sx"), p["sy"].alias("sy"))), F.col("first")).cast("int")
    turned = F.concat(F.slice("at", start, F.size("at")), F.slice("at", F.lit(1), start))
    ring = F.transform(turned, lambda p: F.struct((p["sx"] * float(size)).alias("x"), (p["sy"] * float(size)).alias("y")))
    return found.select(*keys, F.col("first.sx").alias("x0"), F.col("first.sy").alias("y0"), (F.col("twice") < 0).alias("hole"), "corners", (F.col("twice") * float(size * size) / 2).alias("area"), "inner", ring.alias("ring"))


def polygons_of(rings: DataFrame, keys: list[str], size: float) -> DataFrame:
    """keys, x0, y0, area (holes taken off), ring, holes (array of rings): every outer ring with the holes in it. A hole belongs to the
    smallest outer ring of its key around the cell that it borders on."""
    from .spatial import containing

    rings = cut_lineage(rings.withColumn("_id", F.xxhash64(*keys, "x0", "y0")))
    outer, holes = rings.filter("NOT hole"), rings.filter("hole")
    middle = lambda c: (F.col(f"inner.{c}") + 0.5) * size
    hits = containing(holes.select(F.col("_id").alias("_hole"), middle("cx").alias("x"), middle("cy").alias("y")), outer, "_hole", "_id", size)
    sized = hits.join(outer.select("_id", F.col("area").alias("_area"), *[F.col(k).alias(f"_o_{k}") for k in keys]), "_id").join(holes.select(F.col("_id").alias("_hole"), "area", "ring", *keys), "_hole")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    owner = sized.filter(same).groupBy("_hole").agg(F.min_by("_id", "_area").alias("_id"), F.first("area").alias("area"), F.first("ring").alias("ring"))
    inside = owner.groupBy("_id").agg(F.sum("area").alias("_off"), F.sort_array(F.collect_list("ring")).alias("holes"))
    out = outer.join(inside, "_id", "left")
    none = F.array().cast(outer.select(F.array("ring")).schema[0].dataType)
    return out.select(*keys, "x0", "y0", (F.col("area") + F.coalesce("_off", F.lit(0.0))).alias("area"), "ring", F.coalesce("holes", none).alias("holes"))


def assembled(members: DataFrame, key: str = "relation_id") -> tuple[DataFrame, DataFrame]:
    """(rings, problems) of all relations at once. members: key and line (array of points x, y; null where the way is missing), one
    row for each outline member. rings: key, chain, line, closed at its ends. problems: key, missing (members without a line), open (joined
    lines that are no ring, as an odd number of ends meets somewhere), short (rings of under four points)."""
    lines = members.select(key, "line")
    joined = cut_lineage(joined_lines(lines, [key], areas=True))
    ok = F.col("closed") & (F.size("line") >= 4)
    faults = joined.groupBy(key).agg(F.count_if(~F.col("closed")).alias("open"), F.count_if(F.col("closed") & ~ok).alias("short"))
    gone = lines.groupBy(key).agg(F.count_if(F.coalesce(F.size("line"), F.lit(-1)) < 2).alias("missing"))
    problems = gone.join(faults, key, "left").fillna(0, ["open", "short"]).filter("missing + open + short > 0")
    return joined.filter(ok).select(key, "chain", F.col("line").alias("ring")), problems.select(key, "missing", "open", "short")


def nested(rings: DataFrame, key: str = "relation_id", size: float = 1.0) -> DataFrame:
    """rings with depth: how many other rings of the same key lie around each. Rings of even depth bound an area from outside, others
    are holes. A ring is judged by its first corner that lies on no other ring, so rings may touch."""
    from .spatial import containing

    named = cut_lineage(rings.withColumn("_id", F.xxhash64(key, "chain")))
    # Corners meet rings of their own key alone, by its hash, which nulls have too; the test of equality follows.
    named = named.withColumn("_by", F.xxhash64(key))
    corners = named.select(F.col("_id").alias("_of"), "_by", F.posexplode("ring").alias("_n", "p")).select(F.struct("_of", "_n").alias("_at"), "_by", "p.x", "p.y")
    met = containing(corners, named, "_at", "_id", size, edges=True, by="_by", coarse=True).join(named.select("_id", F.col(key).alias("_ring_key")), "_id")
    met = met.select(F.col("_at._of").alias("_of"), F.col("_at._n").alias("_n"), "_id", "_ring_key", "on_edge").join(named.select(F.col("_id").alias("_of"), F.col(key).alias("_own_key")), "_of")
    met = met.filter(F.col("_ring_key").eqNullSafe(F.col("_own_key")) & (F.col("_of") != F.col("_id")))
    per = met.groupBy("_of", "_n").agg(F.count(F.lit(1)).alias("around"), F.max("on_edge").alias("touches"))
    every = corners.select(F.col("_at._of").alias("_of"), F.col("_at._n").alias("_n")).join(per, ["_of", "_n"], "left").fillna(0, ["around"]).fillna(False, ["touches"])
    depth = every.groupBy("_of").agg(F.min_by("around", F.struct("touches", "_n")).alias("depth"))
    return named.join(depth.withColumnRenamed("_of", "_id"), "_id").drop("_id", "_by")


def require_areas(members: DataFrame, key: str = "relation_id") -> DataFrame:
    """The rings of assembled(); an error if any relation has a problem, and no box stands in for it."""
    rings, problems = assembled(members, key)
    bad = problems.orderBy(key).limit(5).collect()
    if bad or rings.isEmpty():
        raise SpatialAuditUnavailable(f"outlines cannot be assembled: {[r.asDict() for r in bad] or 'no member'}")
    return rings
