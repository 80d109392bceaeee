"""Order along chains by pointer jumping, and lines joined end to end with it.

A chain is a path or a cycle of nodes that each know the one before. In every round each node looks at what the node it
points to knows and then points twice as far, so a chain of n nodes is ranked in about log2(n) rounds of one join each, and
no chain is ever gathered in one task to be put in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .graph import cut_and_count, cut_lineage, drop_table


def rank_chains(links: DataFrame, rounds: int = 64) -> DataFrame:
    """links: id (long, unique) and before (the id before it, null at the head of a path; no id stands before two). Returns
    (id, chain, pos, closed): a path is named by its head and counted from it, a cycle by its least id and counted from that."""
    first = F.col("before").isNull()
    state = cut_lineage(
        links.select(
            "id", F.col("before").alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("walked"), F.coalesce("before", "id").alias("end"),
            F.col("id").alias("low"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("moved"),
        )
    )
    for _ in range(rounds):
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("walked").alias("walked2"), F.col("end").alias("end2"), F.col("low").alias("low2"), F.col("off").alias("off2"))
        met = state.join(ahead, "to", "left")
        goes, lower = F.col("to").isNotNull(), F.col("low2") < F.col("low")
        later = met.select(
            "id",
            F.when(goes, F.col("to2")).alias("to"),
            F.when(goes, F.col("walked") + F.col("walked2")).otherwise(F.col("walked")).alias("walked"),
            F.when(goes, F.col("end2")).otherwise(F.col("end")).alias("end"),
            F.when(goes & lower, F.col("low2")).otherwise(F.col("low")).alias("low"),
            F.when(goes & lower, F.col("walked") + F.col("off2")).otherwise(F.col("off")).alias("off"),
            (goes & (lower | F.col("to2").isNull())).alias("moved"),
        )
        later, moved = cut_and_count(later, F.col("moved"))
        drop_table(state)
        state = later
        if not moved:
            cycle = F.col("to").isNotNull()
            return state.select("id", F.when(cycle, F.col("low")).otherwise(F.col("end")).alias("chain"), F.when(cycle, F.col("off")).otherwise(F.col("walked")).alias("pos"), cycle.alias("closed"))
    raise RuntimeError(f"rank_chains: no end after {rounds} rounds")


def joined_lines(lines: DataFrame, keys: list[str], snap: float | None = None, areas: bool = False) -> DataFrame:
    """Lines (``line``, array of points x, y) of one key joined where exactly two ends meet; where more meet, the joined lines
    end. Returns keys, chain, closed, lines (how many), length, line. Ends meet that are equal, or, with ``snap``, that lie in one cell of
    a grid of that size. areas: lines bound areas, so where an even number of ends meet, neighbours by angle are joined, which crosses
    nothing, and a line that is a ring by itself stays one. Lines with fewer than two points are left out."""
    at = (lambda p: (p["x"], p["y"])) if snap is None else (lambda p: (F.floor(p["x"] / snap + 0.5), F.floor(p["y"] / snap + 0.5)))

    def end(n: int, inner: int, side: int) -> Column:
        p, q = F.element_at("line", n), F.element_at("line", inner)
        return F.struct(F.lit(side).alias("side"), at(p)[0].alias("vx"), at(p)[1].alias("vy"), F.atan2(q["y"] - p["y"], q["x"] - p["x"]).alias("angle"))

    own = cut_lineage(lines.filter(F.size("line") >= 2).select(*keys, "line", F.monotonically_increasing_id().alias("_i")))
    first, last = at(F.element_at("line", 1)), at(F.element_at("line", -1))
    ring = (first[0] == last[0]) & (first[1] == last[1])
    ends = own.select(*keys, "_i", F.when(ring & areas, F.col("_i")).alias("_own"), F.inline(F.array(end(1, 2, 0), end(-1, -2, 1))))
    # A dart is a line in one direction: 2i + s leaves the line's end s, 2i + 1 - s arrives there.
    spot = [*keys, "vx", "vy", "_own"]
    marks = F.struct(F.col("_i"), F.col("side"))
    turn = F.row_number().over(Window.partitionBy(*spot).orderBy("angle", "_i", "side"))
    ends = ends.withColumns({"_turn": F.floor((turn - 1) / 2), "_n": F.count(F.lit(1)).over(Window.partitionBy(*spot))})
    meet = ends.filter((F.col("_n") == 2) | (F.lit(areas) & (F.col("_n") % 2 == 0))).groupBy(*spot, "_turn").agg(F.min(marks).alias("a"), F.max(marks).alias("b"))
    leaves, arrives = (lambda e: 2 * e["_i"] + e["side"]), (lambda e: 2 * e["_i"] + 1 - e["side"])
    pairs = meet.select(F.inline(F.array(*[F.struct(leaves(F.col(p)).alias("id"), arrives(F.col(q)).alias("before")) for p, q in (("a", "b"), ("b", "a"))])))
    darts = own.select(F.explode(F.array(2 * F.col("_i"), 2 * F.col("_i") + 1)).alias("id"))
    ranked = rank_chains(darts.join(pairs, "id", "left"))
    # Both directions of a chain come out. Of a cycle the one with the lower name stays; of a path the one whose head is
    # lower than the other's, which is its own tail turned round.
    ends_of = ranked.groupBy("chain").agg(F.max_by("id", "pos").alias("_tail"))
    turned = F.col("_tail").bitwiseXOR(F.lit(1))
    kept = ranked.join(ends_of, "chain").filter(F.when(F.col("closed"), F.col("chain") % 2 == 0).otherwise(F.col("chain") < turned))
    placed = kept.select(F.expr("id div 2").alias("_i"), (F.col("id") % 2 == 1).alias("_back"), "chain", "pos", "closed").join(own, "_i")
    points = F.when(F.col("_back"), F.reverse("line")).otherwise(F.col("line"))
    gathered = placed.groupBy(*keys, "chain", "closed").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(G.length(F.col("line"))).alias("length"), F.sort_array(F.collect_list(F.struct("pos", points.alias("points")))).alias("_parts")
    )
    rest = F.flatten(F.transform("_parts", lambda p, i: F.when(i == 0, p["points"]).otherwise(F.slice(p["points"], 2, F.size(p["points"]) - 1))))
    return gathered.withColumn("line", rest).drop("_parts")


def merged_streets(lines: DataFrame, key: str, snap: float | None = None) -> DataFrame:
    """(key, parts, length, longest, line): per street how many joined lines it has, their length, and the longest of them
    (of equal ones the one whose first point comes first)."""
    merged = joined_lines(lines, [key], snap)
    best = F.max_by("line", F.struct("length", -F.element_at("line", 1)["x"], -F.element_at("line", 1)["y"]))
    return merged.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), F.sum("length").alias("length"), F.max("length").alias("longest"), best.alias("line"))


def _loops(points: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """The loops of a closed walk that meets some corners more than once: each is closed and meets no corner twice."""
    path, place, out = [], {}, []
    for p in points:
        if p in place:
            start = place[p]
            loop = path[start:]
            out.append([*loop, p])
            for q in loop[1:]:
                del place[q]
            del path[start + 1 :]
        else:
            place[p] = len(path)
            path.append(p)
    return out


def simple_loops(ring: Column) -> Column:
    """A closed ring as rings that meet no corner twice; even-odd they bound the same area. Batches go through Arrow, as a walk keeps
    what it has met."""

    @F.pandas_udf("array<struct<xs:array<double>,ys:array<double>>>")
    def parts(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"xs": [p[0] for p in loop], "ys": [p[1] for p in loop]} for loop in _loops(list(zip(a, b, strict=True)))] for a, b in zip(x, y, strict=True)], dtype=object)

    found = parts(F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"]))
    return F.transform(found, lambda r: F.zip_with(r["xs"], r["ys"], lambda a, b: F.struct(a.alias("x"), b.alias("y"))))
