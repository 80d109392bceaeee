"""Quad-tree cover of areas, and nearest lines without a radius by descending two trees of cells at once.

Cover. A ring's box is cut into cells that halve from level to level. A cell that no part of the ring meets is inner or
outer as a whole: inner ones are kept as they are, outer ones dropped. A cell that the ring meets is cut on until it holds
few segments and is small beside the ring, or is as small as asked. The number of cells follows the length of the ring, not its area. Points meet the cells
by level and place: in an inner cell they are inside without a test, in a border cell only its own segments are looked at.

Nearest. Points and pieces of lines lie in the cells of two trees. Starting from cells as wide as all data, pairs of cells
are refined together; a pair goes on only if its least possible distance does not exceed the point cell's smallest largest
one, so every point cell keeps a bounded number of line cells near its nearest, wherever that lies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .graph import cut_lineage

#: A cell with so many segments or fewer is cut no further, once it is a quarter of the ring's box or less.
FEW = 8
#: So many points of a cell, about, go to one task.
SHARE = 2048
#: So many segments of a border cell are tested as plain columns.
SHOWN = 3
#: The grid's origin in parts of the finest cell: corners of cells then hardly ever lie on a ring, which parity needs.
SHIFT = 0.3183098861837907


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns, or evenly, to as many tasks as shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def ring_cells(x: np.ndarray, y: np.ndarray, size: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """Cover of one closed ring, level by level: (level, cx, cy, inner, odd, segments of each cell). A cell of a level is
    size * 2**level wide; odd tells whether its lower left corner is inside."""
    seg = np.stack((x[:-1], y[:-1], x[1:], y[1:]), axis=1)
    off = SHIFT * size
    level, span = 0, max(np.ptp(x), np.ptp(y))
    while max(np.ptp(np.floor((v - off) / (size * 2.0**level))) for v in (x, y)) > 1:
        level += 1
    wide = size * 2.0**level
    lo = [int(np.floor((v.min() - off) / wide)) for v in (x, y)]
    cells = np.array([(lo[0] + i, lo[1] + j) for i in (0, 1) for j in (0, 1)], np.int64)
    corner = cells * wide + off
    odd = np.array([_east(seg, -np.inf, a, b).sum() % 2 != _east(seg, -np.inf, np.inf, b).sum() % 2 for a, b in corner])
    owner, which = np.repeat(np.arange(4), len(seg)), np.tile(np.arange(len(seg)), 4)
    while len(cells):
        corner = cells * wide + off
        hit = _meets(seg[which], corner[owner], wide)
        owner, which = owner[hit], which[hit]
        n = np.bincount(owner, minlength=len(cells))
        order = np.argsort(owner, kind="stable")
        owner, which = owner[order], which[order]
        starts = np.concatenate(([0], np.cumsum(n)))
        done = ((n <= FEW) & (wide <= span / 4)) | (level == 0)
        out = np.flatnonzero(done & ((n > 0) | odd))
        if len(out):
            yield level, cells[out, 0], cells[out, 1], n[out] == 0, odd[out], [seg[which[starts[c] : starts[c + 1]]] for c in out]
        # The others are cut in four. From corner to corner the parity changes with every segment between them.
        cut = np.flatnonzero(~done)
        if not len(cut):
            return
        half, place = wide / 2, np.full(len(cells), -1)
        place[cut] = np.arange(len(cut))
        mine = place[owner] >= 0
        owner, which = place[owner[mine]], which[mine]
        left, low = corner[cut][owner].T
        s = seg[which]
        right_low = np.bincount(owner, _east(s, left, left + half, low), len(cut)) % 2 == 1
        left_up = np.bincount(owner, _north(s, low, low + half, left), len(cut)) % 2 == 1
        right_up = np.bincount(owner, _north(s, low, low + half, left + half), len(cut)) % 2 == 1
        base = odd[cut]
        cells = np.concatenate([2 * cells[cut] + np.array([i, j]) for i, j in ((0, 0), (1, 0), (0, 1), (1, 1))])
        odd = np.concatenate((base, base ^ right_low, base ^ left_up, base ^ right_low ^ right_up))
        owner, which = np.concatenate([owner + k * len(cut) for k in range(4)]), np.tile(which, 4)
        wide, level = half, level - 1


def _east(s: np.ndarray, a, b, y) -> np.ndarray:
    """Which segments cross height y between a (not included) and b."""
    x1, y1, x2, y2 = s.T
    over = (y1 > y) != (y2 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return over & (at > a) & (at <= b)


def _north(s: np.ndarray, a, b, x) -> np.ndarray:
    return _east(s[:, [1, 0, 3, 2]], a, b, x)


def _meets(s: np.ndarray, corner: np.ndarray, wide: float) -> np.ndarray:
    """Whether segments meet closed cells; a little wider, so that rounding never loses one."""
    x1, y1, x2, y2 = s.T
    half = wide / 2 * (1 + 1e-9)
    cx, cy = corner.T + wide / 2
    dx, dy = x2 - x1, y2 - y1
    near = (np.minimum(x1, x2) <= cx + half) & (np.maximum(x1, x2) >= cx - half) & (np.minimum(y1, y2) <= cy + half) & (np.maximum(y1, y2) >= cy - half)
    return near & (np.abs(dx * (cy - y1) - dy * (cx - x1)) <= half * (np.abs(dx) + np.abs(dy)) * (1 + 1e-9))


def ring_cover(rings: DataFrame, ring_key: str, size: float, coarse: bool = False) -> DataFrame:
    """(ring_key, level, cx, cy, inner, odd, segs) of closed rings (array of points ``ring``); rings of fewer than four points, or
    with a corner that has no finite place, have no cells. coarse: rings with few corners are not cut into cells narrower than they are."""
    shown = rings.filter(F.size("ring") >= 4).select(ring_key, F.transform("ring", lambda p: p["x"].cast("double")).alias("xs"), F.transform("ring", lambda p: p["y"].cast("double")).alias("ys"))
    shown = shown.filter(F.forall("xs", _finite) & F.forall("ys", _finite))
    level = F.lit(0)
    if coarse:
        span = F.greatest(*[F.array_max(f"{c}s") - F.array_min(f"{c}s") for c in ("x", "y")])
        level = F.when((span > size) & (F.size("xs") <= FEW + 1), F.ceil(F.log2(span / size)).cast("int")).otherwise(level)
    shown = shown.withColumn("level", level)
    bounds = {f"{c}{n}": _place(f(f"{c}s"), F.col("level"), size) for c in ("x", "y") for n, f in ((0, F.array_min), (1, F.array_max))}
    shown = shown.withColumns(bounds)
    small = F.coalesce((F.size("xs") <= FEW + 1) & (F.col("x1") - F.col("x0") <= 1) & (F.col("y1") - F.col("y0") <= 1), F.lit(False))
    few, shown = _small_cover(shown.filter(small), ring_key, size), shown.filter(~small).select(ring_key, "xs", "ys")
    kind = rings.schema[ring_key].dataType

    def packed(held: list, keys: pa.Array) -> pa.RecordBatch:
        rows, parts = [i for i, _ in held], [p for _, p in held]
        segs = [s for p in parts for s in p[5]]
        values = pa.StructArray.from_arrays([pa.array(v) for v in np.concatenate(segs).reshape(-1, 4).T.copy()], ["x1", "y1", "x2", "y2"])
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in segs]))).astype(np.int32)
        n = [len(p[1]) for p in parts]
        level = np.repeat(np.array([p[0] for p in parts], np.int32), n)
        cols = [keys.take(pa.array(np.repeat(rows, n))), pa.array(level), *(pa.array(np.concatenate([p[i] for p in parts])) for i in (1, 2, 3, 4))]
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(offsets), values)], ["ring_key", "level", "cx", "cy", "inner", "odd", "segs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, xs, ys = batch.columns
            held, size_held = [], 0
            for i in range(batch.num_rows):
                x, y = (np.asarray(c[i].values.to_numpy(zero_copy_only=False), float) for c in (xs, ys))
                for part in ring_cells(x, y, size):
                    held.append((i, part))
                    size_held += len(part[1])
                if size_held >= 20_000:
                    yield packed(held, keys)
                    held, size_held = [], 0
            if held:
                yield packed(held, keys)

    schema = f"ring_key {kind.simpleString()}, level int, cx long, cy long, inner boolean, odd boolean, segs array<struct<x1:double,y1:double,x2:double,y2:double>>"
    return shown.mapInArrow(run, schema).withColumnRenamed("ring_key", ring_key).unionByName(few)


def _small_cover(shown: DataFrame, ring_key: str, size: float) -> DataFrame:
    """ring_cover() of rings with few corners that lie in two cells of their level each way at most: each cell of the box with
    all segments, as looking for those that it meets would cost more than testing them."""
    n = F.size("xs") - 1
    spot = lambda i, k: F.get(F.col(f"{i}s"), k)
    segs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.named_struct(F.lit("x1"), spot("x", k), F.lit("y1"), spot("y", k), F.lit("x2"), spot("x", k + 1), F.lit("y2"), spot("y", k + 1)))
    at = shown.select(ring_key, "level", segs.alias("segs"), F.explode(F.sequence("x0", "x1")).alias("cx"), "y0", "y1").select(ring_key, "level", "segs", "cx", F.explode(F.sequence("y0", "y1")).alias("cy"))
    wide = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level"))
    left, low = F.col("cx") * wide + SHIFT * size, F.col("cy") * wide + SHIFT * size

    def west(s: Column) -> Column:
        """Whether a segment crosses the cell's lower side's height west of its corner."""
        cross = (s["x2"] - s["x1"]) * (low - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]
        return F.when((s["y1"] > low) != (s["y2"] > low), (cross <= left).cast("int")).otherwise(0)

    odd = F.aggregate("segs", F.lit(0), lambda a, s: a + west(s)) % 2 == 1
    return at.select(ring_key, "level", "cx", "cy", F.lit(False).alias("inner"), odd.alias("odd"), "segs")


def _finite(v: Column) -> Column:
    return F.abs(v) < float("inf")  # Spark holds NaN to be the largest


def _place(v: Column, level: Column, size: float) -> Column:
    wide = F.lit(float(size)) * F.pow(F.lit(2.0), level)
    return F.floor((v - SHIFT * size) / wide).cast("long")


def covering(points: DataFrame, rings: DataFrame, key: str, ring_key: str, size: float, by: str | None = None, coarse: bool = False, each: bool = False) -> DataFrame:
    """(key, ring_key, on_edge): the areas that cover points x, y. A ring_key may have many rings: their insides count even-odd, and
    their edges belong to the area, and so does what lies off them by rounding alone. Points without finite places are in none.
    size: how small a border cell gets at most. by: a column of both sides, one value for each ring_key; points meet only areas
    with their own value, which no null equals. coarse: as of ring_cover(), where few areas share a value. each: every row of rings is an area of its own,
    so a point meets it in one cell at most, and pairs come as they are met, without being gathered by their keys."""
    cover = ring_cover(spread(rings.select(ring_key, "ring")), ring_key, size, coarse)
    own_by = [] if by is None else [by]
    if by is not None:
        cover = cover.join(rings.select(ring_key, by).distinct(), ring_key)
    cover = cut_lineage(cover)
    levels = [r[0] for r in cover.select("level").distinct().collect()]  # at most as many as a number has bits
    if not levels:
        return points.select(key).crossJoin(rings.select(ring_key).limit(0)).withColumn("on_edge", F.lit(False))
    level = F.explode(F.array(*[F.lit(n) for n in sorted(levels)]))
    at = points.filter(_finite(F.col("x")) & _finite(F.col("y"))).select(key, "x", "y", *own_by, level.alias("level"))
    at = at.withColumns({"cx": _place(F.col("x"), F.col("level"), size), "cy": _place(F.col("y"), F.col("level"), size)})
    # Dealt by a stated number of parts: by their bytes alone a few tasks would get all cells, as small tables make many pairs.
    # The points of a full cell are split, each share with a copy of the cell; cells without points go.
    cell = ["level", "cx", "cy", *own_by]
    at = cut_lineage(at)
    shares = at.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("long").alias("_n"))
    some = spread(at.join(shares, cell).withColumn("_s", F.pmod(F.xxhash64(key), F.col("_n"))).drop("_n"), *cell, "_s")
    own = spread(cover.join(shares, cell).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n"), *cell, "_s")
    met = some.join(own, [*cell, "_s"])
    wide = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level"))
    left, low, x, y = F.col("cx") * wide + SHIFT * size, F.col("cy") * wide + SHIFT * size, F.col("x"), F.col("y")

    def between(a1: Column, b1: Column, a2: Column, b2: Column, line: Column, lo: Column, hi: Column) -> Column:
        cross = (a2 - a1) * (line - b1) / (b2 - b1) + a1
        return ((b1 > line) != (b2 > line)) & (cross > lo) & (cross <= hi)

    def changes(s: Column) -> Column:
        """Crossings on the way from the cell's corner east, then north, to the point."""
        east = between(s["x1"], s["y1"], s["x2"], s["y2"], low, left, x)
        north = between(s["y1"], s["x1"], s["y2"], s["x2"], x, low, y)
        return F.coalesce(east, F.lit(False)).cast("int") + F.coalesce(north, F.lit(False)).cast("int")

    def touches(s: Column) -> Column:
        """On a segment, or as near as rounding may put a point of it."""
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        off = 1e-12 * (F.abs(x) + F.abs(y) + F.abs(dx) + F.abs(dy))
        within = x.between(F.least(s["x1"], s["x2"]) - off, F.greatest(s["x1"], s["x2"]) + off) & y.between(F.least(s["y1"], s["y2"]) - off, F.greatest(s["y1"], s["y2"]) + off)
        return within & (F.abs(dx * (y - s["y1"]) - dy * (x - s["x1"])) <= off * (F.abs(dx) + F.abs(dy)))

    # A border cell's first segments, mostly all it has, are plain columns, which are compiled; only the rest is looped over.
    first, more = [F.get("segs", n) for n in range(SHOWN)], F.size("segs") > SHOWN
    rest = F.slice("segs", SHOWN + 1, F.greatest(F.size("segs") - SHOWN, F.lit(0)))
    crossed = sum((changes(s) for s in first), F.lit(0)) + F.when(more, F.aggregate(rest, F.lit(0), lambda a, s: a + changes(s))).otherwise(0)
    odd = F.when(F.col("inner"), 1).otherwise((F.col("odd").cast("int") + crossed) % 2)
    edge = F.lit(False)
    for s in first:
        edge = edge | F.coalesce(touches(s), F.lit(False))
    edge = ~F.col("inner") & (edge | (more & F.exists(rest, touches)))
    # Rows that change neither the parity nor the edge are left out before the pairs are shuffled.
    per = met.select(key, ring_key, odd.alias("_odd"), edge.alias("_edge")).filter("_odd = 1 OR _edge")
    if each:
        return per.select(key, ring_key, F.col("_edge").alias("on_edge"))
    per = per.groupBy(key, ring_key).agg(F.sum("_odd").alias("_n"), F.max("_edge").alias("on_edge"))
    return per.filter((F.col("_n") % 2 == 1) | F.col("on_edge")).select(key, ring_key, "on_edge")


#: Areas that any_area() looks into first, and how many times as many in every later round.
FIRST, GROWS = 1024, 8


def any_area(left: DataFrame, areas: DataFrame, key: str, area_key: str, look: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(key): the rows of left that look(rows of left, some areas), a table of keys, finds, each once. All areas are looked into, but in
    rounds of ever more of them, and what was found in one goes no further: where many areas lie over each other, rows meet a few of
    them instead of all. Areas of one area_key come in one round."""
    n = areas.agg(F.count_distinct(area_key)).first()[0]
    parts, most = [], FIRST
    while most < n:
        parts.append(most / n)
        most *= GROWS
    parts.append(1.0)
    at = F.pmod(F.xxhash64(area_key, F.lit(7)), F.lit(2**30)) / float(2**30)
    found, low = None, 0.0
    for part in parts:
        some = areas.filter((at >= low) & (at < part)) if len(parts) > 1 else areas
        own = cut_lineage(look(left, some).select(key).distinct())
        found = own if found is None else found.unionByName(own)
        if part < 1:
            left = cut_lineage(left.join(own, key, "left_anti"))
            if left.isEmpty():
                break
        low = part
    return found


def first_ends(areas: DataFrame, order: str) -> list:
    """Values of ``order``, a number, up to which about FIRST areas lie, then GROWS times as many in every later round."""
    n, shares, most = areas.count(), [], FIRST
    while most < n:
        shares.append(most / n)
        most *= GROWS
    return sorted(set(areas.agg(F.percentile_approx(order, shares, 100_000)).first()[0] or [])) if shares else []


def anywhere(points: DataFrame, rings: DataFrame, key: str, ring_key: str, size: float, by: str | None = None, settle: Column | str | None = None) -> DataFrame:
    """(key): the points that any area covers, each once, found as by any_area(). Of points that share a key any will do."""
    from .spatial import containing

    carried = [] if by is None else [by]
    left = points.select(*(points.columns if settle is not None else [key, "x", "y", *carried]))
    # Rows that share a key are told apart by their places, as pairs of a key would cancel each other by parity.
    left = cut_lineage(left.withColumn("_place", F.struct(key, "x", "y", *carried)).dropDuplicates(["_place"]))
    found = any_area(left, rings, "_place", ring_key, lambda left, some: containing(left, some, "_place", ring_key, size, settle=settle, by=by))
    return found.select(f"_place.{key}").distinct()


# --- nearest lines ----------------------------------------------------------------------------------------------------


def _fine(segs: DataFrame, size: float, few: float = 4.0) -> float:
    """A cell size, halved from ``size`` until few pieces of segments lie in one: where n segments of a total length L lie in an
    area A, there are (L * size + n * size**2) / A of them."""
    mid = F.struct(F.floor((F.col("x1") + F.col("x2")) / (2 * size)), F.floor((F.col("y1") + F.col("y2")) / (2 * size)))
    row = segs.agg(F.count(F.lit(1)).alias("n"), F.sum(G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("total"), F.approx_count_distinct(mid).alias("cells")).first()
    area = (row["cells"] or 1) * size * size
    for _ in range(30):
        if ((row["total"] or 0.0) * size + row["n"] * size * size) / area <= few:
            break
        size /= 2
    return size


def nearest_lines(points: DataFrame, lines: DataFrame, key: str, line_key: str, size: float) -> DataFrame:
    """(key, line_key, distance): for every point x, y the nearest of the lines (array of points ``line``) however far, ties to the
    smaller line_key; null where there are no lines. size: of the finest cells; it is halved until few pieces of lines lie in one, so that the
    pairs that are compared grow as the points do."""
    # Only the pieces are written; segments are told from the lines twice, which takes less than to keep them.
    cut = lambda df: df.select(line_key, F.inline(G.segments(F.col("line"))))
    size = _fine(cut(lines), size)
    segs = cut(spread(lines.select(line_key, "line")))
    # Long segments are cut in pieces no longer than a cell; each piece lies in the cell of its middle and knows its segment.
    n = F.greatest(F.ceil(G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) / size), F.lit(1))
    pieces = segs.select("*", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("i"))
    t = (F.col("i") + 0.5) / F.col("n")
    cell = lambda v: F.floor(v / size).cast("long")
    pieces = pieces.select(line_key, "x1", "y1", "x2", "y2", cell(F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("ox"), cell(F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("oy"))
    pieces = cut_lineage(pieces)
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    placed = cut_lineage(points.filter(finite).select(key, "x", "y", cell(F.col("x")).alias("px"), cell(F.col("y")).alias("py")))
    here, there = cut_lineage(placed.select("px", "py").distinct()), cut_lineage(pieces.select("ox", "oy").distinct())
    span = here.agg(*[f(c).alias(f"{f.__name__}{c}") for c in ("px", "py") for f in (F.min, F.max)]).crossJoin(there.agg(*[f(c).alias(f"{f.__name__}{c}") for c in ("ox", "oy") for f in (F.min, F.max)])).first()  # one row each
    if span["minpx"] is None or span["minox"] is None:
        return points.select(key).crossJoin(lines.select(line_key).limit(0)).withColumn("distance", F.lit(0.0)).unionByName(points.select(key, F.lit(None).cast(lines.schema[line_key].dataType).alias(line_key), F.lit(None).cast("double").alias("distance")))
    widest = max(max(span["maxpx"], span["maxox"]) - min(span["minpx"], span["minox"]), max(span["maxpy"], span["maxoy"]) - min(span["minpy"], span["minoy"])) + 1
    levels = max(1, math.ceil(math.log(widest, 4)))
    up = lambda df, a, b, k: df.select(F.shiftright(a, 2 * k).alias(a), F.shiftright(b, 2 * k).alias(b)).distinct()
    pairs = up(here, "px", "py", levels).crossJoin(F.broadcast(up(there, "ox", "oy", levels)))  # two cells a side at most
    for level in range(levels - 1, -1, -1):
        down = lambda df, a, b, k=level: up(df, a, b, k).select(F.shiftright(a, 2).alias(f"{a}_"), F.shiftright(b, 2).alias(f"{b}_"), a, b)
        met = pairs.toDF("px_", "py_", "ox_", "oy_").join(down(here, "px", "py"), ["px_", "py_"]).join(down(there, "ox", "oy"), ["ox_", "oy_"])
        dx, dy, wide = F.abs(F.col("px") - F.col("ox")), F.abs(F.col("py") - F.col("oy")), float(size * 4**level)
        least = F.hypot(F.greatest(dx - 1, F.lit(0)) * wide, F.greatest(dy - 1, F.lit(0)) * wide) - size * 0.5000001
        most = F.hypot((dx + 1) * wide, (dy + 1) * wide) + size * 0.5000001
        best = F.min(most).over(Window.partitionBy("px", "py"))
        pairs = cut_lineage(met.select("px", "py", "ox", "oy", least.alias("least"), best.alias("most")).filter("least <= most").select("px", "py", "ox", "oy"))
    near = spread(placed.join(pairs, ["px", "py"]), "ox", "oy").join(spread(pieces, "ox", "oy"), ["ox", "oy"])
    d = G.to_segment(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    near = near.select(key, line_key, d.alias("distance"))
    # The least distance first, held in place by key; then the smallest line among those at it. A least struct would be sorted for.
    found = cut_lineage(near.groupBy(key, line_key).agg(F.min("distance").alias("distance")))
    low = found.groupBy(key).agg(F.min("distance").alias("distance"))
    best = found.join(low, [key, "distance"]).groupBy(key).agg(F.min(line_key).alias(line_key), F.min("distance").alias("distance"))
    return points.select(key).join(best, key, "left")
