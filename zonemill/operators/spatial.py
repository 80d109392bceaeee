"""Spatial joins by grid keys, and areas as sets of square cells.

A join within a radius deals both sides by the cell of a grid as wide as the radius; one side goes to its cell and the eight
around it. No pairs beyond neighbouring cells are built. For joins that keep one nearest partner, or count, the partners
are aggregated on the fly. Hot cells stay splittable: the joins are plain equi-joins, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .cover import SHIFT, anywhere, covering, first_ends, nearest_lines, ring_cover, spread
from .graph import cut_lineage


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def near_pairs(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "x", ry: str = "y") -> DataFrame:
    """Pairs (columns of left as l, of right as r, distance) at most radius apart."""
    a = left.select(F.struct(*left.columns).alias("l"), _cell(F.col(lx), radius).alias("_cx"), _cell(F.col(ly), radius).alias("_cy"))
    b = right.select(F.struct(*right.columns).alias("r"), _cell(F.col(rx), radius).alias("_x"), _cell(F.col(ry), radius).alias("_y"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = b.select("r", "_x", "_y", F.explode(steps).alias("o")).select("r", (F.col("_x") + F.col("o.i")).alias("_cx"), (F.col("_y") + F.col("o.j")).alias("_cy"))
    d = G.distance(F.col(f"l.{lx}"), F.col(f"l.{ly}"), F.col(f"r.{rx}"), F.col(f"r.{ry}"))
    return a.join(b, ["_cx", "_cy"]).select("l", "r", d.alias("distance")).filter(F.col("distance") <= radius)


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, radius: float) -> DataFrame:
    """(key, right_key, distance) of the nearest right point within radius for every left point, ties to the smaller
    right_key; null where there is none."""
    spots = right.select(F.col(right_key), F.array(F.struct("x", "y")).alias("line"))
    return _within(nearest_lines(left, spots, key, right_key, radius), right_key, radius)


def _within(near: DataFrame, line_key: str, radius: float) -> DataFrame:
    """near with a partner beyond the radius taken away."""
    return near.withColumns({c: F.when(F.col("distance") <= radius, F.col(c)) for c in (line_key, "distance")})


def radius_count(sites: DataFrame, points: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, n): the points within radius of each site, 0 included."""
    n = near_pairs(sites, points, radius).groupBy(F.col(f"l.{key}").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    return sites.select(key).join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def line_cells(line: Column, size: float, reach: float) -> Column:
    """Cells within reach of the boxes of a line's segments: array<struct<cx,cy>>."""
    def box(s: Column) -> Column:
        xs = F.sequence(_cell(F.least(s["x1"], s["x2"]) - reach, size), _cell(F.greatest(s["x1"], s["x2"]) + reach, size))
        ys = F.sequence(_cell(F.least(s["y1"], s["y2"]) - reach, size), _cell(F.greatest(s["y1"], s["y2"]) + reach, size))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))

    return F.array_distinct(F.flatten(F.transform(G.segments(line), box)))


def _near_segments(points: DataFrame, lines: DataFrame, key: str, line_key: str, radius: float, size: float | None = None, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """(key, line_key, distance, carry: further columns of points) of every segment of a line within radius of a point x, y. A segment travels to its own cells
    alone, never the whole line; a pair of a long segment's cells and a point meets once, as the point lies in one cell."""
    size = size or 2 * radius
    a = points.select(key, "x", "y", *carry, _cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy"))
    segs = lines.select(line_key, F.inline(G.segments(F.col("line"))))
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    b = segs.select(line_key, "x1", "y1", "x2", "y2", F.inline(line_cells(ends, size, radius)))
    d = G.to_segment(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    met = spread(a, "cx", "cy").join(spread(b, "cx", "cy"), ["cx", "cy"])
    return met.select(key, line_key, *carry, d.alias("distance")).filter(F.col("distance") <= radius)


def near_lines(points: DataFrame, lines: DataFrame, key: str, line_key: str, radius: float, size: float | None = None) -> DataFrame:
    """(key, line_key, distance): lines (array of points ``line``) within radius of points x, y, each once."""
    return _near_segments(points, lines, key, line_key, radius, size).groupBy(key, line_key).agg(F.min("distance").alias("distance"))


def nearest_line(points: DataFrame, lines: DataFrame, key: str, line_key: str, radius: float) -> DataFrame:
    return _within(nearest_lines(points, lines, key, line_key, 2 * radius), line_key, radius)


def attribute_units(units: DataFrame, streets: DataFrame, key: str = "uid", street_key: str = "street_id", in_area: str = "in_area", far: float = 150.0, fringe: float = 100.0) -> DataFrame:
    """units with outcome: not_serviceable where a tier C street is nearer than any serviceable one and at most ``fringe``
    away; else outside_area; else no_street without a serviceable street within ``far``; else serviceable, with its street."""
    served, thin = streets.filter("tier <> 'C'"), streets.filter("tier = 'C'")
    s = nearest_line(units, served, key, street_key, far).withColumnRenamed("distance", "d_served")
    c = nearest_line(units, thin, key, street_key, fringe).select(key, F.col("distance").alias("d_thin"))
    out = units.join(s, key).join(c, key)
    tier_c = F.col("d_thin").isNotNull() & (F.col("d_served").isNull() | (F.col("d_thin") < F.col("d_served")))
    label = F.when(tier_c, "tier_c").when(~F.col(in_area), "outside_area").when(F.col("d_served").isNull(), "no_street").otherwise("serviceable")
    return out.withColumn("outcome", label)


def unattached(units: DataFrame, served: DataFrame, key: str, street_key: str, threshold: float, size: float) -> DataFrame:
    """(key, street_key, nearest_road_m): units farther than ``threshold`` from every serviceable street, with the nearest one
    wherever it is; both null without any street. size: of the finest cells that units and streets are dealt by."""
    near = nearest_lines(units, served, key, street_key, size).filter(F.col("distance").isNull() | (F.col("distance") > threshold))
    return near.select(key, street_key, F.round("distance", 1).alias("nearest_road_m"))


def corridor_counts(streets: DataFrame, objects: DataFrame, street_key: str, object_key: str, counts: dict[str, Column], radius: float = 60.0) -> DataFrame:
    """Per street (several lines may share a key) how many different objects within radius meet each condition."""
    parts = streets.groupBy(street_key).agg(F.sum(F.greatest(F.size("line") - 1, F.lit(1))).alias("_n"))
    flags = {f"_f{i}": c for i, c in enumerate(counts.values())}
    shown = objects.select(object_key, "x", "y", *[c.cast("boolean").alias(f) for f, c in flags.items()])
    tally = lambda hits: hits.groupBy(street_key).agg(*[F.count_if(f).alias(n) for n, f in zip(counts, flags, strict=True)])
    # A street of one segment meets an object once: nothing but its counts is kept. Objects along several segments are met again.
    of = lambda test: streets.join(parts.filter(test), street_key, "left_semi")
    one = tally(_near_segments(shown, of("_n = 1"), object_key, street_key, radius, carry=list(flags)))
    many = tally(_near_segments(shown, of("_n > 1"), object_key, street_key, radius, carry=list(flags)).drop("distance").distinct())
    sums = one.unionByName(many)
    return streets.select(street_key).distinct().join(sums, street_key, "left").fillna(0, list(counts))


def containing(points: DataFrame, rings: DataFrame, key: str, ring_key: str, size: float, edges: bool = False, settle: Column | str | None = None, by: str | None = None, coarse: bool = False) -> DataFrame:
    """(key, ring_key): areas that cover points x, y; their edges belong to them. rings: closed, array of points ``ring``; the
    insides of several rings of one ring_key count even-odd, so holes and exclaves may be rows of their own. Points meet the cells of a
    quad-tree cover (see cover.py) whose border cells are as small as ``size``. edges: adds on_edge. settle: of the columns of
    points and rings, decides the pairs that lie on an edge or off it by rounding alone, where the area has a formula of its own.
    by: a column of both; points meet only areas with their own value. coarse: rings with few corners are not cut below their width."""
    out = covering(points, rings, key, ring_key, size, by, coarse)
    if settle is not None:
        doubtful = out.filter("on_edge").join(points, key).join(rings.drop(by) if by else rings, ring_key).filter(settle)
        out = out.filter("NOT on_edge").unionByName(doubtful.select(*out.columns))
    return out if edges else out.drop("on_edge")


def containing_rows(points: DataFrame, rings: DataFrame, key: str, ring_key: str, size: float, settle: Column | str | None = None) -> DataFrame:
    """containing() where every row of rings is an area of its own: (key, ring_key) of each row of points and each row of rings that
    covers it, so keys that repeat yield a row each, as in a join on the areas' formula. The pairs are neither shuffled nor gathered."""
    spots = points.select(F.struct(*points.columns).alias("_p"), "x", "y")
    areas = rings.select(F.struct(*[c for c in rings.columns if c != "ring"]).alias("_r"), "ring")
    out = covering(spots, areas, "_p", "_r", size, each=True)
    if settle is None:
        return out.select(f"_p.{key}", f"_r.{ring_key}")
    settle = F.expr(settle) if isinstance(settle, str) else settle
    return out.select("_p.*", "_r.*", "on_edge").filter(~F.col("on_edge") | settle).select(key, ring_key)


def inside(points: DataFrame, rings: DataFrame, key: str, ring_key: str, size: float, how: str = "left_semi", settle: Column | str | None = None) -> DataFrame:
    """points inside any ring (left_semi) or inside none (left_anti)."""
    return points.join(anywhere(points, rings, key, ring_key, size, settle=settle), key, how)


def first_container(points: DataFrame, rings: DataFrame, key: str, ring_key: str, order: str, size: float, settle: Column | str | None = None, each: bool = False) -> DataFrame:
    """points with the ring_key of the covering ring that comes first by ``order``, a number, null outside all; points that share a key
    share the first of any of them. each: every row of rings is an area of its own, as in containing_rows(). The areas are looked
    into in rounds, the first ones first, and points that one holds meet no later ones."""
    if not each:
        rings = rings.drop(order).join(rings.groupBy(ring_key).agg(F.min(order).alias(order)), ring_key)
    rings = cut_lineage(rings.withColumn("_first", F.struct(order, ring_key)))
    ends = first_ends(rings, order)
    best, left, low = None, points, None
    for end in [*ends, None]:
        test = F.lit(True) if end is None else F.coalesce(F.col(order) <= end, F.lit(True))
        some = rings.filter(test if low is None else test & (F.col(order) > low))
        hits = (containing_rows if each else containing)(left, some, key, "_first", size, settle=settle)
        own = cut_lineage(hits.groupBy(key).agg(F.min("_first").alias("_first")))
        best = own if best is None else best.unionByName(own)
        if end is not None:
            left = cut_lineage(left.join(own, key, "left_anti"))
            if left.isEmpty():
                break
        low = end
    return points.join(best.select(key, F.col(f"_first.{ring_key}").alias(ring_key)), key, "left")


def nearest_site(points: DataFrame, sites: DataFrame, key: str, site_key: str, limit: int = 10_000) -> DataFrame:
    """(key, site_key): the nearest of a stated set of sites, ties to the smaller key: the point's Voronoi cell. The sites
    are a configured set; more than ``limit`` are an error, and nearest() within a radius is the way for those."""
    listed = sites.select("x", "y", site_key).limit(limit + 1).collect()
    if len(listed) > limit:
        raise ValueError(f"more than {limit} sites")
    kind = sites.schema[site_key].dataType.simpleString()
    rows = [([(float(r["x"]), float(r["y"]), r[site_key]) for r in listed],)]
    table = sites.sparkSession.createDataFrame(rows, f"_sites array<struct<x:double,y:double,k:{kind}>>")
    best = F.array_min(F.transform("_sites", lambda s: F.struct(G.distance(F.col("x"), F.col("y"), s["x"], s["y"]).alias("d"), s["k"].alias("k"))))
    return points.crossJoin(F.broadcast(table)).select(key, best["k"].alias(site_key))  # one row of at most ``limit`` sites


def verify_zones(units: DataFrame, zones: DataFrame, key: str, size: float, settle: Column | str | None = None) -> DataFrame:
    """One row: units inside a shape of their own zone, only inside another's, inside none. zones(shape, zone, ring). Units that share a
    key are one, with one band; one without a band that lies inside a shape is in none of the three counts."""
    kind = units.schema["band"].dataType
    own = anywhere(units.withColumn("_zone", F.col("band")), zones.withColumn("_zone", F.col("zone").cast(kind)), key, "shape", size, by="_zone", settle=settle)
    rest = cut_lineage(units.join(own, key, "left_anti"))
    other = anywhere(rest, zones, key, "shape", size, settle=settle)
    one = lambda df, how: df.withColumn("_how", F.lit(how))
    out = units.select(key, "band").distinct().join(one(own, "own").unionByName(one(other, "other")), key, "left")
    return out.agg(F.count_if(F.col("_how") == "own").alias("own"), F.count_if((F.col("_how") == "other") & F.col("band").isNotNull()).alias("other"), F.count_if(F.col("_how").isNull()).alias("none"))


# Areas as sets of square cells (cx, cy) of one size. An area's border is off by a cell at most.


def disc_cells(points: DataFrame, radius: float, size: float) -> DataFrame:
    """Cells whose centre lies within radius of a point."""
    steps = int(radius / size) + 1
    offsets = F.sequence(F.lit(-steps), F.lit(steps))
    a = points.select("x", "y", F.explode(offsets).alias("_i")).select("x", "y", "_i", F.explode(offsets).alias("_j"))
    a = a.select("x", "y", (_cell(F.col("x"), size) + F.col("_i")).alias("cx"), (_cell(F.col("y"), size) + F.col("_j")).alias("cy"))
    return a.filter(G.distance((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.col("x"), F.col("y")) <= radius).select("cx", "cy").distinct()


def _shifted(cells: DataFrame, radius: float, size: float) -> DataFrame:
    n = int(radius / size)
    around = [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if (i * i + j * j) * size * size <= radius * radius]
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])
    return cells.select("cx", "cy", F.explode(table).alias("o")).select((F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))


def dilate(cells: DataFrame, radius: float, size: float) -> DataFrame:
    return _shifted(cells, radius, size).distinct()


def erode(cells: DataFrame, radius: float, size: float) -> DataFrame:
    """Cells all of whose neighbours within radius belong to the area."""
    n = int(radius / size)
    need = sum((i * i + j * j) * size * size <= radius * radius for i in range(-n, n + 1) for j in range(-n, n + 1))
    return _shifted(cells.distinct(), radius, size).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == need).select("cx", "cy")


def close_gaps(cells: DataFrame, radius: float, size: float) -> DataFrame:
    return erode(dilate(cells, radius, size), radius, size)


def footprint(points: DataFrame, buffer: float, closing: float, size: float) -> DataFrame:
    """Discs around points, united, gaps up to twice the closing radius filled."""
    return close_gaps(disc_cells(points, buffer, size), closing, size)


def line_area_cells(lines: DataFrame, key: str, radius: float, size: float) -> DataFrame:
    """(key, cx, cy): cells whose centre lies within radius of a line (array of points ``line``)."""
    segs = lines.select(key, F.inline(G.segments(F.col("line"))))
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    near = segs.select(key, "x1", "y1", "x2", "y2", F.inline(line_cells(ends, size, radius)))
    away = G.to_segment((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return near.filter(away <= radius).select(key, "cx", "cy").distinct()


#: Border cells of residential land are this many cells of the area wide.
FIELD = 5


def composed_footprint(homes: DataFrame, streets: DataFrame, fields: DataFrame, street_key: str, ring_key: str, size: float, buffer: float, street_buffer: float, closing: float, vicinity: float, reach: float = 40.0) -> DataFrame:
    """Cells of a lived-in area: discs around homes; buffers of streets that come within reach of these; residential land (rings).
    Streets and land count in the vicinity of the homes only, as whole ones would draw in fields and long empty corridors.
    Gaps up to twice the closing radius are filled."""
    built = cut_lineage(disc_cells(homes, buffer, size))
    around = cut_lineage(dilate(built, vicinity, size))
    centres = built.select(F.struct("cx", "cy").alias("_at"), ((F.col("cx") + 0.5) * size).alias("x"), ((F.col("cy") + 0.5) * size).alias("y"))
    near = streets.join(_near_segments(centres, streets, "_at", street_key, reach).select(street_key).distinct(), street_key, "left_semi")
    # Only cells of the vicinity are looked for in the land, not all cells of all land.
    spots = around.select(F.struct("cx", "cy").alias("_at"), ((F.col("cx") + 0.5) * size).alias("x"), ((F.col("cy") + 0.5) * size).alias("y"))
    land = anywhere(spots, fields, "_at", ring_key, FIELD * size).select("_at.cx", "_at.cy")
    roads = overlay(line_area_cells(near, street_key, street_buffer, size).select("cx", "cy"), around, "intersection")
    return close_gaps(built.unionByName(roads).unionByName(land).distinct(), closing, size)


def part_records(parts: DataFrame, points: DataFrame, size: float, least: int, least_area: float) -> DataFrame:
    """(part, points, area, kept): each part of an area with the points in it; kept are those with enough of both."""
    at = points.select(_cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy")).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("_n"))
    per = parts.join(at, ["cx", "cy"], "left").groupBy("part").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("points"), (F.count(F.lit(1)) * float(size * size)).alias("area"))
    return per.withColumn("kept", (F.col("points") >= least) & (F.col("area") >= least_area))


def ring_area_cells(rings: DataFrame, ring_key: str, size: float) -> DataFrame:
    """(cx, cy): cells whose centre an area covers. Inner cells of the cover hold their centres without a test; those of
    border cells are tested."""
    cover = ring_cover(rings, ring_key, size)
    wide, off = F.pow(F.lit(2.0), F.col("level")), SHIFT
    # Centres of cells of the plain grid that lie in a cell of the shifted one.
    span = lambda c: F.sequence(F.ceil(F.col(c) * wide + off - 0.5).cast("long"), F.ceil((F.col(c) + 1) * wide + off - 0.5).cast("long") - 1)
    centres = cover.select(F.explode(span("cx")).alias("cx"), span("cy").alias("_ys")).select("cx", F.explode("_ys").alias("cy")).distinct()
    at = centres.select(F.struct("cx", "cy").alias("_at"), ((F.col("cx") + 0.5) * size).alias("x"), ((F.col("cy") + 0.5) * size).alias("y"))
    return containing(at, rings, "_at", ring_key, size).select("_at.cx", "_at.cy").distinct()


def overlay(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """intersection, difference or union of two areas."""
    if how == "union":
        return a.unionByName(b).distinct()
    return a.distinct().join(b, ["cx", "cy"], {"intersection": "left_semi", "difference": "left_anti"}[how])


def area_of(cells: DataFrame, size: float) -> DataFrame:
    return cells.distinct().agg((F.count(F.lit(1)) * float(size * size)).alias("area"))


def _middle(size: float) -> tuple[Column, Column]:
    return (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size


def side_of_polyline(x: Column, y: Column, line: list[tuple[float, float]]) -> Column:
    """1 left of a directed polyline whose end segments go on without end, -1 right of it, 0 on it: by the nearest segment, at a
    corner by the one that the point lies more squarely beside."""
    best = None
    for n, ((x1, y1), (x2, y2)) in enumerate(zip(line, line[1:], strict=False)):
        dx, dy = x2 - x1, y2 - y1
        square = dx * dx + dy * dy
        t = ((x - x1) * dx + (y - y1) * dy) / square
        t = t if len(line) == 2 else F.least(t, F.lit(1.0)) if n == 0 else F.greatest(t, F.lit(0.0)) if n == len(line) - 2 else F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        cross = dx * (y - y1) - dy * (x - x1)
        away = G.distance(x, y, x1 + t * dx, y1 + t * dy)
        own = F.struct(F.round(away, 9).alias("away"), (-F.abs(cross) / square**0.5).alias("beside"), F.signum(cross).cast("int").alias("side"))
        best = own if best is None else F.least(best, own)
    return best["side"]


def clip_to_side(cells: DataFrame, line: list[tuple[float, float]], keep: tuple[float, float], size: float) -> DataFrame:
    """cells with column applied. Kept are those on the side of a polyline on which the point ``keep`` lies, as seen from the straight line
    between its ends; the polyline is extended without end. Where that divides nothing, with all cells on one side or the
    point on that line, all cells stay and applied is false: a limit that could not be drawn is a question to its owner."""
    steps = [p for n, p in enumerate(line) if n == 0 or p != line[n - 1]]
    (ax, ay), (bx, by) = (steps or [(0.0, 0.0)])[0], (steps or [(0.0, 0.0)])[-1]
    cross = (bx - ax) * (keep[1] - ay) - (by - ay) * (keep[0] - ax)
    if cross == 0 or len(steps) < 2:
        return cells.withColumn("applied", F.lit(False))
    sided = cells.withColumn("_mine", side_of_polyline(*_middle(size), steps) == (1 if cross > 0 else -1))
    both = sided.agg(F.coalesce(F.max("_mine") & ~F.min("_mine"), F.lit(False)).alias("applied"))  # one row
    return sided.crossJoin(F.broadcast(both)).filter(F.col("_mine") | ~F.col("applied")).drop("_mine")


def clip_direction(cells: DataFrame, x: float, y: float, direction: str, size: float) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): what lies beyond a point to the north, south, east or west is removed."""
    cx, cy = _middle(size)
    beyond = {"north": cy >= y, "south": cy <= y, "east": cx >= x, "west": cx <= x}[direction]
    return cells.filter(~beyond), cells.filter(beyond)


def draw_bands(area: DataFrame, units: DataFrame, size: float, reach: float = 120.0) -> DataFrame:
    """(cx, cy, band): each cell of an area takes the band of the nearest unit within reach (ties to the smaller uid)."""
    centres = area.select("cx", "cy", ((F.col("cx") + 0.5) * size).alias("x"), ((F.col("cy") + 0.5) * size).alias("y"))
    pairs = near_pairs(centres, units.select("uid", "x", "y", "band"), reach)
    best = pairs.groupBy(F.col("l.cx").alias("cx"), F.col("l.cy").alias("cy")).agg(F.min_by("r.band", F.struct("distance", F.col("r.uid"))).alias("band"))
    return best


def cell_components(cells: DataFrame) -> DataFrame:
    """(cx, cy, part): four-neighbour parts of an area, named by their least cell."""
    from .graph import connected

    ids = cells.distinct().select("cx", "cy", _cell_id(F.col("cx"), F.col("cy")).alias("id"))
    right = ids.select((F.col("cx") - 1).alias("cx"), "cy", F.col("id").alias("b"))
    up = ids.select("cx", (F.col("cy") - 1).alias("cy"), F.col("id").alias("b"))
    edges = ids.join(right, ["cx", "cy"]).select(F.col("id").alias("a"), "b").unionByName(ids.join(up, ["cx", "cy"]).select(F.col("id").alias("a"), "b"))
    found = connected(edges)
    return ids.join(found, ids["id"] == found["node"], "left").select("cx", "cy", F.coalesce("root", "id").alias("part"))


def _cell_id(cx: Column, cy: Column) -> Column:
    return F.shiftleft(cx + 2**30, 31).bitwiseOR(cy + 2**30)


def drop_small(parts: DataFrame, points: DataFrame, size: float, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """(kept, review): parts with at least ``least`` points, and the others with their counts."""
    at = points.select(_cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy")).join(parts, ["cx", "cy"])
    n = parts.select("part").distinct().join(at.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", "left").fillna(0, ["n"])
    return parts.join(n.filter(F.col("n") >= least), "part", "left_semi"), n.filter(F.col("n") < least)


def coverage_gaps(area: DataFrame, drawn: DataFrame, size: float, least_m2: float = 2000.0) -> DataFrame:
    """(part, area): parts of an area that no band covers, of at least least_m2."""
    parts = cell_components(overlay(area, drawn.select("cx", "cy"), "difference"))
    return parts.groupBy("part").agg((F.count(F.lit(1)) * float(size * size)).alias("area")).filter(F.col("area") >= least_m2)
