"""Components, clusters, shortest paths: loops on the driver over kept tables."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back, so a loop's plan stays short and outlives an executor."""
    path = f"{_folder(df.sparkSession)}/loop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_count(df: DataFrame, test: Column) -> tuple[DataFrame, int]:
    """cut_lineage(), and for how many rows a test holds, counted while they are written."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, F.count_if(test).alias("n")))
    return out, seen.get["n"]


def drop_table(df: DataFrame) -> None:
    """Deletes a table that cut_lineage() wrote and that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges(a, b) of longs. (node, root): the smallest node that each node on an edge reaches. Every round takes the least
    label among the neighbours and then the label of that label, which halves long chains."""
    both = edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("low"))
        low = cut_lineage(least)
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("far"))
        later, changed = cut_and_count(low.join(jump, "low", "left").select("node", F.col("root").alias("was"), F.least("low", "far").alias("root")), F.col("root") != F.col("was"))
        for old in (labels, low):
            drop_table(old)
        labels = later.select("node", "root")
        if not changed:
            drop_table(both)
            return labels
    raise RuntimeError(f"connected: no end after {rounds} rounds")


#: Pairs of cells with more pairs of points than this are refined instead of being compared; sub-cells halve DEEP times.
MANY, DEEP = 4096, 6


def _linked_cells(placed: DataFrame, side: float, radius: float) -> DataFrame:
    """(a, b): names of two different cells in which two points lie within the radius. placed: x, y, cx, cy, name.

    Cells with few points are compared point by point. Two full cells descend together: of two sub-cells that are near as a
    whole one is witness enough for their cells, those that are too far as a whole are dropped, and only what lies between is
    refined, so a cell's work follows the edge of the radius and not the square of its points."""
    ahead = [(i, j) for i in range(3) for j in range(-2, 3) if i > 0 or j > 0]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ahead]))
    sizes = placed.groupBy("cx", "cy", "name").agg(F.count(F.lit(1)).alias("n"))
    left = sizes.select(F.col("name").alias("a"), F.col("n").alias("na"), "cx", "cy", steps.alias("o"))
    left = left.select("a", "na", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    pairs = cut_lineage(left.join(sizes, ["cx", "cy"]).select("a", F.col("name").alias("b"), (F.col("na") * F.col("n")).alias("work")))
    points = placed.select("name", "x", "y")

    def compare(pairs: DataFrame, points: DataFrame, own: list[str]) -> DataFrame:
        first = points.select(*[F.col(c).alias(f"a{c}") for c in own], F.col("name").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        second = points.select(*[F.col(c).alias(f"b{c}") for c in own], F.col("name").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        met = pairs.join(first, ["a", *[f"a{c}" for c in own]]).join(second, ["b", *[f"b{c}" for c in own]])
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        return met.filter(F.sqrt(dx * dx + dy * dy) <= radius).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).select("a", "b")

    found = compare(pairs.filter(F.col("work") <= MANY).select("a", "b"), points, [])
    full = pairs.filter(F.col("work") > MANY).select("a", "b")
    if full.isEmpty():
        return found
    hot = cut_lineage(placed.join(full.select(F.col("a").alias("name")).union(full.select("b")).distinct(), "name", "left_semi"))
    finest = side / 2**DEEP
    hot = hot.withColumns({"sx": F.floor(F.col("x") / finest).cast("long"), "sy": F.floor(F.col("y") / finest).cast("long")})
    at = lambda k: hot.select("name", F.shiftright("sx", k).alias("sx"), F.shiftright("sy", k).alias("sy")).distinct()
    open_ = full
    for k in range(DEEP - 1, -1, -1):
        wide = finest * 2**k
        one, two = at(k).toDF("a", "asx", "asy"), at(k).toDF("b", "bsx", "bsy")
        up = lambda df, p: df.withColumns({f"{p}ux": F.shiftright(f"{p}sx", 1), f"{p}uy": F.shiftright(f"{p}sy", 1)})
        keys = [["a"], ["b"]] if k == DEEP - 1 else [["a", "aux", "auy"], ["b", "bux", "buy"]]
        met = open_.join(up(one, "a"), keys[0]).join(up(two, "b"), keys[1])
        dx, dy = F.abs(F.col("asx") - F.col("bsx")), F.abs(F.col("asy") - F.col("bsy"))
        least = F.hypot(F.greatest(dx - 1, F.lit(0)) * wide, F.greatest(dy - 1, F.lit(0)) * wide)
        most = F.hypot((dx + 1) * wide, (dy + 1) * wide)
        # A little is left to the exact test at either bound, against rounding.
        met = met.select("a", "b", "asx", "asy", "bsx", "bsy", (most <= radius * (1 - 1e-9)).alias("near"), least.alias("least")).filter(F.col("least") <= radius * (1 + 1e-9))
        met = cut_lineage(met)
        sure = met.filter("near").select("a", "b").distinct()
        found = found.unionByName(sure)
        open_ = met.join(sure, ["a", "b"], "left_anti").select("a", "b", *([F.col(c).alias(c.replace("s", "u")) for c in ("asx", "asy", "bsx", "bsy")] if k else ("asx", "asy", "bsx", "bsy")))
    return found.unionByName(compare(open_, hot.select("name", "x", "y", "sx", "sy").distinct(), ["sx", "sy"]))


def radius_components(points: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, cluster): single-link clusters of points x, y; a cluster is named by its smallest key."""
    # Points of a cell this wide lie within the radius of each other: cells are the nodes, named by their least key.
    side = radius / 2**0.5 * (1 - 1e-9)
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    placed = cut_lineage(points.select(F.col(key).alias("_k"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy")))
    names = cut_lineage(placed.groupBy("cx", "cy").agg(F.min("_k").alias("name")))
    named = placed.join(names, ["cx", "cy"]).select("cx", "cy", "x", "y", "name")
    found = connected(_linked_cells(named, side, radius))
    roots = names.join(found, names["name"] == found["node"], "left").select("cx", "cy", F.coalesce("root", "name").alias("cluster"))
    return placed.join(roots, ["cx", "cy"]).select(F.col("_k").alias(key), "cluster")


def global_rank(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """rows with their place from 1 in one order over all of them. Rows are dealt by ranges of the order and numbered range
    by range behind the counts of the ranges before, so that no task ranks them all."""
    dealt = cut_lineage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each task of the write
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_r", here).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_r")).drop("_part", "_r", "_start")


def ordered_clusters(points: DataFrame, key: str, radius: float, dense: int = 5) -> DataFrame:
    """(cluster, n, nth, is_dense): clusters by size, then by smallest key."""
    n = radius_components(points, key, radius).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return global_rank(n, [F.col("n").desc(), F.col("cluster")], "nth").select("cluster", "n", "nth", (F.col("n") >= dense).alias("is_dense"))


def delivery_origins(points: DataFrame, key: str, radius: float, outer_total: float, landmark: tuple[float, float] | None = None, least: int = 3) -> DataFrame:
    """(cluster, role, x, y, weight, n): the largest cluster is central and takes 1 - outer_total; the others of at least
    ``least`` points share outer_total by size, and the one nearest to the landmark is named bam."""
    own = points.join(radius_components(points, key, radius), key)
    c = cut_lineage(own.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")))
    size = F.struct(-F.col("n"), F.col("cluster"))  # larger first, then by smallest key
    c = c.crossJoin(F.broadcast(c.agg(F.min_by("cluster", size).alias("_first")))).filter((F.col("cluster") == F.col("_first")) | (F.col("n") >= least))
    outer = F.col("cluster") != F.col("_first")
    away = F.sqrt(F.pow(F.col("x") - (landmark or (0, 0))[0], 2) + F.pow(F.col("y") - (landmark or (0, 0))[1], 2))
    of_all = c.filter(outer).agg(F.sum("n").alias("_total"), F.min_by("cluster", F.struct(away, size)).alias("_near"))  # one row
    role = F.when(~outer, "central").when(F.lit(landmark is not None) & (F.col("cluster") == F.col("_near")), "bam").otherwise("outer_other")
    weight = F.when(outer, F.round(outer_total * F.col("n") / F.col("_total"), 6)).otherwise(F.when(F.col("_total").isNull(), 1.0).otherwise(1 - outer_total))
    return c.crossJoin(F.broadcast(of_all)).select("cluster", role.alias("role"), "x", "y", weight.alias("weight"), "n")


def seeded_kmeans(points: DataFrame, k: int, key: str = "id", rounds: int = 100) -> DataFrame:
    """(key, cluster from 0): weighted k-means of x, y, weight. The first centre is the heaviest point (then least x, y);
    each next one is the point farthest from all centres, ties alike. Ties of assignment go to the lower cluster; an empty
    cluster keeps its centre. Only the k centres come to the driver."""
    points = cut_lineage(points.select(key, "x", "y", "weight"))
    centres: list[tuple[float, float]] = []

    def nearest() -> tuple:
        d = [F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2) for x, y in centres]
        return F.array_min(F.array(*[F.struct(v.alias("d"), F.lit(i).alias("i")) for i, v in enumerate(d)]))

    while len(centres) < k:
        far = F.lit(0.0) if not centres else -nearest()["d"]
        rank = F.struct(far.alias("f"), (-F.col("weight")).alias("w"), F.col("x"), F.col("y"))
        row = points.agg(F.min(rank).alias("m")).first()["m"]
        if row is None or (centres and row["f"] == 0):
            break
        centres.append((row["x"], row["y"]))
    if not centres:
        return points.select(key, F.lit(0).alias("cluster"))
    for _ in range(rounds):
        w = F.col("weight")
        means = points.groupBy(nearest()["i"].alias("i")).agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x"), (F.sum(F.col("y") * w) / F.sum(w)).alias("y"))
        found = {r["i"]: (r["x"], r["y"]) for r in means.collect() if r["x"] is not None}
        later = [found.get(i, c) for i, c in enumerate(centres)]
        if later == centres:
            break
        centres = later
    return points.select(key, nearest()["i"].alias("cluster"))


def snapped_edges(lines: DataFrame, line: str = "line", snap: float = 1.0) -> DataFrame:
    """(a, b, w): undirected edges between the corners of lines, corners snapped to a grid and named by their cell."""
    from ..functions.geometry import distance, segments

    s = lines.select(F.explode(segments(F.col(line))).alias("s")).select("s.*")
    node = lambda x, y: F.shiftleft(F.floor(F.col(x) / snap + 0.5).cast("long") + 2**30, 31).bitwiseOR(F.floor(F.col(y) / snap + 0.5).cast("long") + 2**30)
    s = s.select(node("x1", "y1").alias("a"), node("x2", "y2").alias("b"), distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("w"))
    return s.filter("a <> b").groupBy("a", "b").agg(F.min("w").alias("w"))


def cell_block(node: Column, wide: int = 64) -> Column:
    """Block of a node that snapped_edges() named: a square of ``wide`` cells a side. The bits of both places alternate in its name, so
    blocks whose names follow each other lie near each other."""

    def apart(v: Column) -> Column:
        v = (v / wide).cast("long")
        for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(apart(F.shiftright(node, 31)), 1).bitwiseOR(apart(node.bitwiseAND(F.lit(2**31 - 1))))


def range_block(node: Column, wide: int = 4096) -> Column:
    """Block of a node among ids that lie near each other where edges do."""
    return F.floor(node / wide).cast("long")


def _within_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Dijkstra inside one block. rows: kind 0 an edge (a, b, w, to: the block of b), 1 a distance known before, 2 one that just came
    in. Gives what got nearer: nodes of the block, and nodes beyond its border with the block that they lie in."""
    block = rows["block"].iloc[0]
    known, fresh, edges = {}, {}, {}
    for kind, a, b, w, to in rows[["kind", "a", "b", "w", "to"]].itertuples(index=False):
        if kind == 0:
            edges.setdefault(a, []).append((b, w, to))
        elif kind == 1:
            known[a] = min(w, known.get(a, float("inf")))
        else:
            fresh[a] = min(w, fresh.get(a, float("inf")))
    best, heap, out = dict(known), [], {}
    for a, w in fresh.items():
        if w < best.get(a, float("inf")):
            best[a] = out[a] = w
            heap.append((w, a))
    heapq.heapify(heap)
    beyond: dict = {}
    while heap:
        d, a = heapq.heappop(heap)
        if d > best[a]:
            continue
        for b, w, to in edges.get(a, ()):
            if to != block:
                if d + w < beyond.get(b, (float("inf"),))[0]:
                    beyond[b] = (d + w, to)
            elif d + w < best.get(b, float("inf")):
                best[b] = out[b] = d + w
                heapq.heappush(heap, (d + w, b))
    found = [(block, a, d, True) for a, d in out.items()] + [(to, b, d, False) for b, (d, to) in beyond.items()]
    return pd.DataFrame(found, columns=["block", "node", "dist", "own"])


#: Blocks that follow each other by name are settled together up to about this many arcs.
GATHER = 1 << 18


def _gathered(arcs: DataFrame) -> DataFrame:
    """(block, home): blocks that follow each other share a home of about GATHER arcs; a larger block has its own. Arcs are summed up in
    ranges of blocks, one after the other, so no task sees all blocks."""
    counts = arcs.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    dealt = cut_lineage(counts.repartitionByRange("block").withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.sum("n").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row a task
    here = F.sum("n").over(Window.partitionBy("_part").orderBy("block")) - F.col("n")
    return dealt.withColumn("_here", here).join(F.broadcast(starts), "_part").select("block", F.floor((F.col("_start") + F.col("_here")) / GATHER).cast("long").alias("home"))


def shortest_paths(edges: DataFrame, sources: DataFrame, limit: float = float("inf"), block: Callable[[Column], Column] = range_block, rounds: int = 10_000) -> DataFrame:
    """(node, dist): the least sum of weights (none negative) from any source over undirected edges(a, b, w), for every node
    reached within less than ``limit``.

    Nodes lie in blocks, so chosen that few edges leave one and that one task holds a block's edges. A round settles whole
    blocks: those that heard of a shorter way run Dijkstra inside, and only what they offer to nodes of other blocks is
    exchanged. Small blocks that follow each other are settled as one, as a round costs the start of several jobs. Rounds append
    what changed and rewrite nothing, and there are as many as such groups of blocks on the way, not edges."""
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    arcs = cut_lineage(both.select(block(F.col("a")).alias("block"), F.lit(0).alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w"), block(F.col("b")).alias("to")))
    homes = cut_lineage(_gathered(arcs))
    named = arcs.join(homes, "block").join(homes.toDF("to", "_to"), "to")
    named = cut_lineage(named.select(F.col("home").alias("block"), "kind", "a", "b", "w", F.col("_to").alias("to")))
    drop_table(arcs)
    arcs = named
    # Sources without edges are dealt to homes of their own, below those of blocks.
    lone = -1 - F.pmod(F.xxhash64("node"), F.lit(1024))
    first = sources.select(F.col("node").cast("long").alias("node"), block(F.col("node")).alias("block")).distinct()
    front = cut_lineage(first.join(homes, "block", "left").select("node", F.coalesce("home", lone).alias("block"), F.lit(0.0).alias("dist")))
    known: DataFrame | None = None
    tables = [arcs, homes]
    shown = lambda df, kind: df.select("block", F.lit(kind).alias("kind"), F.col("node").alias("a"), F.col("node").alias("b"), F.col("dist").alias("w"), F.col("block").alias("to"))
    for _ in range(rounds):
        active = front.select("block").distinct()
        rows = arcs.join(active, "block", "left_semi").unionByName(shown(front, 2))
        if known is not None:
            rows = rows.unionByName(shown(known.join(active, "block", "left_semi"), 1))
        changes = cut_lineage(rows.groupBy("block").applyInPandas(_within_block, "block long, node long, dist double, own boolean").filter(F.col("dist") < limit))
        tables += [front, changes]
        own = changes.filter("own").select("block", "node", "dist")
        known = own if known is None else known.unionByName(own)
        offers = changes.filter("NOT own").groupBy("block", "node").agg(F.min("dist").alias("dist"))
        best = known.join(offers.select("node"), "node", "left_semi").groupBy("node").agg(F.min("dist").alias("had"))
        front, left = cut_and_count(offers.join(best, "node", "left").filter("had IS NULL OR dist < had").select("node", "block", "dist"), F.lit(True))
        if not left:
            out = cut_lineage(known.groupBy("node").agg(F.min("dist").alias("dist")))
            for table in [*tables, front]:
                drop_table(table)
            return out
    raise RuntimeError(f"shortest_paths: no end after {rounds} rounds")


def merge_lines(lines: DataFrame, key: str, snap: float = 1.0) -> DataFrame:
    """(key, part): lines that share an end point (on a grid of ``snap``) belong to one part, named by its least key."""
    ends = lines.select(key, F.explode(F.array(F.element_at("line", 1), F.element_at("line", -1))).alias("p"))
    ends = ends.select(key, F.floor(F.col("p.x") / snap + 0.5).alias("px"), F.floor(F.col("p.y") / snap + 0.5).alias("py"))
    hub = ends.groupBy("px", "py").agg(F.min(key).alias("b"))
    found = connected(ends.join(hub, ["px", "py"]).select(F.col(key).alias("a"), "b"))
    return lines.join(found, lines[key] == found["node"], "left").select(lines[key], F.coalesce("root", lines[key]).alias("part"))
