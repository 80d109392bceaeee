"""Sharding by balanced label propagation.

Documents with equal texts are linked. Labels are shards. A plain deal by hash gives every document its first label, which cuts
most links. Then labels move along the links in rounds: joined with the labels of its documents' neighbours, a group asks for the shard
that most of them carry, provided that its quota has room for all of the group, and else for another with room. Documents of a
group are interchangeable, so the state is their number in each shard, at most ``n_shards`` rows however large the group is.
What asks for a shard is admitted up to its quota, larger groups first, and the rest asks again. Communities of a quarter of a
shard or more settle first, then those down to a sixteenth, and so on, as a small one always finds room that a large one has left. A
round ends with fewer cut links, as an admitted group has none; the rounds end when nothing is admitted any more.

A group larger than a shard (fewer than there are shards) must be cut and is laid over the fewest shards beforehand; a group that no
shard had room for is cut at the end. Documents without links have no edge to cut; they fill what the quotas leave, which makes
the law exact: shard sizes in rows differ by one at most.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import deal_by_rank, forget, keep, part_rows, salts_for, with_rank


_log = logging.getLogger(__name__)


@dataclass
class Round:
    """What a round did: rows that changed their shard, groups settled, and links still cut after it."""

    moved: int
    settled: int
    cut: int


def _links_cut(state: DataFrame) -> int:
    """Pairs of linked documents in different shards. state: grp, size, shard, n."""
    per = state.groupBy("grp", "size").agg(F.sum(F.col("n") * F.col("n")).alias("same"))
    return per.agg(F.coalesce(F.sum((F.col("size") * F.col("size") - F.col("same")) / 2), F.lit(0)).cast("long")).first()[0]


def _round(state: DataFrame, rooms: list[int], least: int, parts: int, turn: int) -> DataFrame:
    """(grp, size, to, moved, mended): the groups of at least ``least`` documents that are admitted, the shard they gather in, how many of
    their documents move there, and how many links are cut no more. state: grp, size, shard, n."""
    spark = state.sparkSession
    room = spark.createDataFrame(list(enumerate(rooms)), "shard int, room long")  # a row a shard
    tie = F.xxhash64("grp", "shard", F.lit(turn))
    fits = F.when(F.col("room") >= F.col("size"), F.struct("n", tie.alias("tie"), "shard"))
    own = state.filter(F.col("size") >= least).join(F.broadcast(room), "shard").groupBy("grp", "size").agg(F.max(fits).alias("best"), F.sum(F.col("n") * F.col("n")).alias("same"))
    every = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(r).cast("long").alias("room")) for s, r in enumerate(rooms)])
    others = own.withColumn("others", F.filter(every, lambda r: r["room"] >= F.col("size")))
    other = F.get("others", F.pmod(F.xxhash64("grp", F.lit(turn)), F.greatest(F.size("others"), F.lit(1))).cast("int"))["shard"]
    mended = ((F.col("size") * F.col("size") - F.col("same")) / 2).cast("long")
    asks = others.select("grp", "size", mended.alias("mended"), F.coalesce("best.shard", other).alias("to")).filter("to IS NOT NULL")
    asks = asks.withColumns({"level": F.floor(F.log2("size")).cast("int"), "part": F.pmod(F.xxhash64("grp"), F.lit(parts)).cast("int")})
    # The queue of a shard goes by size classes and is counted in parts with prefix sums, so that no task ranks all of it.
    sums = asks.groupBy("to", "level", "part").agg(F.sum("size").alias("asked"))
    earlier = Window.partitionBy("to").orderBy(F.col("level").desc(), "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("to", "level", "part", F.coalesce(F.sum("asked").over(earlier), F.lit(0)).alias("before"))
    queue = Window.partitionBy("to", "level", "part").orderBy(F.col("size").desc(), "grp").rowsBetween(Window.unboundedPreceding, 0)
    asks = asks.withColumn("until", F.sum("size").over(queue)).join(sums, ["to", "level", "part"])
    goes = asks.join(F.broadcast(room.withColumnRenamed("shard", "to")), "to").filter(F.col("before") + F.col("until") <= F.col("room"))
    there = state.select("grp", F.col("shard").alias("to"), "n")
    moved = F.col("size") - F.coalesce("n", F.lit(0))
    return goes.select("grp", "size", "to", "mended").join(there, ["grp", "to"], "left").select("grp", "size", "to", moved.alias("moved"), "mended")


def propagate(state: DataFrame, rooms: list[int], total: int) -> tuple[DataFrame, DataFrame, list[Round]]:
    """(settled, left, rounds). state: grp, size, shard, n, all groups no larger than a shard; rooms: documents that each shard takes.
    settled: grp, shard, n (all of the group); left: the state of groups that no shard has room for."""
    spark, rooms, parts = state.sparkSession, list(rooms), salts_for(total // max(1, len(rooms)) + 1, total)
    settled, rounds = None, [Round(0, 0, _links_cut(state))]
    least = max(2, max(rooms, default=0) // 4)
    while True:
        found = keep(_round(state, rooms, least, parts, len(rounds)), "shard-moves")
        per = found.groupBy("to").agg(F.sum("size").alias("n"), F.sum("moved").alias("moved"), F.sum("mended").alias("mended"), F.count(F.lit(1)).alias("groups")).collect()  # a row a shard
        if not per and least == 2:
            forget(found)
            break
        for r in per:
            rooms[r["to"]] -= r["n"]
        least = max(2, least // 4)
        if per:
            own = found.select("grp", F.col("to").alias("shard"), F.col("size").alias("n"))
            settled = own if settled is None else settled.unionByName(own)
            later = keep(state.join(found.select("grp"), "grp", "left_anti"), "shard-state")
            forget(state)
            state = later
            rounds.append(Round(sum(r["moved"] for r in per), sum(r["groups"] for r in per), rounds[-1].cut - sum(r["mended"] for r in per)))
    none = spark.createDataFrame([], "grp string, shard int, n long")
    return (none if settled is None else keep(settled, "shard-settled")), state, rounds


def _over_fewest(sizes: list[int], rooms: list[int]) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Lays groups larger than a shard over shards: (group, shard, rows), and the room that is left. Whole shards first;
    then the rests, large ones first, each into the shard with most room, and on into the next if it holds no more."""
    rooms, out, rests = list(rooms), [], []
    empty = sorted((s for s, r in enumerate(rooms) if r), key=lambda s: (-rooms[s], s))
    for g, rest in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        while (s := next((s for s in empty if rooms[s] <= rest), None)) is not None:
            empty.remove(s)
            out.append((g, s, rooms[s]))
            rest, rooms[s] = rest - rooms[s], 0
        rests.append((rest, g))
    for rest, g in sorted(rests, reverse=True):
        while rest:
            s = max(range(len(rooms)), key=lambda s: (rooms[s], -s))
            n = min(rest, rooms[s])
            out.append((g, s, n))
            rest, rooms[s] = rest - n, rooms[s] - n
    return out, rooms


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Returns doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law), group_rows.

    A null text counts as empty; documents with null and empty texts form one group. Rows that repeat are separate
    documents. An empty table gives an empty result. Further columns are ignored. A null doc_id is kept.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.concat(F.md5(text), F.hex(F.octet_length(text).cast("long"))).alias("grp"),
        ),
        "shard-meta",
    )
    total = meta.count()
    quotas = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    # The plain deal, counted before anything is joined, so that a group of any size is a row a shard from here on.
    first = F.pmod(F.xxhash64("doc_id", "grp"), F.lit(n_shards)).cast("int")
    dealt = keep(meta.groupBy("grp", first.alias("shard")).agg(F.count(F.lit(1)).alias("n")), "shard-start")
    groups = keep(dealt.groupBy("grp").agg(F.sum("n").alias("group_rows")).filter("group_rows > 1"), "shard-groups")
    # No more groups than shards are larger than one.
    large = groups.filter(F.col("group_rows") > max(1, total // n_shards)).select("grp", "group_rows").orderBy("grp").collect()
    laid, quotas = _over_fewest([r["group_rows"] for r in large], quotas)
    fixed = meta.sparkSession.createDataFrame([(large[g]["grp"], s, n) for g, s, n in laid], "grp string, shard int, n long")
    small = groups.join(F.broadcast(fixed.select("grp").distinct()), "grp", "left_anti")
    start = keep(dealt.join(small, "grp").select("grp", F.col("group_rows").alias("size"), "shard", "n"), "shard-state")
    settled, left, rounds = propagate(start, quotas, total)
    for n, r in enumerate(rounds):
        _log.info("round %d: %d rows moved, %d groups settled, %d links cut", n, r.moved, r.settled, r.cut)
    loads = {r["shard"]: r["n"] for r in settled.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    free = [q - loads.get(s, 0) for s, q in enumerate(quotas)]
    # What is left of a size class is more than any shard's room, so there are at most about twice as many as shards of each class.
    rest = left.select("grp", "size").distinct().orderBy(F.col("size").desc(), "grp").collect()
    late, free = _over_fewest([r["size"] for r in rest], free)
    last = meta.sparkSession.createDataFrame([(rest[g]["grp"], s, n) for g, s, n in late], "grp string, shard int, n long")
    # Linked documents, by rank in their group, then the others into the room that is left.
    w = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    state = settled.unionByName(fixed).unionByName(last)
    spans = state.withColumn("hi", F.sum("n").over(w)).select("grp", (F.col("hi") - F.col("n")).alias("lo"), "hi", "shard")
    linked = meta.join(groups.select("grp", "group_rows"), "grp")
    # A group is ranked in as many parts as its own rows ask for.
    own = F.ceil(F.col("group_rows") / part_rows(total)).cast("int")
    linked = deal_by_rank(linked, ["grp"], ["doc_id"], spans, own)
    ends = [sum(free[: s + 1]) for s in range(n_shards)]
    rest = [(0, e - f, e, s) for s, (f, e) in enumerate(zip(free, ends, strict=True)) if f > 0]
    room = meta.sparkSession.createDataFrame(rest, "one int, lo long, hi long, shard int")
    single = meta.join(groups.select("grp"), "grp", "left_anti").withColumns({"one": F.lit(0), "group_rows": F.lit(1).cast("long")})
    single = deal_by_rank(single, ["one"], ["doc_id", "grp"], room, salts_for(total, total)).drop("one")
    dealt = keep(linked.select(*single.columns).unionByName(single), "shard-dealt")
    out = with_rank(dealt, ["shard"], ["doc_id", "grp"], salts_for(total // n_shards + 1, total), "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_rows"
    )
