"""Audit aggregates: one pass of conditional counts, duplicates, merges, roll-ups and differences."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import address_key, normalize
from .graph import cut_lineage


def source_audit(objects: DataFrame, car_values: list[str], norm=normalize) -> DataFrame:
    """The seventeen counters of objects(kind, id, tags), in one row. Distinct names and address pairs are counted in
    partial aggregates; nothing is gathered by key beyond their counts."""
    t = F.col("tags")
    has = lambda k: t[k].isNotNull()
    road = (F.col("kind") == "w") & has("highway")
    named = road & (F.coalesce(t["name"], F.lit("")) != "")
    number, building = has("addr:housenumber"), has("building")
    any_addr = F.coalesce(F.exists(F.map_keys(t), lambda k: k.startswith("addr:")), F.lit(False))
    counts = objects.agg(
        F.count_if(road).alias("highway_ways"),
        F.count_if(road & t["highway"].isin(car_values)).alias("car_highway_ways"),
        F.count_if(named).alias("named_highway_ways"),
        F.count_distinct(F.when(named, t["name"])).alias("unique_road_names"),
        F.count_if(building).alias("buildings"),
        F.count_if(building & number).alias("buildings_with_housenumber"),
        F.count_if((F.col("kind") == "n") & number & ~building).alias("address_nodes"),
        *[F.count_if(has(k)).alias(n) for k, n in (("addr:street", "objects_with_addr_street"), ("addr:place", "objects_with_addr_place"), ("name:ru", "objects_with_name_ru"), ("name:ro", "objects_with_name_ro"), ("alt_name", "objects_with_alt_name"), ("old_name", "objects_with_old_name"))],
        F.count_if(any_addr & ~number).alias("address_objects_without_housenumber"),
        F.count_if(number & ~has("addr:street") & ~has("addr:place")).alias("housenumber_without_street_or_place"),
    )
    pairs = objects.filter(number & has("addr:street"))
    return counts.crossJoin(duplicates(pairs, address_key(t["addr:street"], t["addr:housenumber"], norm), "duplicate_address_groups", "duplicate_address_objects"))


def duplicates(rows: DataFrame, key: Column, groups: str = "duplicate_groups", objects: str = "duplicate_objects") -> DataFrame:
    """One row: how many keys occur more than once, and how many rows beyond the first those have."""
    counts = rows.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counts.agg(F.count(F.lit(1)).alias(groups), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(objects))


def requested(ids: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Every requested id with what was found for it; ``found`` says whether anything was."""
    return ids.join(found.withColumn("_hit", F.lit(True)), key, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def member_counts(relations: DataFrame) -> DataFrame:
    """Relations with member_count and member_type_counts, a map."""
    kinds = F.array_distinct(F.transform("members", lambda m: m["type"]))
    per = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter("members", lambda m: m["type"] == k))))
    return relations.withColumns({"member_count": F.coalesce(F.size("members"), F.lit(0)), "member_type_counts": per})


def merge_segments(segments: DataFrame, keys: list[str], fields: list[str], classes: list[str]) -> DataFrame:
    """Street rows from road segments (id, road_class, is_address, review, fields...): of each field the value at the
    lowest id that carries one, any address, any review, the smallest id, and the class that comes first in ``classes``."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, classes)), F.col("road_class")), F.lit(0))
    rank = F.when(rank == 0, len(classes) + 1).otherwise(rank)
    lowest = [F.min_by(F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col(f)), F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col("id"))).alias(f) for f in fields]
    return segments.groupBy(*keys).agg(*lowest, F.bool_or("is_address").alias("is_address"), F.bool_or("review").alias("review"), F.min("id").alias("min_id"), F.count(F.lit(1)).alias("segments"), F.min_by(F.when(rank <= len(classes), F.col("road_class")), rank).alias("road_class"))


def street_stats(streets: DataFrame) -> DataFrame:
    """Counts over address streets only."""
    on = F.col("is_address")
    return streets.agg(F.count_if(on).alias("unique_streets"), F.count_if(on & (F.col("status") == "ok")).alias("named_ru"), F.count_if(on & (F.col("status") != "ok")).alias("needs_ru_review"), F.count_if(F.col("review")).alias("needs_review"))


def roll_up(rows: DataFrame, key: str, sums: list[str], total: str = "TOTAL") -> DataFrame:
    """Sums by key and in all, the latter under ``total``."""
    out = rows.rollup(key).agg(F.grouping(key).alias("_g"), *[F.sum(s).alias(s) for s in sums])
    return out.withColumn(key, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key))).drop("_g")


def metric_deltas(rows: DataFrame, candidate: str, metrics: list[str], first, second) -> DataFrame:
    """(metric, value of first, value of second, delta): delta only where both candidates are there."""
    long = rows.unpivot([candidate], metrics, "metric", "value")
    wide = long.groupBy("metric").agg(F.max(F.when(F.col(candidate) == first, F.col("value"))).alias("first_value"), F.max(F.when(F.col(candidate) == second, F.col("value"))).alias("second_value"))
    return wide.withColumn("delta", F.col("second_value") - F.col("first_value"))


def count_by(rows: DataFrame, key: str, missing: str = "unknown") -> DataFrame:
    """Frequencies, most frequent first, then by key. Null and '' count as missing."""
    return rows.groupBy(F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(missing)).alias(key)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), key)


def summarise(units: DataFrame, types: list[str], key: str = "unit_type") -> DataFrame:
    """Counts by type, those without a unit included."""
    wanted = units.sparkSession.createDataFrame([(t,) for t in types], f"{key} string")
    counts = units.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Of the rows of a key the first in an order. min_by aggregates in part before the shuffle, so a hot key moves little."""
    place = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), place).alias("_row")).select(*keys, "_row.*")


def exceptions(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The rejected sets as one ledger, each row with its reason."""
    out = None
    for reason, rows in parts.items():
        own = rows.select(*columns, F.lit(reason).alias("reason"))
        out = own if out is None else out.unionByName(own)
    return out


def difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return left.join(right.select(*key), key, "left_anti")


def disjoint(allow: DataFrame, deny: DataFrame) -> DataFrame:
    """One row, ``disjoint``: whether two lists share nothing."""
    return allow.distinct().join(deny.distinct(), allow.columns, "left_semi").agg((F.count(F.lit(1)) == 0).alias("disjoint"))


def spread_groups(rows: DataFrame, key: str, value: Column, limit: float, others: list[Column]) -> DataFrame:
    """Groups of a key whose values lie more than ``limit`` apart are disputed as a whole; the others are merged. One row
    a group: spread, n, status, least value, and further aggregates."""
    out = rows.groupBy(key).agg((F.max(value) - F.min(value)).alias("spread"), F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), *others)
    return out.withColumn("status", F.when(F.col("spread") > limit, "disputed").when(F.col("n") > 1, "merged").otherwise("single"))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """A report of the first n rows."""
    return rows.orderBy(*order).limit(n)


def window_share(rows: DataFrame, weight: str) -> DataFrame:
    """Each row's share of all weight, by a total that is aggregated before it is spread."""
    total = rows.agg(F.sum(weight).alias("_total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("share", F.col(weight) / F.col("_total")).drop("_total")


def first_reason(tests: list[tuple[str, Column]], otherwise: str) -> Column:
    """The label of the first test that holds."""
    out = F.lit(otherwise)
    for label, test in reversed(tests):
        out = F.when(test, label).otherwise(out)
    return out


def nearest_rank(rows: DataFrame, value: str, keys: list[str], percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles: the value at place min(int(n * p / 100), n - 1) from 0.

    No task ranks all values of a key. Equal values are counted first, then dealt by ranges of key and value; a range's
    counts say which ranks lie in it, and only ranges that hold a percentile are ranked. Ranges follow a sample of the values as
    they are, so outliers do not crowd the others together."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = cut_lineage(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))  # a row for each key and range
    w = Window.partitionBy(*keys)
    parts = parts.withColumns({"_hi": F.sum("_in").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_in").over(w)})
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.least(F.floor(F.col("_all") * p / 100), F.col("_all") - 1).alias("at")) for p in percents]))
    found = parts.withColumn("_w", wanted).filter((F.col("_w.at") < F.col("_hi")) & (F.col("_w.at") >= F.col("_hi") - F.col("_in")))
    found = found.select(*keys, "_part", F.col("_w.p").alias("_p"), (F.col("_w.at") - F.col("_hi") + F.col("_in")).alias("_at"))
    right = found.toDF(*[f"_r_{k}" for k in keys], "_part_", "_p", "_at")
    on = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.col("_part") == F.col("_part_"))
    inside = dealt.join(right, on)
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    hit = inside.withColumn("_hi", upto).filter("_hi > _at").groupBy(*keys, "_p").agg(F.min("_v").alias("_v"))
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(f"p{p}") for p in percents])
