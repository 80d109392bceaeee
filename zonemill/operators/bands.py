"""Ordered cost bands: bins, prefix sums, exact dynamic programme, edges, assignment, metrics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import house_number_order
from .audit import nearest_rank
from .graph import cut_lineage


def make_bins(rows: DataFrame, value: Column, weight: Column, width: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, bin, value, weight, count): the weighted mean of a bin, or its middle where the weight is 0. Null values are
    left out. All in double: a decimal width would move values at the borders."""
    keys = keys or []
    w = F.lit(float(width))
    bins = rows.filter(value.isNotNull()).groupBy(*keys, F.floor(value.cast("double") / w).alias("bin"))
    out = bins.agg(F.sum(value * weight).alias("_wx"), F.sum(weight.cast("double")).alias("weight"), F.count(F.lit(1)).alias("count"))
    mean = F.when(F.col("weight") > 0, F.col("_wx") / F.col("weight")).otherwise((F.col("bin") + 0.5) * w)
    return out.select(*keys, "bin", mean.alias("value"), "weight", "count")


def prefix_sums(bins: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bins with place (from 1) and the sums w, wx, wxx up to and with each. Bins are few by construction."""
    order = Window.partitionBy(*(keys or [])).orderBy("bin")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumns({
        "place": F.row_number().over(order),
        "w": F.sum("weight").over(upto),
        "wx": F.sum(F.col("weight") * F.col("value")).over(upto),
        "wxx": F.sum(F.col("weight") * F.col("value") * F.col("value")).over(upto),
    })


def squared_error(w: Column, wx: Column, wxx: Column) -> Column:
    """Weighted squared deviation from the sums of a band; never below 0, and 0 without weight."""
    mean = wx / w
    return F.when(w <= 0, F.lit(0.0)).otherwise(F.greatest(wxx - 2 * mean * wx + mean * mean * w, F.lit(0.0)))


def _first(holds, ends: np.ndarray) -> np.ndarray:
    """For each end the least start from 0 to the end for which ``holds`` (false, then true as starts grow) holds, or end + 1."""
    lo, hi = np.zeros(len(ends), np.int64), ends + 1
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        yes = holds(np.minimum(mid, ends)) & (mid <= ends)
        hi, lo = np.where(open_ & yes, mid, hi), np.where(open_ & ~yes, mid + 1, lo)
    return lo


def _least_starts(layer: np.ndarray, cost, cut: np.ndarray, first: np.ndarray, last: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """For each end from ``band`` on the least of layer[start] + cost(start, end) + cut[start] over the starts from first[end] to last[end],
    and the earliest start that has it (-1 without any).

    Costs of bands obey the quadrangle inequality and the stretches of starts move on with the end, so earliest best starts
    never go back. The middle end of a stretch of ends is settled first and parts the starts of those before and behind it:
    all middles of one depth at once, with about as many pairs as ends at each of the log(n) depths."""
    n = len(layer) - 1
    reached = np.flatnonzero(layer < math.inf)  # starts outside their stretch would say nothing and part nothing
    if len(reached):
        first, last = np.maximum(first, reached[0]), np.minimum(last, reached[-1])
    best, choice = np.full(n + 1, math.inf), np.full(n + 1, -1, np.int64)
    spans = np.array([[band, n, 0, n]]) if n >= band else np.empty((0, 4), np.int64)
    while len(spans):
        a, b, lo, hi = spans.T
        mid = (a + b) // 2
        begin = np.maximum(lo, first[mid])
        count = np.maximum(np.minimum(hi, last[mid]) - begin + 1, 0)
        some = count > 0
        at = mid[some]
        size = count[some]
        head = np.cumsum(size) - size
        start = np.repeat(begin[some] - head, size) + np.arange(size.sum())
        value = layer[start] + cost(start, np.repeat(at, size)) + cut[start]
        if len(at):
            least = np.minimum.reduceat(value, head)
            place = np.where(value == np.repeat(least, size), start, n + 1)
            best[at] = least
            choice[at] = np.where(least < math.inf, np.minimum.reduceat(place, head), -1)
        known = choice[mid]
        left = np.stack((a, mid - 1, lo, np.where(known >= 0, known, hi)), axis=1)
        right = np.stack((mid + 1, b, np.where(known >= 0, known, lo), hi), axis=1)
        spans = np.concatenate((left, right))
        spans = spans[spans[:, 0] <= spans[:, 1]]
    return best, choice


def optimal_bands(bins: list[tuple[float, float]], k: int, min_share: float = 0.05, split_at: list[float] | None = None, penalty: float = 0.0, max_share: float = 1.0) -> list[tuple[int, int]]:
    """The exact partition of ordered bins (value, weight) into k bands of least squared deviation plus cut costs, as
    (start, end) places. Every band's weight lies between the two shares of the whole; of equal costs the earliest last cut
    wins. If no partition fits, the lower share is halved while above 0.005, then the upper one raised by a quarter up to
    1, then all is one band."""
    n = len(bins)
    if not n:
        return []
    k = max(1, min(k, n))
    value, weight = (np.array(c, np.float64) for c in zip(*bins, strict=True))
    w, wx, wxx = (np.concatenate(([0.0], np.cumsum(c))) for c in (weight, weight * value, weight * value * value))
    total = w[n]
    cut = np.zeros(n + 1)
    if penalty > 0 and split_at:
        cut[1:n] = penalty * np.array(split_at[1:n], np.float64) * total

    def cost(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Deviation of the bands from place start to end."""
        sw, sx, sxx = w[end] - w[start], wx[end] - wx[start], wxx[end] - wxx[start]
        mean = np.divide(sx, sw, out=np.zeros(len(sw)), where=sw > 0)
        return np.where(sw > 0, np.maximum(sxx - 2 * mean * sx + mean * mean * sw, 0.0), 0.0)

    while True:
        low, high = total * min_share, total * max_share
        ends = np.arange(n + 1)
        # The starts that give a band ending at a place a weight between the shares: a stretch that moves on with the place.
        first, last = _first(lambda i: w[ends] - w[i] <= high, ends), _first(lambda i: w[ends] - w[i] < low, ends) - 1
        layer = np.concatenate(([0.0], np.full(n, math.inf)))
        choices = []
        for band in range(1, k + 1):
            layer, choice = _least_starts(layer, cost, cut, np.maximum(first, band - 1), np.minimum(last, ends - 1), band)
            choices.append(choice)
        if layer[n] < math.inf:
            ends = [n]
            for choice in reversed(choices):
                ends.append(int(choice[ends[-1]]))
            ends.reverse()
            return list(zip(ends[:-1], ends[1:], strict=True))
        if min_share > 0.005:
            min_share /= 2
        elif max_share < 1:
            max_share = min(1.0, max_share * 1.25)
        else:
            return [(0, n)]


def _banded(bins: DataFrame, keys: list[str], setting) -> DataFrame:
    """optimal_bands() of each key's bins; setting(rows of a key) says k and the further rules."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        split = pdf["split_share"].tolist() if "split_share" in pdf else None
        k, rules = setting(pdf)
        bounds = optimal_bands(list(zip(pdf["value"], pdf["weight"], strict=True)), k, split_at=split, **rules)
        values = pdf["value"].tolist()
        rows = [(b, s, e, values[e - 1], len(bounds)) for b, (s, e) in enumerate(bounds)]
        out = pd.DataFrame(rows, columns=["band", "start_place", "end_place", "edge", "n_bands"])
        for i, key in enumerate(keys):
            out.insert(i, key, pdf[key].iloc[0])
        return out

    schema = "".join(f"{c} {bins.schema[c].dataType.simpleString()}, " for c in keys) + "band int, start_place int, end_place int, edge double, n_bands int"
    return bins.groupBy(*keys).applyInPandas(run, schema)


def band_table(bins: DataFrame, k: int, keys: list[str] | None = None, **rules) -> DataFrame:
    """(keys, band from 0, start_place, end_place, edge, n_bands): optimal_bands() of each key's bins. The edge is the value of a
    band's last bin. A key has as many rows as occupied bins, whatever the number of units; the keys run in parallel."""
    if keys:
        return _banded(bins, keys, lambda _: (k, rules))
    return _banded(bins.withColumn("_all", F.lit(0)), ["_all"], lambda _: (k, rules)).drop("_all")


def cuts_sql(k: int, min_share: float = 0.05, source: str = "bins", penalty: float = 0.0) -> str:
    """SQL that finds the same partition by listing the cuts of prefix sums (place, w, wx, wxx, and with a penalty the
    split_share of the cut behind each place): for tests and k up to 4."""
    joins, cost, tests, last = [], [], [], ("0", "0.0", "0.0", "0.0")
    for b in range(1, k + 1):
        t = f"p{b}"
        joins.append(f"{source} {t}" if b == 1 else f"JOIN {source} {t} ON {t}.place > p{b - 1}.place")
        w, wx, wxx = (f"({t}.{c} - {last[i]})" for i, c in enumerate(("w", "wx", "wxx"), 1))
        cost.append(f"CASE WHEN {w} <= 0 THEN 0 ELSE greatest({wxx} - 2 * ({wx} / {w}) * {wx} + ({wx} / {w}) * ({wx} / {w}) * {w}, 0) END")
        if penalty and b < k:
            cost.append(f"{penalty} * {t}.split_share * a.w")
        tests += [f"{w} >= {min_share} * a.w", f"{w} <= a.w"]
        last = (f"{t}.place", f"{t}.w", f"{t}.wx", f"{t}.wxx")
    order = ", ".join(f"p{b}.place" for b in range(k - 1, 0, -1))
    ends = ", ".join(f"p{b}.place AS end{b}" for b in range(1, k + 1))
    return f"SELECT {ends} FROM {' '.join(joins)} JOIN (SELECT * FROM {source} ORDER BY place DESC LIMIT 1) a ON p{k}.place = a.place WHERE {' AND '.join(tests)} ORDER BY {' + '.join(cost)}{', ' + order if order else ''} LIMIT 1"


def assign_band(value: Column, edges: list[float]) -> Column:
    """The first band whose edge is not below the value, else the last; none without a value."""
    out = F.lit(len(edges) - 1)
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(value <= edges[i], i).otherwise(out)
    return F.when(value.isNotNull(), out)


def assign_by_table(rows: DataFrame, value: str, bands: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """assign_band() with edges from band_table(), by its keys. The edges of a key travel as one array."""
    keys = keys or []
    edges = bands.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "edge"))), lambda s: s["edge"]).alias("_edges"))
    joined = rows.join(edges, keys) if keys else rows.crossJoin(F.broadcast(edges))  # one row of k numbers
    at = F.array_position(F.transform("_edges", lambda e: (F.col(value) <= e).cast("int")), F.lit(1))
    return joined.withColumn("band", F.when(at > 0, at.cast("int") - 1).when(F.col(value).isNotNull(), F.size("_edges") - 1)).drop("_edges")


def band_metrics(rows: DataFrame, value: str, weight: str, keys: list[str] | None = None, percents: list[int] | None = None) -> DataFrame:
    """A row for each band: units, weight and its share, least, nearest-rank percentiles and greatest value, deviation."""
    few = not keys  # then there is one row of sums for each band
    keys = [*(keys or []), "band"]
    v, w = F.col(value), F.col(weight)
    counted = (w > 0) & v.isNotNull()
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"), F.sum(w).alias("weight"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        F.sum(F.when(counted, w)).alias("_w"), F.sum(F.when(counted, w * v)).alias("_wx"),
    )
    # The deviation in two passes, as a difference of squares would lose digits.
    means = sums.select(*keys, (F.col("_wx") / F.col("_w")).alias("_mean"))
    squares = rows.join(F.broadcast(means) if few else means, keys).groupBy(*keys).agg(F.sum(F.when(counted, w * (v - F.col("_mean")) * (v - F.col("_mean")))).alias("_ss"))
    out = sums.join(squares, keys).join(nearest_rank(rows, value, keys, percents or [50, 75, 90]), keys)
    total = Window.partitionBy(*keys[:-1])
    out = out.withColumns({"weight_share": F.col("weight") / F.sum("weight").over(total), "dispersion": F.sqrt(F.col("_ss") / F.col("_w"))})
    return out.drop("_w", "_wx", "_ss")


def zone_summary(rows: DataFrame, km: str, minutes: str, weight: str, street: Column, addressed: Column) -> tuple[DataFrame, DataFrame]:
    """(zones, streets). zones: band_metrics() of kilometres with the least, the percentiles and the greatest of minutes and the units with
    an address. streets: a row for each band and name of a street in it (null names left out). The banded rows are kept once
    and both measures are taken from them together, as one long table."""
    short = cut_lineage(rows.select("band", F.col(km).alias("_km"), F.col(minutes).alias("_min"), F.col(weight).alias("_weight"), street.alias("street"), addressed.alias("_addressed")))
    measure = lambda name, c: F.struct(F.lit(name).alias("measure"), F.col(c).cast("double").alias("value"))
    long = short.select("band", "_weight", F.inline(F.array(measure("km", "_km"), measure("minutes", "_min"))))
    every = band_metrics(long, "value", "_weight", ["measure"])
    names = ("min_value", "p50", "p75", "p90", "max_value")
    time = every.filter("measure = 'minutes'").select("band", *[F.col(c).alias(f"minutes_{c.removesuffix('_value')}") for c in names])
    more = short.groupBy("band").agg(F.count_if("_addressed").alias("address_units"))
    zones = every.filter("measure = 'km'").drop("measure").join(time, "band").join(more, "band")
    return zones, short.filter("street IS NOT NULL").select("band", "street").distinct()


def level_weights(weight: Column, levels: Column, cap: int = 5) -> dict[str, Column]:
    """Models of a unit's weight for houses of flats: as one unit, times their levels (1 at least; 1 where unknown), and times the
    levels up to a cap."""
    floors = F.greatest(F.coalesce(levels, F.lit(1)), F.lit(1))
    return {"one_unit": weight, "levels": weight * floors, f"levels_capped_{cap}": weight * F.least(floors, F.lit(cap))}


def scenario_statistics(rows: DataFrame, table: DataFrame, keys: list[str], value: str, weight: str, street: str, addressed: Column) -> tuple[DataFrame, DataFrame]:
    """(zones, totals) of every scenario of a table of bands (keys, band, edge), as sweep() and model_sweep() give them.

    zones: keys, band, units, unit_share, weight, weight_share, dispersion; empty bands included. totals: keys, split_streets, split_addresses
    and split_weight (addressed units on streets that lie in two zones or more), dispersion (by weight), largest_share, smallest_share,
    balance, monotonic. The scenarios are a stated list, and rows meet them once; what leaves a task is one row for each scenario, band and
    street. Deviations are taken around the middle of a band's edges, so one pass does and digits are not lost."""
    edges = table.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "edge"))), lambda e: e["edge"]).alias("_edges"))
    v, w = F.col("_v"), F.col("_w")
    short = rows.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w"), F.col(street).alias("_street"), addressed.alias("_addressed"))
    met = short.crossJoin(F.broadcast(edges))  # as many rows as scenarios were asked for
    at = F.array_position(F.transform("_edges", lambda e: (v <= e).cast("int")), F.lit(1)).cast("int")
    met = met.withColumn("band", F.when(at > 0, at - 1).otherwise(F.size("_edges") - 1))
    middle = (F.element_at("_edges", F.col("band") + 1) + F.when(F.col("band") > 0, F.get("_edges", F.col("band") - 1)).otherwise(F.col("_edges")[0])) / 2
    counted, off = F.when(w > 0, w), v - middle
    sums = met.groupBy(*keys, "band", "_street").agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(counted).alias("s0"), F.sum(counted * off).alias("s1"), F.sum(counted * off * off).alias("s2"),
        F.count_if("_addressed").alias("a"), F.sum(F.when(F.col("_addressed"), w)).alias("aw"), F.min(v).alias("lo"), F.max(v).alias("hi"),
    )
    sums = cut_lineage(sums)
    per = sums.groupBy(*keys, "band").agg(*[F.sum(c).alias(c) for c in ("n", "w", "s0", "s1", "s2")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("s0") - F.pow(F.col("s1") / F.col("s0"), 2), F.lit(0.0)))
    every = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_edges") - 1)).alias("band"))
    zones = every.join(per, [*keys, "band"], "left").fillna(0, ["n"]).fillna(0.0, ["w"])
    own = Window.partitionBy(*keys)
    share = lambda c: F.when(F.sum(c).over(own) > 0, F.col(c) / F.sum(c).over(own)).otherwise(0.0)
    before = F.max("hi").over(own.orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    zones = cut_lineage(zones.withColumns({"unit_share": share("n"), "weight_share": share("w"), "dispersion": spread, "_rises": F.coalesce(before <= F.col("lo"), F.lit(True))}))
    split = sums.filter("_street IS NOT NULL").groupBy(*keys, "_street").agg(F.count_distinct("band").alias("b"), F.sum("a").alias("a"), F.sum("aw").alias("aw")).filter("b > 1")
    split = split.groupBy(*keys).agg(F.count(F.lit(1)).alias("split_streets"), F.sum("a").alias("split_addresses"), F.sum("aw").alias("split_weight"))
    total = zones.groupBy(*keys).agg(
        (F.sum(F.coalesce("dispersion", F.lit(0.0)) * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("dispersion"), F.max("weight_share").alias("largest_share"),
        F.min("weight_share").alias("smallest_share"), F.bool_and("_rises").alias("monotonic"),
    )
    total = total.withColumn("balance", F.when(F.col("largest_share") > 0, F.col("smallest_share") / F.col("largest_share")).otherwise(0.0))
    total = total.join(split, keys, "left").fillna(0, ["split_streets", "split_addresses"]).fillna(0.0, ["split_weight"])
    return zones.select(*keys, "band", F.col("n").alias("units"), "unit_share", F.col("w").alias("weight"), "weight_share", "dispersion"), total


def is_monotonic(metrics: DataFrame) -> DataFrame:
    """One row: whether each band ends at or before the least value of the next (empty bands are not in the rows)."""
    w = Window.partitionBy(F.lit(0)).orderBy("band")
    return metrics.withColumn("_before", F.lag("max_value").over(w)).agg(F.coalesce(F.bool_and(F.coalesce(F.col("_before") <= F.col("min_value"), F.lit(True))), F.lit(True)).alias("monotonic"))


def _run_over_cuts(changes: DataFrame) -> DataFrame:
    """(cut, n, amount) from changes (at, n, amount) of what lies over a cut: each place's changes summed, then summed up to each
    place, and every place filled in from one change to the next. Rows are as many as bins, however many streets there are."""
    per = changes.groupBy("at").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    order = Window.partitionBy(F.lit(0)).orderBy("at")  # bins are few by construction
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    run = per.select("at", F.lead("at").over(order).alias("_next"), F.sum("n").over(upto).alias("n"), F.sum("amount").over(upto).alias("amount")).filter("n > 0")
    return run.select(F.explode(F.sequence("at", F.col("_next") - 1)).alias("cut"), "n", "amount")


def split_counts(units: DataFrame, street: str = "street", bin_place: str = "place") -> DataFrame:
    """(cut, n): how many streets a cut before a bin's place would split. A street changes the count where it begins and ends."""
    ends = units.groupBy(street).agg(F.min(bin_place).alias("lo"), F.max(bin_place).alias("hi")).filter("hi > lo")
    change = lambda at, n: F.struct(at.alias("at"), F.lit(n).cast("long").alias("n"), F.lit(0).cast("long").alias("amount"))
    return _run_over_cuts(ends.select(F.inline(F.array(change(F.col("lo") + 1, 1), change(F.col("hi") + 1, -1))))).select("cut", "n")


def split_demand(units: DataFrame, street: str = "street", bin_place: str = "place", weight: str = "weight") -> DataFrame:
    """(cut, cost): the weight that a cut before a bin's place tears off, the smaller side of every street it runs through.
    A street changes the cost at its own places only. Changes are summed as decimals of twelve places, so that what a street
    adds it takes back without a rest."""
    bins = units.groupBy(street, bin_place).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(street)
    at = w.orderBy(bin_place)
    run = bins.withColumns({"_below": F.sum("_w").over(at.rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("_w").over(w), "_next": F.lead(bin_place).over(at)})
    run = run.filter("_total > 0 AND _next IS NOT NULL")
    torn = F.least("_below", F.col("_total") - F.col("_below")).cast("decimal(28,12)")
    change = lambda place, sign: F.struct(place.alias("at"), F.lit(sign).cast("long").alias("n"), (torn * sign).cast("decimal(28,12)").alias("amount"))
    cuts = _run_over_cuts(run.select(F.inline(F.array(change(F.col(bin_place) + 1, 1), change(F.col("_next") + 1, -1)))))
    return cuts.select("cut", F.col("amount").cast("double").alias("cost"))


def expected_cost(matrix: DataFrame, keys: list[str], value: str = "dist_m", weight: str = "weight") -> DataFrame:
    """Per unit the weighted mean over the origins that reach it, the worst of them, and how many do. Null if none, or if
    their weights sum up to 0 or less."""
    total = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return matrix.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).alias("expected"), F.max(value).alias("worst"), F.count(value).alias("reached"))


def fixed_mix(central: Column, other: Column, share: float = 0.85) -> Column:
    """share * central + (1 - share) * other; central alone where the other is missing. Not renormalised."""
    return F.when(other.isNull(), central).otherwise(central * share + other * (1 - share))


def band_balance(metrics: DataFrame, k: int) -> DataFrame:
    """One row: least and greatest share, their ratio, and how many of the k bands are empty."""
    out = metrics.agg(F.min("weight_share").alias("least"), F.max("weight_share").alias("greatest"), (F.lit(k) - F.count(F.lit(1))).alias("empty"))
    return out.select(F.when(F.col("empty") > 0, 0.0).otherwise(F.col("least")).alias("min_share"), F.col("greatest").alias("max_share"), F.when(F.col("empty") > 0, 0.0).otherwise(F.col("least") / F.col("greatest")).alias("balance"), "empty")


def split_streets(rows: DataFrame, street: list[str], number: str, weight: str) -> DataFrame:
    """Streets that lie in two bands or more: bands, units, weight, and whether no house number lies in two of them."""
    per = rows.groupBy(*street, number).agg(F.collect_set("band").alias("_b"), F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
    out = per.groupBy(*street).agg(F.size(F.array_distinct(F.flatten(F.collect_set("_b")))).alias("bands"), F.sum("_n").alias("units"), F.sum("_w").alias("weight"), F.bool_and(F.size("_b") == 1).alias("ranges_are_exact"))
    return out.filter("bands > 1")


def edge_shift(edges: DataFrame, baseline: DataFrame) -> DataFrame:
    """(model, max_abs_shift): how far the edges (model, band, edge) lie from those of the baseline (band, edge)."""
    both = edges.join(baseline.select("band", F.col("edge").alias("_base")), "band")
    return both.groupBy("model").agg(F.max(F.abs(F.col("edge") - F.col("_base"))).alias("max_abs_shift"))


def composite_score(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """candidates with score: the weighted sum of each measure's place between its least and greatest value (1 where all are
    equal). A measure with a negative weight counts the other way round."""
    w = Window.partitionBy(F.lit(0))  # as many rows as values of k are tried
    score = F.lit(0.0)
    for name, share in weights.items():
        low, high = F.min(name).over(w), F.max(name).over(w)
        place = F.when(high == low, 1.0).otherwise((F.col(name) - low) / (high - low))
        score = score + abs(share) * (place if share > 0 else F.when(high == low, 1.0).otherwise(1 - place))
    return candidates.withColumn("score", score)


def sweep(bins: DataFrame, ks: list[int], penalties: list[float], keys: list[str] | None = None, **rules) -> DataFrame:
    """band_table() for every k and penalty: (k, penalty, keys, band, ...). The bins meet the stated list of scenarios once, and
    each scenario is a group of its own."""
    cases = bins.sparkSession.createDataFrame([(k, float(p)) for k in ks for p in penalties], "k int, penalty double")
    every = bins.crossJoin(F.broadcast(cases))  # as many rows as scenarios were asked for
    return _banded(every, ["k", "penalty", *(keys or [])], lambda pdf: (int(pdf["k"].iloc[0]), {**rules, "penalty": float(pdf["penalty"].iloc[0])}))


def model_sweep(units: DataFrame, value: str, models: dict[str, Column], width: float, ks: list[int], penalty: float = 0.0, **rules) -> DataFrame:
    """(model, k, penalty, band, ...): bands of the same units under several models of their weight, for every k."""
    long = units.select(F.col(value).alias("_v"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), w.cast("double").alias("w")) for m, w in models.items()])).alias("_m"))
    bins = make_bins(long.select("_v", "_m.model", "_m.w"), F.col("_v"), F.col("w"), width, ["model"])
    return sweep(prefix_sums(bins, ["model"]), ks, [penalty], ["model"], **rules)


def control_drift(base: DataFrame, added: DataFrame, k: int, width: float, value: str = "value", weight: str = "weight") -> DataFrame:
    """(band, edge_without, edge_with, drift): edges recomputed without and with the added units."""
    edges = [band_table(make_bins(x, F.col(value), F.col(weight), width), k).select("band", F.col("edge").alias(n)) for x, n in ((base, "edge_without"), (base.unionByName(added), "edge_with"))]
    return edges[0].join(edges[1], "band", "full").withColumn("drift", F.col("edge_with") - F.col("edge_without"))


def house_ranges(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, ranges): house numbers in natural order, runs of plain numbers one or two apart written a-b, joined by ', '."""
    text = F.trim(F.col(number))
    nums = rows.filter(text != "").select(*keys, text.alias("t")).distinct()
    nums = nums.withColumns({"n": house_number_order(F.col("t"))["n"], "plain": F.col("t").rlike(r"^[0-9]+$") & (F.col("t").cast("decimal(38,0)") < 10**9)})
    w = Window.partitionBy(*keys).orderBy("n", "t")
    step = F.col("n") - F.lag("n").over(w)
    new = ~(F.col("plain") & F.coalesce(F.lag("plain").over(w), F.lit(False)) & F.coalesce(step.isin(1, 2), F.lit(False)))
    runs = nums.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("n", "t")
    parts = runs.groupBy(*keys, "run").agg(F.min_by("t", place).alias("a"), F.max_by("t", place).alias("b"), F.count(F.lit(1)).alias("c"))
    parts = parts.withColumn("part", F.when(F.col("c") == 1, F.col("a")).otherwise(F.concat_ws("-", "a", "b")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "part"))), lambda s: s["part"]), ", ").alias("ranges"))
