"""Quality rules whose cutoffs are chosen under risk control.

Each rule rejects a document whose measure lies above a cutoff. Labelled documents that no model was fitted on serve as
the holdout, each different text once, in two halves. In a stratum (language) the first half proposes sets of cutoffs, one for all rules, from
mild to strict: of each rule's cutoffs whose share of rejected good texts stays at or below a step of ``STEPS`` times
``alpha`` the one with the largest share of rejected bad texts less that of good ones, and none where that is not above 0. The second half has had no say in these, so it may test them in that order: a set is admitted while
the exact binomial (Clopper-Pearson) upper bound of the share of good texts that its rules together reject stays at or
below ``alpha``; the first failure ends the sequence, so trying many sets costs no error. The error ``delta`` is divided among the
strata (Bonferroni). With probability 1 - ``delta`` the rules together reject at most ``alpha`` of the good texts of every
stratum. Strata with too few labels to certify anything are pooled into one; where that has too few as well, nothing more
than the base rule rejects.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, keep, words_of

#: measure: cutoffs from the mildest to the strictest.
RULES = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "repeat_share": [0.19, 0.17, 0.15, 0.13, 0.11, 0.09, 0.07, 0.05],
    "mean_word": [30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0],
    "neg_mean_word": [-1.0, -1.5, -2.0, -2.5, -2.8, -3.0, -3.2],
}


#: Shares of alpha that the first half may lose by one rule, from mild to strict.
STEPS = [0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0]


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, a key of the text and the counts of every whole text. A null text has no words; a null stratum is ''."""
    text = F.coalesce(F.col("text"), F.lit(""))
    strata = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    lines = F.filter(F.split(F.col("t"), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(F.col("doc_id"), strata.alias("stratum"), text.alias("t"))
    base = base.select(
        "doc_id",
        "stratum",
        F.xxhash64("t").alias("text_key"),
        F.transform(words_of(F.col("t")), lambda w: F.xxhash64(w)).alias("hw"),
        (F.length("t") - F.regexp_count("t", F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    # Each step stands in a projection of its own: what a later one names more than once is computed once.
    n = F.size("hw")
    five = F.arrays_zip(F.col("hw"), *[F.slice("hw", k, F.greatest(n, F.lit(1))) for k in (2, 3, 4, 5)])
    base = base.select(
        "doc_id", "stratum", "text_key", "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 5, F.transform(F.slice(five, 1, F.greatest(n - 4, F.lit(1))), lambda z: F.xxhash64(z))).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    some = F.size(F.array_distinct("g")) < F.size("g")
    placed = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    base = base.withColumn("placed", F.when(some, placed)).drop("g")
    # Neighbours in hash order with equal hashes are windows found twice or more.
    twin = F.filter(F.arrays_zip(F.col("placed").alias("a"), F.slice("placed", 2, F.size("placed")).alias("b")), lambda z: z["a"]["h"] == z["b"]["h"])
    base = base.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.transform(twin, lambda z: F.array(z["a"]["p"], z["b"]["p"])))))).drop("placed")
    covered = F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    total = F.aggregate(covered, F.lit(0), lambda acc, x: acc + x)
    return base.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("at")


def _shares() -> dict[str, Column]:
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "mean_word": F.col("word_chars") / words,
        "neg_mean_word": -F.col("word_chars") / words,
    }


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact binomial upper bound: the largest p for which k or fewer of n are seen with probability above error."""
    if k >= n:
        return 1.0

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        most = max(logs)
        return math.exp(most) * math.fsum(math.exp(x - most) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and tail(mid) > error else (low, mid)
    return high


def labels_needed(strata: int, alpha: float, delta: float) -> int:
    """Good texts from which even none rejected certifies a limit of ``alpha``, with ``strata`` strata."""
    return math.ceil(math.log(max(1, strata) / delta) / -math.log1p(-alpha))


def pooled(sizes: dict[str, int], alpha: float, delta: float) -> tuple[list[str], int]:
    """The strata that stand alone, and the number of all that are tested, the pool of the others included. sizes: good
    texts of the second half. The fewer strata, the fewer labels are needed, so this goes round until it is settled."""
    strata = len(sizes)
    while True:
        need = labels_needed(strata, alpha, delta)
        alone = sorted(s for s, n in sizes.items() if n >= need)
        now = len(alone) + (sum(n for s, n in sizes.items() if s not in alone) >= need)
        if now >= strata:
            return alone, strata
        strata = now


def _proposed(row: dict, alpha: float) -> list[list[float | None]]:
    """The sets of cutoffs that the first half's counts propose, mild to strict; a rule without one has none."""
    sets = []
    for step in STEPS:
        chosen = []
        for rule, cutoffs in RULES.items():
            best, most = None, 0.0
            for i, c in enumerate(cutoffs):
                if row[f"{rule}_{i}"] > step * alpha * row["n"]:
                    break
                gain = row[f"bad_{rule}_{i}"] / max(1, row["n_bad"]) - row[f"{rule}_{i}"] / max(1, row["n"])
                if gain > most:
                    best, most = c, gain
            chosen.append(best)
        if chosen not in sets:
            sets.append(chosen)
    return sets


def _any_fails(share: dict[str, Column]) -> Column:
    fails = F.lit(False)
    for r in RULES:
        fails = fails | F.coalesce(share[r] > F.col(f"cut_{r}"), F.lit(False))
    return fails


def certified_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> list[tuple]:
    """(stratum, or None for the pool, and the certified cutoffs of all rules, None where there is none). labels: doc_id and quality (1 good, 0
    bad; null rows and contradicted documents count as unlabelled, and so do texts with both labels). What comes to the
    driver is one row of counts for each stratum with a labelled text, and for each set tested."""
    spark = measured.sparkSession
    known = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    share = _shares()
    counts = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_repeat_words"]
    texts = measured.filter(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("_id"))
    texts = texts.groupBy("stratum", "text_key", *counts).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo = hi and lo in (0, 1)")
    texts = keep(texts.withColumns({"second": F.pmod("text_key", F.lit(2)) == 1, "good": F.col("lo") == 1}).drop("lo", "hi"), "quality-holdout")
    sizes = {r["stratum"]: r["n"] for r in texts.filter("second and good").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    alone, strata = pooled(sizes, alpha, delta)
    if not strata:
        return []
    names = spark.createDataFrame([(s, s) for s in alone], "stratum string, own string")
    texts = texts.join(names, "stratum", "left").drop("stratum").withColumnRenamed("own", "stratum")
    hits = [F.count_if((share[r] > c) & (F.col("good") == yes)).alias(f"{name}{r}_{i}") for name, yes in (("", True), ("bad_", False)) for r, cs in RULES.items() for i, c in enumerate(cs)]
    first = texts.filter(~F.col("second")).groupBy("stratum").agg(F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("n_bad"), *hits).collect()
    sets = {s: [] for s in alone} | {row["stratum"]: _proposed(row.asDict(), alpha) for row in first}
    table = [(s, i, *cuts) for s, found in sets.items() for i, cuts in enumerate(found)]
    tried = spark.createDataFrame(table, "own string, step int, " + ", ".join(f"cut_{r} double" for r in RULES))
    met = texts.filter("second and good").join(tried, F.col("stratum").eqNullSafe(F.col("own")))
    tested = met.groupBy("own", "step").agg(F.count(F.lit(1)).alias("n"), F.count_if(_any_fails(share)).alias("k")).collect()
    lost = {(r["own"], r["step"]): (r["k"], r["n"]) for r in tested}
    chosen = []
    for s, found in sets.items():
        best = None
        for i, cuts in enumerate(found):
            if (s, i) not in lost or upper_bound(*lost[s, i], delta / strata) > alpha:
                break
            best = cuts
        chosen.append((s, best or [None] * len(RULES)))
    return chosen


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, stratum: str = "lang") -> DataFrame:
    """doc_id, the measures, base_failed, failed_rules, kept. One row for each row of docs; repeated rows are judged each.
    Empty tables give an empty result; without labels only the base rule rejects."""
    measured = measures(docs, stratum)
    measured = measured.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    measured = keep(measured, "quality")
    chosen = dict(certified_cutoffs(measured, labels, alpha, delta))
    pool = chosen.pop(None, [None] * len(RULES))
    # A stratum that stands alone but has nothing certified has a row without cutoffs, as the pool's do not hold for it.
    schema = "stratum string, own boolean, " + ", ".join(f"cut_{r} double" for r in RULES)
    cuts = docs.sparkSession.createDataFrame([(s, True, *found) for s, found in chosen.items()], schema)
    out, share = measured.join(cuts, "stratum", "left"), _shares()
    failed = []
    for r, c in zip(RULES, pool, strict=True):
        cut = F.when(F.col("own"), F.col(f"cut_{r}")).otherwise(F.lit(c).cast("double"))
        failed.append(F.when(share[r] > cut, F.lit(r)))
    out = out.withColumn("failed_rules", F.array_compact(F.array(*failed))).drop("own", "text_key", *[f"cut_{r}" for r in RULES])
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
