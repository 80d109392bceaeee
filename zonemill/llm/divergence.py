"""How far the sources of a language diverge in their terms, counted exactly behind a sketch.

First pass: every task adds the document frequencies of its terms to a count-min sketch and emits the cells it touched;
cells are summed by ranges, and of the merged sketch only one bit a cell is kept: has it reached ``min_docs``. A sketch never
underestimates, so a term with a cell below is below itself. Second pass: terms that cannot reach ``min_docs`` are dropped
before anything is shuffled; the others are counted exactly by language, source and term, and those whose exact frequency is
too small go. The sketch decides only what is shuffled, never what is kept.

With the counts, distances between sources are sparse sums. A kept term that a source does not have weighs the source's floor
p0, so the distance of two sources is that of their floors times the vocabulary, and corrections: of each source for its own
terms, from sums and from the few weights below the other's floor, and for terms that both have, from a join on the term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep, map_arrow

#: Weights are in parts of SCALE; SMOOTH is added to every count.
SCALE, SMOOTH = 1_000_000_000, 5
#: Rows of the sketch, ranges that a row is merged in, and the most bits of a row's width (a bitmap of 48 MB at most).
DEPTH, RANGES, MOST_BITS = 3, 64, 27
#: Terms that a task gathers before it emits, and bytes of a text that are split at once.
GATHER, CHUNK = 400_000, 1 << 22
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: What stays of a byte: letters, A-Z as a-z, and all bytes of code points from 0x80 on; any other byte parts terms.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of a bounded part of it each."""
    flat = text.translate(_LETTERS)
    at = 0
    while at < len(flat):
        end = flat.find(b" ", at + CHUNK) if len(flat) - at > CHUNK else -1
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def _hashes(lang: bytes, terms: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    """By row of the sketch the cells of hashes, rows one behind another."""
    at = (hashes[None, :] * _SPREAD[:, None]) >> np.uint64(64 - bits)
    return at.astype(np.int64) + (np.arange(DEPTH, dtype=np.int64) << bits)[:, None]


def sketch_bits(rows: int) -> int:
    """Width of the sketch for a table of so many rows: four cells a row, as a power of two."""
    return min(MOST_BITS, max(14, (4 * max(1, rows) - 1).bit_length()))


def _gathered(batches: Iterator[pa.RecordBatch], by_source: bool) -> Iterator[dict[tuple[bytes, bytes], tuple[Counter, Counter]]]:
    """Occurrences and documents of terms, by language and, if asked for, source; emitted whenever GATHER terms are held."""
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        lang, source, text = (batch.column(i).cast(pa.binary()) for i in range(3))
        for i in range(batch.num_rows):
            key = (lang[i].as_py(), source[i].as_py() if by_source else b"")
            n, d = held.setdefault(key, (Counter(), Counter()))
            before, own = len(d), set()
            for part in terms_of(text[i].as_py()):
                if by_source:
                    n.update(part)
                own.update(part)
            d.update(own)
            size += len(d) - before
            if size >= GATHER:
                yield held
                held, size = {}, 0
    if held:
        yield held


def _partial_cells(bits: int):
    """Sums of touched cells, one row for each range that is touched."""
    width = 1 << bits
    step = width // RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, by_source=False):
            at, add = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for (lang, _), (_, d) in held.items():
                at.append(cells(_hashes(lang, list(d)), bits).ravel())
                add.append(np.tile(np.fromiter(d.values(), np.int64, len(d)), DEPTH))
            cell, back = np.unique(np.concatenate(at), return_inverse=True)
            total = np.minimum(np.bincount(back, np.concatenate(add), len(cell)), 2**31 - 1).astype("<u4")
            cuts = np.searchsorted(cell, np.arange(DEPTH * RANGES + 1) * step)
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()),
                    pa.array([(cell[cuts[r] : cuts[r + 1]] - r * step).astype("<u4").tobytes() for r in some], pa.binary()),
                    pa.array([total[cuts[r] : cuts[r + 1]].tobytes() for r in some], pa.binary()),
                ],
                ["range", "cells", "sums"],
            )

    return run


def _merged_bits(bits: int, min_docs: int):
    """Rows of one range follow one another; of their sum one bit a cell goes on."""
    step = (1 << bits) // RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= min_docs).tobytes()], pa.binary())], ["range", "bits"])

        for batch in batches:
            for r, at, add in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if r != now:
                    if now is not None:
                        yield done()
                    now, total = r, np.zeros(step, np.int64)
                total[np.frombuffer(at, "<u4")] += np.frombuffer(add, "<u4")
        if now is not None:
            yield done()

    return run


def _named(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), empty("text"))


def possible_terms(docs: DataFrame, min_docs: int, bits: int) -> np.ndarray:
    """The merged sketch as one bit a cell, packed. DEPTH * 2**bits / 8 bytes come to the driver, whatever the input."""
    part = map_arrow(_named(docs), _partial_cells(bits), "range int, cells binary, sums binary")
    part = part.repartition(F.col("range")).sortWithinPartitions("range")
    step = (1 << bits) // RANGES // 8
    out = np.zeros(DEPTH * RANGES * step, np.uint8)
    for r in map_arrow(part, _merged_bits(bits, min_docs), "range int, bits binary").toLocalIterator():
        out[r["range"] * step : (r["range"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out


def exact_counts(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term that may be in ``min_docs`` documents of its
    language, among them all that are."""
    spark = docs.sparkSession
    bits = sketch_bits(docs.count())
    possible = spark.sparkContext.broadcast(possible_terms(docs, min_docs, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = possible.value
        for held in _gathered(batches, by_source=True):
            for (lang, source), (n, d) in held.items():
                terms = list(d)
                at = cells(_hashes(lang, terms), bits)
                may = ((seen[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
                terms = [terms[i] for i in np.flatnonzero(may)]
                if terms:
                    names = [pa.array([x] * len(terms), pa.binary()).cast(pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays(
                        [*names, pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([d[t] for t in terms], pa.int64())],
                        ["lang", "source", "term", "n", "docs"],
                    )

    part = map_arrow(_named(docs), run, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _weight(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * vocabulary)), in decimals, so exact for any 64-bit counts."""
    over = f"cast({SCALE} as decimal(11,0)) * cast({n} + {SMOOTH} as decimal(20,0))"
    return F.expr(f"1 + ({over}) div cast({total} + {SMOOTH} * vocabulary as decimal(20,0))")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """Returns lang, source, part, item, value, rank for each language and source that occurs.

    Part ``pair``: every other source of the language and the summed differences of all kept terms' weights (0 where the
    language keeps none). Part ``term``: of the terms that the source has and whose weight lies above the language's the
    ``top`` with the largest difference. Ranks run from 1 by value, then item in UTF-8 order. Null text, lang and source
    are ''; repeated rows are documents each; doc_id and further columns are not read. An empty table gives an empty result.
    """
    counts = keep(exact_counts(docs, min_docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs")).filter(F.col("lang_docs") >= min_docs)
    rows = keep(counts.join(kept.drop("lang_docs"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    forget(counts)

    # One row for each group, with its language's vocabulary and the floor: the weight of a kept term that it does not have.
    languages = rows.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("lang_total"))
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    groups = _named(docs).select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.na.fill(0).withColumn("floor", F.when(F.col("vocabulary") > 0, _weight("0", "total")))
    groups = keep(groups, "term-groups")
    priced = rows.join(groups, ["lang", "source"]).withColumns({"p": _weight("n", "total"), "q": _weight("lang_n", "lang_total")})
    priced = keep(priced.select("lang", "source", "term", "p", "q", "floor"), "term-weights")
    forget(rows)

    over = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = _pairs(groups, priced).withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(pairs.select(*ranked.columns))


def _pairs(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of all ordered pairs of sources of a language."""
    left = priced.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("floor").alias("fa"))
    right = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("floor").alias("fb"))
    change = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("fb")) - F.abs(F.col("fa") - F.col("pb")) + F.abs(F.col("fa") - F.col("fb"))
    shared = left.join(right, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(change).alias("shared"))

    # A source's own terms against another's floor: sums, and twice what lies below it. No weight is below the own floor, so
    # only weights under the language's highest floor can, and of those there are as many values as counts so small.
    sums = priced.groupBy("lang", "source").agg(F.sum("p").alias("sum_p"))
    highest = groups.groupBy("lang").agg(F.max("floor").alias("highest"))
    few = priced.join(highest, "lang").filter("p < highest").groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    floors = groups.select("lang", F.col("source").alias("item"), "floor").filter("floor IS NOT NULL")
    below = few.join(floors, "lang").filter("p < floor AND source <> item").groupBy("lang", "source", "item").agg(F.sum(2 * F.col("n") * (F.col("floor") - F.col("p"))).alias("below"))

    one = groups.join(sums, ["lang", "source"], "left").select("lang", "source", "terms", "vocabulary", "floor", F.coalesce("sum_p", F.lit(0)).alias("sum_p"))
    other = one.select("lang", F.col("source").alias("item"), F.col("terms").alias("terms_"), F.col("floor").alias("floor_"), F.col("sum_p").alias("sum_p_"))
    both = one.join(other, "lang").filter("source <> item")
    both = both.join(below, ["lang", "source", "item"], "left")
    both = both.join(below.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("below").alias("below_")), ["lang", "source", "item"], "left")
    both = both.withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")}).join(shared, ["lang", "a", "b"], "left")
    apart = F.abs(F.col("floor") - F.col("floor_"))
    value = F.col("vocabulary") * apart + F.coalesce("shared", F.lit(0))
    value += F.col("sum_p") - F.col("terms") * F.col("floor_") + F.coalesce("below", F.lit(0)) - F.col("terms") * apart
    value += F.col("sum_p_") - F.col("terms_") * F.col("floor") + F.coalesce("below_", F.lit(0)) - F.col("terms_") * apart
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(value, F.lit(0)).cast("long").alias("value"))
