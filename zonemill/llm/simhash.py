"""SimHash near-duplicates found by anchor-point covering.

Two fingerprints that differ in at most three of 64 bits differ in at most one bit of their lower or of their upper half.
In each half the anchors are the code words of the Hamming code on 31 of its bits. That code has covering radius 1: every
value has exactly one code word within one bit, its home. A value at most one bit away lies within 1 + 1 bits of that home,
and at most 16 code words lie within two bits of any value. So each distinct fingerprint goes to those code words of both
halves, and is compared there over all 64 bits with what it meets. Anchors that many fingerprints reach are compared in
pairs of chunks, so that no group exceeds a fixed size; from a group only a forest of links leaves, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, map_arrow, unused
from .components import components

SEED, THRESHOLD = 42, 3
#: Fingerprints that an anchor may have before it is compared in chunks, and the size up to which groups are compared by shifting.
CHUNK, SMALL = 4096, 24


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles of a whole text, lower-cased in A-Z; 0 without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) < words:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.concatenate(([0], ends[: len(ends) - words])).tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every row. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            fps = np.array([fingerprint(text[i].as_py(), words) for i in range(len(text))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def anchors(fps: np.ndarray) -> np.ndarray:
    """The anchors of fingerprints, one row each: up to 16 code words in either half; -1 where there are fewer."""
    out = np.full((len(fps), 32), -1, np.int64)
    where = np.arange(1, 32)
    for half in (0, 1):
        x = ((fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        bits = (x[:, None] >> (where - 1)) & 1
        syndrome = np.bitwise_xor.reduce(np.where(bits == 1, where, 0), axis=1)
        one = np.concatenate(([0], 1 << np.arange(31)))
        out[:, 16 * half] = x ^ one[syndrome] | half << 31
        # Two flips i and j reach a code word if i xor j is the syndrome; each such pair is taken once, at its smaller end.
        mate = where[None, :] ^ syndrome[:, None]
        rows, cols = np.nonzero((mate > where[None, :]) & (syndrome[:, None] > 0))
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        words = x[rows] ^ one[where[cols]] ^ one[mate[rows, cols]]
        out[rows, 16 * half + 1 + nth] = words | half << 31
    return out


def _forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within a group that join all that its links join: a breadth-first forest."""
    left, links = fps, []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            parent = np.full(len(left), -1)
            for at in range(0, len(front), 256):
                open_ = np.flatnonzero(parent < 0)
                near = np.bitwise_count(front[at : at + 256, None] ^ left[open_]) <= THRESHOLD
                hit = near.any(axis=0)
                parent[open_[hit]] = at + near[:, hit].argmax(axis=0)
            met = parent >= 0
            links.append((left[met], front[parent[met]]))
            front, left = left[met], left[~met]
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp), sorted by key, to links. A group may run over several batches."""
    rest = (np.empty(0, np.int64), np.empty(0, np.uint64))

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        size = np.repeat(sizes, sizes)
        found = []
        few = np.flatnonzero((size > 1) & (size <= SMALL))
        k, f = key[few], fp[few]
        for shift in range(1, int(sizes[(sizes <= SMALL)].max(initial=1))):
            if len(k) <= shift:
                break
            hit = np.flatnonzero((k[shift:] == k[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= THRESHOLD))
            found.append((f[hit], f[hit + shift]))
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            found += _forest(np.unique(fp[s : s + n]))
        a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
        b = np.concatenate([y for _, y in found]) if found else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b).view(np.int64)), pa.array(np.minimum(a, b).view(np.int64))], ["a", "b"])

    for batch in batches:
        key = np.concatenate((rest[0], batch.column("key").to_numpy()))
        fp = np.concatenate((rest[1], batch.column("fp").to_numpy().view(np.uint64)))
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        rest = (key[cut:], fp[cut:])
        if cut:
            yield links(key[:cut], fp[:cut])
    if len(rest[0]):
        yield links(*rest)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all fingerprints at most THRESHOLD bits apart."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 8192):
                own = fps[at : at + 8192]
                all_ = anchors(own)
                on = all_ >= 0
                yield pa.RecordBatch.from_arrays([pa.array(all_[on]), pa.array(np.repeat(own, on.sum(axis=1)).view(np.int64))], ["anchor", "fp"])

    rows = map_arrow(distinct.select("fp"), spread, "anchor long, fp long")
    counts = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK)
    hot = keep(counts.select("anchor", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "hot-anchors")
    if hot.isEmpty():
        keyed = rows.select(F.col("anchor").alias("key"), "fp")
    else:
        rows = rows.join(hot, "anchor", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rows = rows.select("anchor", "fp", "chunks", F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
        split = F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other"))
        keyed = rows.select(F.when(F.col("chunks").isNull(), F.col("anchor")).otherwise(split).alias("key"), "fp")
    return map_arrow(keyed.repartition("key").sortWithinPartitions("key"), _compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links of at most THRESHOLD bits reach.
    A null or empty text has fingerprint zero, linked like any other. Repeated rows stay; an empty table gives an empty
    result; further columns are ignored."""
    prints = keep(fingerprints(docs, words), "fingerprints")
    classes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = keep(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = keep(rooted.join(keep(ids, "component-ids"), "root").select("fp", "component_id"), "fp-components")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs without those that are linked to a document with a smaller doc_id; of rows that repeat a doc_id one with the
    least key of its text stays, and rows without a doc_id all stay."""
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    _id, text = unused("_id", docs), unused("_key", docs)
    first = near_duplicates(docs, words).filter("doc_id = component_id").select("doc_id").distinct()
    first = first.join(docs.select(docs["doc_id"].cast("long").alias("doc_id"), key.alias("key")), "doc_id").groupBy("doc_id").agg(F.min("key").alias("key")).toDF(_id, text)
    one = docs.join(first, (docs["doc_id"].cast("long") == first[_id]) & (key == first[text]), "left_semi")
    return one.dropDuplicates(["doc_id"]).unionByName(docs.filter(docs["doc_id"].isNull()))
