"""Near-duplicates by the similarity of texts: sets of 5-word shingles whose Jaccard similarity is 0.8 or more.

Candidates come first from SimHash prints of the sets, found by anchor-point covering (simhash.py): sets whose prints links of at
most three bits join are a bucket. As most pairs at 0.8 differ in more bits, candidates also meet at bands of minima: BANDS bands of ROWS minima each, so a pair of similarity s meets in one with odds
1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8. Texts with equal sets are one node. Each bucket with two nodes or more gets their
sets, once for each different membership, and compares them exactly; from a bucket only a forest of links leaves. Buckets
with more than CHUNK nodes or CHUNK_SHINGLES shingles are compared in pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import forget, keep, map_arrow, unused
from .components import components

SEED, WORDS, BANDS, ROWS, CHUNK, CHUNK_SHINGLES = 42, 5, 20, 5, 2048, 1 << 20
#: Similarity from which texts are near-duplicates, as a fraction of whole numbers.
NUM, DEN = 4, 5
_DRAW = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The different hashes of a text's word shingles, sorted; a text with fewer words is one shingle, without words none."""
    tokens = (text or "").encode().lower().split()
    n = len(tokens) - WORDS + 1
    grams = [b" ".join(tokens[i : i + WORDS]) for i in range(n)] if n > 0 else [b" ".join(tokens)] * bool(tokens)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def bands(own: np.ndarray) -> np.ndarray:
    """The keys of a set's bands; none for an empty set, which is like no other."""
    if not len(own):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), 1024):
        x = own[at : at + 1024, None] * (_DRAW[0] | np.uint64(1)) + _DRAW[1]
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def print_of(own: np.ndarray) -> int:
    """The SimHash print of a set: a bit is 1 if set in over half of its hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 4096):
        ones += np.unpackbits(own[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def _forest(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all that exact comparison joins: a breadth-first forest."""
    size = np.array([len(s) for s in sets])
    flat, left, out = np.concatenate(sets), np.arange(len(nodes)), []
    ends = np.cumsum(size)
    front: list[int] = []
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
            continue
        at = front.pop()
        near = left[(DEN * np.minimum(size[left], size[at])) >= NUM * np.maximum(size[left], size[at])]
        if not len(near):
            continue
        part = np.concatenate([flat[ends[i] - size[i] : ends[i]] for i in near])
        own = sets[at]
        hit = own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[near]) - size[near])
        met = near[DEN * both >= NUM * (size[near] + size[at] - both)]
        out += [(nodes[at], nodes[i]) for i in met.tolist()]
        front += met.tolist()
        left = left[~np.isin(left, met)]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, own), sorted by key, to links. A bucket may run over several batches."""
    key, group = None, {}

    def links() -> pa.RecordBatch:
        found = _forest(list(group), list(group.values())) if len(group) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for k, node, own in zip(*(batch.column(i) for i in range(3)), strict=True):
            if (k := k.as_py()) != key:
                if len(group) > 1:
                    yield links()
                key, group = k, {}
            group[node.as_py()] = np.frombuffer(own.as_py(), np.uint64)
    yield links()


def links(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that join all candidates with similarity 0.8 or more, in a kept table. sketch: doc_id, node, size, print, bands."""
    nodes = sketch.groupBy("node").agg(*[f(c).alias(n) for f, c, n in ((F.min, "doc_id", "least"), (F.first, "size", "size"), (F.first, "print", "print"), (F.first, "bands", "bands"))])
    nodes = keep(nodes.filter("size > 0"), "near-nodes")
    # Sets whose prints the covering links are one more bucket; sets of one print are in it, linked or not.
    roots = components(simhash.links(keep(nodes.select(F.col("print").alias("fp")).distinct(), "near-prints")))
    joined = nodes.join(roots.withColumnsRenamed({"node": "print", "root": "_root"}), "print", "left")
    printed = joined.select("node", "least", "size", F.xxhash64(F.lit("print"), F.coalesce("_root", "print")).alias("band"))
    rows = keep(nodes.select("node", "least", "size", F.explode("bands").alias("band")).unionByName(printed), "near-bands")
    forget(nodes)
    buckets = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).filter("n > 1")
    # Buckets with the same members are compared once.
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("size") / CHUNK_SHINGLES)).cast("int")
    buckets = buckets.groupBy("n", "size", "who").agg(F.min("band").alias("band")).select("band", chunks.alias("chunks"))
    met = keep(rows.drop("size").join(buckets, "band"), "near-met")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    met_at = met.select("node", "band", "chunks", own.alias("own"), other.alias("other"))
    split = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))
    keyed = met_at.select("node", F.when(F.col("chunks") == 1, F.col("band")).otherwise(split).alias("key"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = [shingles(t) for t in batch.column("text").slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "own"])

    ids = met.select(F.col("least").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text")
    held = map_arrow(texts, sets, "node long, own binary", lean=True).dropDuplicates(["node"])
    held = keyed.join(held, "node").select("key", "node", "own")
    out = keep(map_arrow(held.repartition("key").sortWithinPartitions("key"), _compare, "a long, b long", lean=True), "near-links")
    for table in (rows, met):
        forget(table)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class of rows that links of similarity 0.8 or more join, the row with the smallest doc_id; of several rows with
    that doc_id the one with the least key of its text, and of rows equal in both any one. Rows without a doc_id all stay.
    Texts without words count as equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column("text")]
            cols = [[node_of(x) for x in found], [len(x) for x in found], [print_of(x) for x in found], [bands(x).tolist() for x in found]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "key", "node", "size", "print", "bands"])

    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    known = docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], key.alias("key"))
    sketch = keep(map_arrow(known, run, "doc_id long, key long, node long, size long, print long, bands array<long>", lean=True), "near-sketch")
    roots = components(links(known, sketch))
    classes = sketch.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("least")).join(roots, "node", "left")
    first = classes.groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("least"))
    _id, _key = unused("_id", docs), unused("_key", docs)
    first = keep(first.select("least.doc_id", "least.key").toDF(_id, _key), "near-first")
    one = docs.join(first, (docs["doc_id"].cast("long") == first[_id]) & (key == first[_key]), "left_semi")
    return one.withColumn(_key, key).dropDuplicates(["doc_id", _key]).drop(_key).unionByName(docs.filter(docs["doc_id"].isNull()))
