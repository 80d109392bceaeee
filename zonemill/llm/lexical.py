"""Ranked lexical search over an index that recursive graph bisection has put in order.

Documents and the terms asked for form a bipartite graph. Recursive bisection halves the documents again and again and swaps
documents between the halves of a node while that lowers the log-gap cost of the terms' posting lists, so documents with the same terms
come to lie together. It is fitted on a bounded sample; every document is then led down the tree, at each node to the side
where its terms are cheaper. Leaves in tree order are the new order of the documents. Stretches of a leaf of at most ``rows``
documents are the shards of the index; each holds postings with integer impacts and, per term, its largest impact.

A shard's bound for an item is the sum of its largest impacts times the terms' weights. The best shards of every item are
visited first and give a k-th score; then the shards whose bound is below it are left out for good, and the others are
visited from high bounds to low, every task raising its items' k-th scores as it goes and stopping where no bound reaches
them. A bound that equals the k-th score is visited, as a smaller doc_id would win the tie; scores are those of the whole
text whatever the order, so the result is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep, map_arrow

#: What stays of a byte: letters, A-Z as a-z, digits, and all bytes of code points from 0x80 on; any other byte parts terms.
_WORD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
CHUNK = 1 << 22
#: Items that are searched at once, and bytes of their texts.
ITEMS, ITEM_BYTES = 1024, 1 << 23
#: Postings that a shard holds besides its limit of documents.
POSTINGS = 1 << 20
#: Shards of each item that are visited first.
FIRST = 2


def term_counts(text: bytes) -> Counter:
    """Terms of a whole text and how often they occur."""
    flat, counts, at = text.translate(_WORD), Counter(), 0
    while at < len(flat):
        end = flat.find(b" ", at + CHUNK) if len(flat) - at > CHUNK else -1
        end = len(flat) if end < 0 else end
        counts.update(flat[at:end].split())
        at = end
    return counts


# --- order of the documents -------------------------------------------------------------------------------------------


def _cost(degree: np.ndarray, size: int) -> np.ndarray:
    """Log-gap cost of a term's postings: degree times the log of the mean gap."""
    return degree * np.log2(max(size, 1) / (degree + 1.0))


def _halves(docs: list[np.ndarray], members: np.ndarray, n_terms: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splits the members of a node; also gives each term's advantage of the left half over the right."""
    half = len(members) // 2
    side = np.arange(len(members)) >= half
    terms = np.concatenate([docs[i] for i in members])
    lens = np.array([len(docs[i]) for i in members])
    starts, owner = np.cumsum(lens) - lens, np.repeat(np.arange(len(members)), lens)
    for _ in range(rounds):
        right = np.bincount(terms[side[owner]], minlength=n_terms).astype(float)
        left = np.bincount(terms[~side[owner]], minlength=n_terms).astype(float)
        n_left, n_right = half, len(members) - half
        now = _cost(left, n_left) + _cost(right, n_right)
        to_right = now - _cost(np.maximum(left - 1, 0), n_left) - _cost(right + 1, n_right)
        to_left = now - _cost(left + 1, n_left) - _cost(np.maximum(right - 1, 0), n_right)
        gain = np.add.reduceat(np.where(side[owner], to_left[terms], to_right[terms]), starts)
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        swap = np.flatnonzero(gain[a[:n]] + gain[b[:n]] > 1e-9)
        if not len(swap):
            break
        side[a[swap]], side[b[swap]] = True, False
    right = np.bincount(terms[side[owner]], minlength=n_terms)
    left = np.bincount(terms[~side[owner]], minlength=n_terms)
    better = np.log2((left + 1) / max(1, half)) - np.log2((right + 1) / max(1, len(members) - half))
    return members[~side], members[side], better.astype(np.float32)


@dataclass
class Order:
    """A tree of bisections: per inner node, in heap order, each term's advantage of the left side; and the depth."""

    better: np.ndarray
    depth: int

    def leaves(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The leaf of each document, its terms being terms[starts[i]:starts[i + 1]], at least one each."""
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        node = np.zeros(len(starts) - 1, np.int64)
        for _ in range(self.depth):
            pull = np.add.reduceat(self.better[node[owner], terms], starts[:-1]) if len(node) else node
            node = 2 * node + 1 + (pull < 0)
        return node - (1 << self.depth) + 1


def bisect(docs: list[np.ndarray], n_terms: int, depth: int = 6, rounds: int = 12) -> Order:
    """Recursive graph bisection of documents, each a non-empty array of different terms."""
    nodes = [np.arange(len(docs))]
    better = np.zeros(((1 << depth) - 1, n_terms), np.float32)
    for n in range(len(better)):
        members = nodes[n]
        if len(members) < 2:
            nodes += [members, members[:0]]
            continue
        left, right, better[n] = _halves(docs, members, n_terms, rounds)
        nodes += [left, right]
    return Order(better, depth)


# --- index ------------------------------------------------------------------------------------------------------------


@dataclass
class Asked:
    """A block of items: ids, and their terms' numbers and weights, item by item. None of it grows with the documents."""

    ids: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    n_terms: int


def _lists(values: list[np.ndarray] | np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    flat = np.concatenate(values) if isinstance(values, list) else values
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32)))


def _forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and of the terms asked for the numbers and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                n, terms, often, offsets = [], [], [], [0]
                for text in part.column(1).cast(pa.binary()):
                    counts = term_counts(text.as_py() or b"")
                    n.append(counts.total())
                    known = sorted((vocabulary[t], c) for t, c in counts.items() if t in vocabulary)
                    terms += [t for t, _ in known]
                    often += [c for _, c in known]
                    offsets.append(len(terms))
                cols = [part.column(0), pa.array(n, pa.int64()), _lists(np.array(terms, np.int32), offsets), _lists(np.array(often, np.int32), offsets)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "terms", "often"])

    shown = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return map_arrow(shown, run, "doc_id long, n long, terms array<int>, often array<int>")


def _flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = col.offsets.to_numpy()
    return col.values.to_numpy()[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _index(posted: DataFrame, order: Order, lanes: np.ndarray, rows: int) -> DataFrame:
    """The shards: shard, ids, starts, terms, impacts, and the largest impact of each term. posted: doc_id, m, terms, often;
    lanes: how many parts each leaf is dealt in."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            (terms, starts), (often, _) = _flat(batch.column(2)), _flat(batch.column(3))
            leaf = order.leaves(terms, starts)
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            f, per = often.astype(np.int64), np.repeat(m, np.diff(starts))
            impacts = (1_000_000_000 * f) // (1000 * f + 8 * per)
            cols = [pa.array(leaf, pa.int32()), pa.array((mixed % lanes[leaf].astype(np.uint64)).astype(np.int32)), batch.column(0), _lists(terms, starts), _lists(impacts, starts)]
            yield pa.RecordBatch.from_arrays(cols, ["leaf", "lane", "doc_id", "terms", "impacts"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, serial, ids, held = None, 0, [], []
        size = 0

        def shard() -> pa.RecordBatch:
            terms, impacts = np.concatenate([t for t, _ in held]), np.concatenate([i for _, i in held])
            lens = [len(t) for t, _ in held]
            by = np.argsort(terms, kind="stable")
            first = np.flatnonzero(np.diff(terms[by], prepend=-1))
            most = np.maximum.reduceat(impacts[by], first)
            number = (where[0] << 48) + (where[1] << 24) + serial
            data = [np.array(ids, "<i8"), np.cumsum([0, *lens[:-1]]).astype("<i8"), terms.astype("<i4"), impacts.astype("<i4"), terms[by][first].astype("<i4"), most.astype("<i4")]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in data)], _SHARD)

        for batch in batches:
            leaf, lane, doc = (batch.column(i).to_pylist() for i in range(3))
            (terms, starts), (impacts, _) = _flat(batch.column(3)), _flat(batch.column(4))
            for i in range(batch.num_rows):
                if held and (where != (leaf[i], lane[i]) or len(ids) >= rows or size >= POSTINGS):
                    yield shard()
                    serial = serial + 1 if where == (leaf[i], lane[i]) else 0
                    ids, held, size = [], [], 0
                where = (leaf[i], lane[i])
                ids.append(doc[i])
                held.append((terms[starts[i] : starts[i + 1]].copy(), impacts[starts[i] : starts[i + 1]].copy()))
                size += len(held[-1][0])
        if held:
            yield shard()

    routed = map_arrow(posted, route, "leaf int, lane int, doc_id long, terms array<int>, impacts array<int>")
    dealt = routed.repartition("leaf", "lane").sortWithinPartitions("leaf", "lane")
    return map_arrow(dealt, pack, "shard long, " + ", ".join(f"{c} binary" for c in _SHARD[1:]))


_SHARD = ["shard", "ids", "starts", "terms", "impacts", "top_terms", "top_impacts"]


def _bounds(index: DataFrame, asked: Asked) -> DataFrame:
    """(item, shard, bound) of every item and shard that share a term; items by their place in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(asked.n_terms, np.int64)
        for batch in batches:
            for shard, terms, impacts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                terms = np.frombuffer(terms, "<i4")
                top[terms] = np.frombuffer(impacts, "<i4")
                bound = np.add.reduceat(top[asked.terms] * asked.weights, asked.starts[:-1])
                top[terms] = 0
                some = np.flatnonzero(bound > 0)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), shard)), pa.array(bound[some])], ["item", "shard", "bound"])

    return map_arrow(index.select("shard", "top_terms", "top_impacts"), run, "item int, shard long, bound long")


# --- search -----------------------------------------------------------------------------------------------------------


def _visit(index: DataFrame, visits: DataFrame, asked: Asked, floor: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): of each task the k best documents of every item in the shards that it visits. floor: the scores
    that count at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = floor.copy()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        weight = np.zeros(asked.n_terms, np.int64)
        for batch in batches:
            for n in range(batch.num_rows):
                ids, starts, terms, impacts = (np.frombuffer(batch.column(i)[n].as_py(), kind) for i, kind in ((1, "<i8"), (2, "<i8"), (3, "<i4"), (4, "<i4")))
                impacts = impacts.astype(np.int64)
                for at in batch.column(5)[n].as_py():
                    item = at["item"]
                    if at["bound"] < least[item]:
                        continue
                    own = slice(asked.starts[item], asked.starts[item + 1])
                    weight[asked.terms[own]] = asked.weights[own]
                    score = np.add.reduceat(weight[terms] * impacts, starts)
                    weight[asked.terms[own]] = 0
                    hit = np.flatnonzero(score >= least[item])
                    if len(hit):
                        had = best.get(item, (np.empty(0, np.int64), np.empty(0, np.int64)))
                        s, d = np.concatenate((had[0], score[hit])), np.concatenate((had[1], ids[hit]))
                        top = np.lexsort((d, -s))[:k]
                        best[item] = (s[top], d[top])
                        if len(top) == k:
                            least[item] = max(least[item], s[top[-1]])
        for item, (s, d) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), item), pa.int32()), pa.array(d), pa.array(s)], ["item", "doc_id", "score"])

    # At most as many items as a block has meet in a row.
    lists = visits.groupBy("shard").agg(F.collect_list(F.struct("item", "bound")).alias("asks"), F.max("bound").alias("most"))
    met = index.select("shard", "ids", "starts", "terms", "impacts").join(lists, "shard").select("shard", "ids", "starts", "terms", "impacts", "asks", "most")
    return map_arrow(met.sortWithinPartitions(F.desc("most")), run, "item int, doc_id long, score long")


def _item_blocks(items: DataFrame) -> Iterator[dict[int, set[bytes]]]:
    """Items as sets of terms, in blocks of bounded size; rows with one item_id are one item."""
    block: dict[int, set[bytes]] = {}
    size = 0
    for row in items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).filter("i IS NOT NULL").orderBy("i").toLocalIterator():
        text = (row["t"] or "").encode()
        if row["i"] not in block and block and (len(block) >= ITEMS or size + len(text) > ITEM_BYTES):
            yield block
            block, size = {}, 0
        block.setdefault(row["i"], set()).update(term_counts(text))
        size += len(text)
    if block:
        yield block


def _weights(found: dict[int, int], n_docs: int) -> dict[int, int]:
    """A term's weight: floor(1000 * ln((2 N + 2) / (2 df + 1)))."""
    return {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in found.items()}


def _search_block(docs: DataFrame, block: dict[int, set[bytes]], k: int, rows: int, sample: int) -> tuple[DataFrame, np.ndarray] | None:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*block.values())))}
    if not vocabulary:
        return None
    forward = keep(_forward(docs, vocabulary), "forward")
    n_docs, n_all = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = {r["term"]: r["count"] for r in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = _weights(found, n_docs)
    lists = [(i, sorted(vocabulary[t] for t in terms if weights.get(vocabulary[t], 0) > 0)) for i, terms in block.items()]
    lists = [(i, x) for i, x in lists if x]
    if not lists:
        return None
    flat = np.array([t for _, x in lists for t in x], np.int64)
    asked = Asked(np.array([i for i, _ in lists], np.int64), np.cumsum([0, *(len(x) for _, x in lists)]), flat, np.array([weights[t] for t in flat.tolist()], np.int64), len(vocabulary))

    shown = forward.filter("doc_id IS NOT NULL AND size(terms) > 0")
    total = shown.count()
    ids = [r["doc_id"] for r in shown.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    picked = spark.createDataFrame([(i,) for i in ids], "_id long")  # ``sample`` rows at most
    taken = shown.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min("terms").alias("terms")).orderBy("_id").collect()
    drawn = [np.array(r["terms"], np.int64) for r in taken]
    order = bisect(drawn, len(vocabulary))
    # A leaf is dealt in parts by its share of the sample, so that one with a third of all rows is packed by many tasks.
    held = np.bincount(order.leaves(np.concatenate(drawn), np.cumsum([0, *map(len, drawn)])), minlength=1 << order.depth)
    lanes = np.clip(-(-held * total // (len(drawn) * rows)), 1, 1 << 20)

    posted = shown.withColumn("m", F.expr(f"10 + (cast(90 as decimal(3,0)) * cast(n as decimal(17,0)) * cast({n_docs} as decimal(17,0))) div cast({n_all} as decimal(20,0))"))
    index = keep(_index(posted.select("doc_id", "m", "terms", "often"), order, lanes, rows), "shards")
    forget(forward)
    bounds = keep(_bounds(index, asked), "bounds")

    by_bound = Window.partitionBy("item").orderBy(F.col("bound").desc(), "shard")
    first = bounds.withColumn("nth", F.row_number().over(by_bound)).filter(F.col("nth") <= FIRST).drop("nth")
    least = np.ones(len(lists), np.int64)
    early = keep(_visit(index, first, asked, least, k), "first-found")
    nth = early.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))).filter(F.col("nth") == k)
    reached = [(r["item"], r["score"]) for r in nth.select("item", "score").collect()]  # one row an item of the block
    for item, score in reached:
        least[item] = score
    floors = spark.createDataFrame([(n, int(x)) for n, x in enumerate(least)], "item int, least long")
    left = bounds.join(F.broadcast(floors), "item").filter("bound >= least").join(first.select("item", "shard"), ["item", "shard"], "left_anti")
    late = _visit(index, left.select("item", "shard", "bound"), asked, least, k)
    return early.unionByName(late), asked.ids


def search(docs: DataFrame, items: DataFrame, k: int = 10, rows: int = 1024, sample: int = 4096) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k highest-scoring documents of every item, ties to the smaller doc_id.

    docs: doc_id, text; items: item_id, text; further columns are ignored. A null text has no terms. Rows of docs that repeat
    are documents each. A document with a null doc_id counts in all statistics but is not returned, as nothing names it. Rows
    of items with one item_id are one item; those with a null item_id are none. Only scores above 0 are returned, so an item without
    known terms, an empty table of items or of documents give no rows. Items are searched in blocks of ITEMS.
    """
    spark, out = docs.sparkSession, []
    for block in _item_blocks(items):
        met = _search_block(docs, block, k, rows, sample)
        if met:
            found, ids = met
            names = spark.createDataFrame([(n, int(i)) for n, i in enumerate(ids)], "item int, item_id long")
            order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
            ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            out.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
