"""Exact top-k by inner product with multi-resolution segment statistics.

Bounds are taken on rotated vectors: an orthogonal transform, fitted on a bounded sample, that puts the directions of most
energy first; it changes no inner product, and every row is rotated. A rotated vector is cut into segments, coarse to
fine: a head of single components, and behind it segments that double in width. For a segment of m components with means
a, b and deviations s, t of query and candidate, the squared distance is at least m((a - b)^2 + (s - t)^2); so, as the
squared distance is the two squared lengths less twice the inner product, the inner product is at most the sum of
m(ab + st). Candidates whose bound falls below a query's k-th score so far are dropped, resolution by resolution; the survivors'
scores are computed exactly from the vectors as they are. A candidate that survives for none of the queries at hand leaves
all later products.

Queries and candidates stand in blocks, in a grid of groups. A block of candidates is sent once for each group of queries, a block of
queries once for each group of candidates, and a task holds the queries of one group while candidates stream by; what
leaves is the k best of each query for each group of candidates. No side is broadcast, and no pairs are built in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, map_arrow

#: Single components at the head, coarse to fine.
HEADS = (0, 4, 16, 48)
#: Queries that meet a block of candidates at once, blocks of queries in a group, and rows that the rotation is fitted on.
FEW, GROUP, SAMPLE = 64, 32, 4096
WHOLE = 2.0**53


def segments(dim: int, head: int) -> np.ndarray:
    """Where the segments begin, and at last ``dim``."""
    cuts, width = list(range(min(head, dim))), max(1, head)
    at = len(cuts)
    if head == 0:
        return np.array([0, dim])
    while at < dim:
        cuts.append(at)
        at, width = at + width, 2 * width
    return np.array([*cuts, dim])


def summaries(x: np.ndarray, head: int) -> np.ndarray:
    """Per vector the segments' means and deviations, scaled so that products of two rows are the upper bounds. Segments of
    one component have no deviation."""
    cuts = segments(x.shape[1], head)
    m = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / m
    wide = m > 1
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)[:, wide] / m[wide]
    spread = np.sqrt(np.maximum(square - np.square(mean[:, wide]), 0))
    return np.concatenate((mean * np.sqrt(m), spread * np.sqrt(m[wide])), axis=1)


def rotation(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix whose columns are the sample's principal directions, strongest first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


def exact(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products of all queries (rows) with all candidates (columns)."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if most < WHOLE:  # whole numbers below 2**53: exact in any order
        return (queries @ candidates.T).astype(np.int64)
    wholes = [[int(b) for b in c] for c in candidates.tolist()]
    out = [[sum(int(a) * b for a, b in zip(q, c, strict=True)) for c in wholes] for q in queries.tolist()]
    return np.array([[min(max(w, -(2**63)), 2**63 - 1) for w in row] for row in out], np.int64).reshape(len(queries), len(candidates))


class Best:
    """The k best candidates of each query of a block so far; ``met`` counts the pairs that reach each resolution, and at last
    those scored exactly."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, turn: np.ndarray):
        self.ids, self.vectors, self.k, self.turn = ids, vectors, k, turn
        rotated = vectors @ turn
        self.levels = [summaries(rotated, h) for h in HEADS]
        self.length = np.linalg.norm(vectors, axis=1).max(initial=0)
        self.score = np.full((len(ids), k), -(2**63), np.int64)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.filled = np.zeros((len(ids), k), bool)
        self.met = np.zeros(len(HEADS) + 1, np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, own: list[np.ndarray]) -> None:
        """Meets a block of candidates with its summaries, a few queries at a time, so that no array outgrows their pairs."""
        slack = 1e-9 * (1 + self.length * np.linalg.norm(vectors, axis=1).max(initial=0))
        for a in range(0, len(self.ids), FEW):
            rows = np.arange(a, min(a + FEW, len(self.ids)))
            if not self.filled[rows, -1].all():
                # The most promising by a middle resolution first: their scores give a k-th one.
                bound = self.levels[len(HEADS) // 2][rows] @ own[len(HEADS) // 2].T
                few = min(2 * self.k, len(ids))
                first = np.unique(np.argpartition(-bound, few - 1, axis=1)[:, :few])
                self._meet(rows, first, np.ones((len(rows), len(first)), bool), ids, vectors)
            floor = np.where(self.filled[rows, -1], self.score[rows, -1].astype(np.float64), -np.inf) - slack
            cols = np.arange(len(ids))
            on = np.ones((len(rows), len(ids)), bool)
            for n, (level, mine) in enumerate(zip(self.levels, own, strict=True)):
                self.met[n] += np.count_nonzero(on)
                on &= level[rows] @ (mine if len(cols) == len(ids) else mine[cols]).T >= floor[:, None]
                some = on.any(axis=0)
                if not some.all():
                    cols, on = cols[some], on[:, some]
                if not len(cols):
                    break
            self.met[-1] += np.count_nonzero(on)
            self._meet(rows, cols, on, ids, vectors)

    def _meet(self, rows: np.ndarray, cols: np.ndarray, on: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Exact scores of the pairs of ``on`` (place in rows, place in cols), merged into the best."""
        if not len(cols):
            return
        scores = exact(self.vectors[rows], vectors[cols])
        # A pair counts if it may stand among the best; equal scores may, as the smaller vec_id wins.
        floor = np.where(self.filled[rows, -1], self.score[rows, -1], -(2**63))
        q, c = np.nonzero(on & (scores >= floor[:, None]) & (self.ids[rows][:, None] != ids[cols][None, :]))
        if not len(q):
            return
        score, vec = scores[q, c], ids[cols[c]]
        old = np.nonzero(self.filled[rows])
        q = np.concatenate((old[0], q))
        score, vec = np.concatenate((self.score[rows][old], score)), np.concatenate((self.vec[rows][old], vec))
        order = np.lexsort((vec, ~score, q))  # ~ turns the order without leaving 64 bits
        q, score, vec = q[order], score[order], vec[order]
        # A pair met before, as one of the most promising, counts once.
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (vec[1:] != vec[:-1]) | (score[1:] != score[:-1])))
        q, score, vec = q[new], score[new], vec[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.filled[rows] = False
        at = (rows[q[top]], rank[top])
        self.score[at], self.vec[at], self.filled[at] = score[top], vec[top], True


def _blocked(vectors: DataFrame, rows: int, dealt: int) -> DataFrame:
    """(dim, block, part, ids, data): vectors of one length in blocks of at most ``rows``, int64 ids and float64 components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = 0
        for batch in batches:
            col, ids = batch.column("v"), batch.column("vec_id").to_numpy()
            lens = np.diff(col.offsets.to_numpy())
            flat, begin = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()[:-1]
            for dim in np.unique(lens).tolist():
                at = np.flatnonzero(lens == dim)
                for a in range(0, len(at), rows):
                    part = at[a : a + rows]
                    data = flat[begin[part][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([serial], pa.int32()), pa.array([ids[part].astype("<i8").tobytes()]), pa.array([data.astype("<f8").tobytes()])],
                        ["dim", "serial", "ids", "data"],
                    )
                    serial += 1

    out = map_arrow(vectors.repartition(dealt, "vec_id"), run, "dim int, serial int, ids binary, data binary")
    return out.withColumns({"part": F.spark_partition_id(), "block": F.xxhash64(F.spark_partition_id(), "serial", "ids")})


def _sample(good: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """For each length the rotation of the ``rows`` vectors with the least hash of vec_id; of at most 16 lengths, others are
    not rotated."""
    lengths = [r[0] for r in good.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").limit(16).collect()]
    out = {}
    for dim in lengths:
        found = good.filter(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("v").collect()
        out[dim] = rotation(np.array([r[0] for r in found]))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, query_rows: int = 2048, rows: int = 4096) -> DataFrame:
    """vectors: vec_id and v (array<double> of whole numbers). Returns query_id, rank (from 1), vec_id, score of the k best
    other rows of each query, ties to the smaller vec_id; fewer than k if there are fewer. Vectors of different lengths
    do not meet. Rows that are null, empty or hold null or non-finite components take no part; an empty table gives an empty
    result. Rows with one vec_id count as one query: their results are merged, and none of them is its candidate; of equal rows of a
    candidate one counts. Further columns, whatever their names, are ignored."""
    good = vectors.filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    good = good.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    good = keep(good, "vectors")
    asked = good.filter(is_query)
    n, n_asked = good.count(), asked.count()
    turns = _sample(good, SAMPLE)
    parts, asked_parts = max(1, -(-n // rows)), max(1, -(-n_asked // query_rows))
    groups = -(-asked_parts // GROUP)
    spread = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lanes = max(-(-spread // groups), -(-parts // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in ("dim", "group", "lane", "asks", "ids", "data")}
                if (r["dim"], r["group"], r["lane"]) != cell:
                    yield from map(_rows, best)
                    cell, best = (r["dim"], r["group"], r["lane"]), []
                ids, data = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["data"], "<f8").reshape(-1, r["dim"])
                turn = turns.get(r["dim"])
                turn = np.eye(r["dim"]) if turn is None else turn
                if r["asks"] == 0:
                    best.append(Best(ids, data, k, turn))
                else:
                    rotated = data @ turn
                    own = [summaries(rotated, h) for h in HEADS]
                    for b in best:
                        b.add(ids, data, own)
        yield from map(_rows, best)

    columns = ("dim", "group", "lane", "asks", "ids", "data")
    candidates = _blocked(good, rows, parts).withColumns({"asks": F.lit(1), "lane": F.pmod("block", F.lit(lanes)).cast("int"), "group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    queries = _blocked(asked, query_rows, asked_parts).withColumns({"asks": F.lit(0), "group": (F.col("part") / GROUP).cast("int"), "lane": F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))})
    met = queries.select(*columns).unionByName(candidates.select(*columns))
    met = met.repartition(groups * lanes, "dim", "group", "lane").sortWithinPartitions("dim", "group", "lane", "asks")
    found = map_arrow(met, run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _rows(best: Best) -> pa.RecordBatch:
    q, r = np.nonzero(best.filled)
    return pa.RecordBatch.from_arrays([pa.array(best.ids[q]), pa.array(best.vec[q, r]), pa.array(best.score[q, r])], ["query_id", "vec_id", "score"])


def whole(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: each component x as floor(scale * x), a double."""
    return embeddings.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), "embedding").filter(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ).drop("embedding")
