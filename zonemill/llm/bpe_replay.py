"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a block of texts are the corpus. An inverted index leads from each rank to the places where a
pair of that rank stands. Ranks are taken in order; all places of a rank, in all words, are merged together, and only
their neighbours are looked up again. A merge whose product stands in a pair of a lower rank is done at the leftmost place
of a word only, and the others wait, so the outcome is that of merging one pair at a time.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_arrays import PairTable
from .common import map_arrow
from .token_blocks import Encoder, blocks, gather, ragged, splitter


class RankFile:
    """Ranks as tiktoken has them: a token's rank is its id, and any two tokens that join to a token are a pair."""

    def __init__(self, file: str):
        with open(file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        left, right, new = [], [], []
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), new.append(rank)
        self.table = PairTable(*(np.array(x, np.int64) for x in (left, right, new, new)))
        #: Of each id the bytes, and the decimal digits with a comma.
        self.bytes = ragged(self.tokens)
        self.decimal = ragged([b"%d," % i for i in range(len(self.tokens))])
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and where each word's begin; a word that is a token is that token."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        lens[whole >= 0] = 1
        merged = [w for w, t in zip(words, whole, strict=True) if t < 0]
        starts = np.concatenate(([0], np.cumsum(lens)))
        sym = np.empty(starts[-1], np.int32)
        sym[starts[:-1][whole >= 0]] = whole[whole >= 0]
        inside = np.repeat(whole < 0, lens)
        sym[inside] = self.first[np.frombuffer(b"".join(merged), np.uint8)]
        alive = self.replay(sym, starts, inside)
        out_starts = np.concatenate(([0], np.cumsum(alive)))[starts]
        return sym[alive], out_starts

    def replay(self, sym: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Merges in place; returns which places survive."""
        n, table = len(sym), self.table
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[starts[1:] - 1], prv[starts[:-1]] = -1, -1
        alive = np.ones(n, bool)
        pair = np.full(n, -1, np.int32)
        begins = np.flatnonzero(inside & (nxt >= 0))
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            """Enters the pairs that begin at these places into the index."""
            found = table.find(sym[places], sym[nxt[places]])
            pair[places] = found
            places, ranks = places[found >= 0], table.rank[found[found >= 0]]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, group in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts) if len(cuts) else [places], strict=True):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(heap, r)

        note(begins)
        while heap:
            rank = heapq.heappop(heap)
            groups = index.pop(rank)
            at = np.unique(np.concatenate(groups)) if len(groups) > 1 else groups[0]
            p = pair[at]
            at = at[alive[at] & (p >= 0) & (table.rank[p] == rank)]
            if not len(at):
                continue
            if len(at) > 1:
                touches = nxt[at[:-1]] == at[1:]
                if touches.any():
                    fresh = np.concatenate(([True], ~touches))
                    run = np.flatnonzero(fresh)
                    nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                    at = at[nth % 2 == 0]
                bad = table.unsafe[pair[at]]
                if bad.any():
                    word = np.searchsorted(starts, at, "right")
                    first = np.concatenate(([True], np.diff(word) > 0))
                    wait = at[bad & ~first]
                    at = at[~bad | first]
                    if len(wait):
                        index[rank] = [wait]
                        heapq.heappush(heap, rank)
            new = table.new[pair[at]]
            right = nxt[at]
            sym[at] = new
            alive[right] = False
            pair[right] = -1
            after = nxt[right]
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            pair[at[~has]] = -1
            before = prv[at]
            note(np.unique(np.concatenate((before[before >= 0], at[has]))))
        return alive


@functools.cache
def _coder(file: str, pattern: str) -> tuple[RankFile, Encoder]:
    ranks = RankFile(file)
    return ranks, Encoder(splitter(pattern), lambda new: ranks.encode([x.encode() for x in new]))


def _run(docs: DataFrame, file: str, pattern: str, schema: str, row) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, coder = _coder(file, pattern)
        for ids, texts in blocks(batches):
            parts = [coder.number(t) for t in texts]
            coder.settle()
            rows = [row(ranks, coder.of(p)) for p in parts]
            cols = [ids, *(list(c) for c in zip(*rows, strict=True))]
            kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(cols, schema.split(", "), strict=True)], names)
            coder.retire([np.concatenate(parts)])

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, schema)


def encode(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """doc_id and token_ids of every whole text. A null text is empty and has no ids; repeated rows are encoded each;
    further columns are ignored; an empty table gives an empty result."""
    return _run(docs, file, pattern, "doc_id long, token_ids array<int>", lambda _, ids: (ids.tolist(),))


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """doc_id and the bytes of token_ids (null: none). An id that the file does not have is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _coder(file, "")[0].tokens
        for batch in batches:
            out = [b"".join([tokens[i] for i in ids or ()]) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return map_arrow(encoded.select("doc_id", "token_ids"), run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids in decimal and of the bytes they decode to, in one pass: ids need not
    be written out to be digested. A null text is empty; repeated rows are encoded each; further columns, whatever their names,
    are ignored; an empty table gives an empty result."""

    def row(ranks: RankFile, ids: np.ndarray) -> tuple:
        decimal = gather(*ranks.decimal, ids)[:-1].tobytes()
        decoded = gather(*ranks.bytes, ids).tobytes()
        return len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _run(docs, file, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
