"""Rank-synchronous byte-pair merging on ragged arrays.

Many pre-tokens stand one after another in flat arrays of symbols. In a round every sequence applies its own lowest-rank
pair, all sequences at once; a sequence that has no pair left is done. Where a merge makes a symbol that takes part in a
pair of a lower rank, applying all its places at once could differ from one merge at a time, so there only the leftmost
place of a sequence is merged in a round.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of byte-level BPE: printable Latin-1
    characters for themselves, the others from code point 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class PairTable:
    """(left, right) -> (rank, new symbol), looked up for whole arrays. Two hash tables; what collides in the first goes
    to the second, and what collides there too to a sorted list."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, new: np.ndarray):
        self.keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.rank, self.new = rank.astype(np.int32), new.astype(np.int32)
        bits = max(8, int(np.ceil(np.log2(len(self.keys) + 1))) + 3)
        self.shift = np.uint64(64 - bits)
        rest, self.tables = np.arange(len(self.keys)), []
        for factor in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
            slots = self._slot(self.keys[rest], factor)
            table = np.full(1 << bits, -1, np.int32)
            table[slots] = rest
            self.tables.append((factor, table))
            rest = rest[table[slots] != rest]
        self.rest = rest[np.argsort(self.keys[rest])]
        # A merge whose product is in a pair of lower rank.
        first = np.full(int(max(left.max(initial=0), right.max(initial=0), new.max(initial=0))) + 1, NONE)
        np.minimum.at(first, left, self.rank)
        np.minimum.at(first, right, self.rank)
        self.unsafe = first[self.new] < self.rank

    def _slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys * factor) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int32)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self.tables[0][1][self._slot(keys, self.tables[0][0])]
        miss = np.flatnonzero((at >= 0) & (self.keys[at] != keys) | (at < 0))
        at[miss] = -1
        if len(miss):
            factor, table = self.tables[1]
            two = table[self._slot(keys[miss], factor)]
            two[(two >= 0) & (self.keys[two] != keys[miss])] = -1
            at[miss] = two
        if len(self.rest) and len(miss):
            miss = miss[at[miss] < 0]
            i = np.minimum(np.searchsorted(self.keys[self.rest], keys[miss]), len(self.rest) - 1)
            hit = self.keys[self.rest][i] == keys[miss]
            at[miss[hit]] = self.rest[i[hit]]
        return at


def merge_all(symbols: np.ndarray, starts: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges every sequence to its end. symbols: all sequences; starts: where each begins, and at last the length of
    symbols. No sequence may be empty. Returns the surviving symbols and their starts."""
    n = len(starts) - 1
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seq = np.arange(n)
    sym, lens = symbols.astype(np.int32), np.diff(starts)
    pair = None
    while len(seq):
        begin = np.concatenate(([0], np.cumsum(lens)))
        last = begin[1:] - 1
        if pair is None:
            pair = np.full(len(sym), -1, np.int32)
            pair[:-1] = table.find(sym[:-1], sym[1:])
            pair[last] = -1
        rank = np.where(pair >= 0, table.rank[pair], NONE)
        low = np.minimum.reduceat(rank, begin[:-1])
        live = low < NONE
        if not live.all():
            on = np.repeat(live, lens)
            done.append((seq[~live], lens[~live], sym[~on]))
            seq, lens, low = seq[live], lens[live], low[live]
            sym, pair, rank = sym[on], pair[on], rank[on]
            if not len(seq):
                break
            begin = np.concatenate(([0], np.cumsum(lens)))
        chosen = np.flatnonzero(rank == np.repeat(low, lens))
        # Places that overlap (a pair of equal symbols in a run): every other one, from the left.
        fresh = np.concatenate(([True], np.diff(chosen) > 1))
        if not fresh.all():
            run = np.flatnonzero(fresh)
            nth = np.arange(len(chosen)) - np.repeat(run, np.diff(np.append(run, len(chosen))))
            equal = sym[chosen] == sym[chosen + 1]
            chosen = chosen[(nth % 2 == 0) | ~equal]
        bad = table.unsafe[pair[chosen]]
        if bad.any():
            owner = np.searchsorted(begin, chosen, "right")
            leftmost = np.concatenate(([True], np.diff(owner) > 0))
            chosen = chosen[~bad | leftmost]
        sym[chosen] = table.new[pair[chosen]]
        gone = np.zeros(len(sym), bool)
        gone[chosen + 1] = True
        lens = lens - np.add.reduceat(gone, begin[:-1], dtype=np.int64)
        stay = ~gone
        where = np.cumsum(stay) - 1
        sym, pair = sym[stay], pair[stay]
        at = where[chosen]
        ends = np.cumsum(lens)
        is_last = np.zeros(len(sym), bool)
        is_last[ends - 1] = True
        is_first = np.zeros(len(sym), bool)
        is_first[np.concatenate(([0], ends[:-1]))] = True
        left = at[~is_first[at]] - 1
        redo = np.concatenate((left, at))
        pair[at[is_last[at]]] = -1
        redo = redo[~is_last[redo]]
        pair[redo] = table.find(sym[redo], sym[redo + 1])
    out_len = np.zeros(n, np.int64)
    for ids, ls, _ in done:
        out_len[ids] = ls
    out_start = np.concatenate(([0], np.cumsum(out_len)))
    out = np.empty(out_start[-1], np.int32)
    for ids, ls, s in done:
        if len(s):
            offset = np.arange(len(s)) - np.repeat(np.cumsum(ls) - ls, ls)
            out[np.repeat(out_start[ids], ls) + offset] = s
    return out, out_start


class ByteBPE:
    """A byte-level vocabulary file (.json): bytes of pre-tokens to ids. ``ending``: a mark of the last symbol of a word."""

    def __init__(self, file: str, ending: str = ""):
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, shown = model["vocab"], byte_symbols()
        self.first = np.array([vocab[c] for c in shown], np.int32)
        self.final = np.array([vocab[c + ending] for c in shown], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        new = np.array([vocab[m[0] + m[1]] for m in merges], np.int64)
        self.table = PairTable(left, right, np.arange(len(merges)), new)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin. No word may be empty."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(lens)))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.first[raw]
        symbols[starts[1:] - 1] = self.final[raw[starts[1:] - 1]]
        return merge_all(symbols, starts, self.table)
