"""Texts in blocks, their pieces numbered, and each distinct piece encoded once.

A worker keeps the numbers of the pieces that it has met. Once the book holds more than ``BOOK_PIECES`` pieces at the end of
a block, the half of that which was met most often stays; that costs repeated work and changes no result, so memory stays
bounded by the block.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: New pieces are encoded so many at a time, as the arrays for them are a multiple of the pieces themselves.
BLOCK_BYTES, BOOK_PIECES, PIECES_AT_ONCE = 8 << 20, 240_000, 50_000


@functools.cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    return regex.compile(pattern).findall


def gather(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ragged rows ``which`` of flat, one after another."""
    begin = starts[which]
    lens = starts[which + 1] - begin
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(begin - ends + lens, lens) + np.arange(ends[-1])]


def ragged(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))


class Book(dict):
    """Piece to number, in the order of meeting."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """Numbers the pieces of texts; ``encode`` turns new pieces into flat ids and their starts."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.split, self.encode = split, encode
        self.empty()

    def empty(self) -> None:
        self.book, self.ids, self.starts = Book(), np.empty(0, np.int32), np.zeros(1, np.int64)
        self.met = np.empty(0, np.int64)

    def number(self, text: str) -> np.ndarray:
        pieces = self.split(text)
        return np.fromiter(map(self.book.__getitem__, pieces), np.int32, len(pieces))

    def retire(self, parts: list[np.ndarray]) -> None:
        """parts: the numbers of the block's texts, which are not valid any more after this."""
        met = np.zeros(len(self.book), np.int64)
        met[: len(self.met)] = self.met // 2  # what was met long ago counts less
        for p in parts:
            met += np.bincount(p, minlength=len(met))
        self.met = met
        if len(met) <= BOOK_PIECES:
            return
        stay = np.sort(np.argpartition(-met, BOOK_PIECES // 2)[: BOOK_PIECES // 2])
        words = list(self.book)
        self.book = Book(zip(map(words.__getitem__, stay.tolist()), range(len(stay)), strict=True))
        lens = np.diff(self.starts)[stay]
        self.ids, self.starts, self.met = gather(self.ids, self.starts, stay), np.concatenate(([0], np.cumsum(lens))), met[stay]

    def settle(self) -> list[str]:
        """Encodes the pieces that are new, and returns them."""
        known = len(self.starts) - 1
        new = list(self.book)[known:]
        for a in range(0, len(new), PIECES_AT_ONCE):
            ids, starts = self.encode(new[a : a + PIECES_AT_ONCE])
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.starts = np.concatenate((self.starts, self.starts[-1] + starts[1:]))
        return new

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """All ids of a text."""
        return gather(self.ids, self.starts, numbers)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of at most some BLOCK_BYTES; a longer text stands alone. Null texts are empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        doc_id, text = batch.column("doc_id"), batch.column("text")
        for i in range(len(doc_id)):
            t = text[i].as_py() or ""
            if texts and size + len(t) > BLOCK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id[i].as_py())
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts
