"""Packing documents into sequences of a fixed length: shortest-pack-first over the length histogram.

A document of more tokens than a sequence holds fills whole sequences with its head; what is left, like every shorter
document, is a piece of a length below the sequence length. Only the histogram of these lengths comes to the driver: as
many numbers as a sequence has tokens, however many documents there are. Lengths are placed longest first, each into
the open pack with the most room; packs of one pattern are counted, not listed. A pattern's packs then take pieces
by rank: every place in a pattern is a span of ranks of its length, and a join brings the spans to the pieces.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_arrays import ByteBPE
from .common import deal_by_rank, keep, map_arrow, salts_for
from .token_blocks import Encoder, blocks


def pack_lengths(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: (lengths of a pattern, number of packs with it). Every length is between 1 and size."""
    open_packs: dict[int, dict[tuple[int, ...], int]] = {}
    full: dict[tuple[int, ...], int] = {}

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        packs = full if room == 0 else open_packs.setdefault(room, {})
        packs[pattern] = packs.get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_packs, default=0)
            if room < length:
                put((length,), left, size - length)
                break
            pattern, count = next(iter(open_packs[room].items()))
            # As many of this length as a pack takes at once while it stays the one with the most room.
            second = max((r for r in open_packs if r != room), default=0)
            per = max(1, min(room // length, (room - max(second, length)) // length + 1))
            packs = min(count, left // per) if left >= per else 0
            if not packs:
                per, packs = left, 1
            if packs == count:
                del open_packs[room][pattern]
                if not open_packs[room]:
                    del open_packs[room]
            else:
                open_packs[room][pattern] = count - packs
            put(pattern + (length,) * per, packs, room - per * length)
            left -= per * packs
    for packs in open_packs.values():
        for pattern, count in packs.items():
            full[pattern] = full.get(pattern, 0) + count
    return list(full.items())


def spans_of(patterns: list[tuple[tuple[int, ...], int]], first_sequence: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, sequence of rank lo, offset): the pieces of ranks lo to hi - 1 of a length go to consecutive
    sequences, all at one offset."""
    taken: dict[int, int] = {}
    out, sequence = [], first_sequence
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            lo = taken.get(length, 0)
            taken[length] = lo + count
            out.append((length, lo, lo + count, sequence, offset))
            offset += length
        sequence += count
    return out


def pack(pieces: DataFrame, size: int = 2048, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces (``key``, start, length, ...), each length between 1 and size. Pieces that
    fill a sequence have one of their own; sequence ids are gapless from 0. An empty table stays empty."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    every, total = dict(counts), sum(counts.values())
    table = spans_of([((size,), counts.pop(size))] if size in counts else [])
    first = table[0][2] if table else 0
    table += spans_of(pack_lengths(counts, size), first)
    spans = pieces.sparkSession.createDataFrame(table, "length long, lo long, hi long, first_sequence long, offset long")
    spans = spans.withColumn("span_lo", F.col("lo"))
    # One row for each length, so ``size`` rows at most.
    salts = pieces.sparkSession.createDataFrame([(x, salts_for(n, total)) for x, n in every.items()], "length long, _salts int")
    pieces = pieces.join(F.broadcast(salts), "length")
    dealt = deal_by_rank(pieces, ["length"], [key, "start"], spans, F.col("_salts"), rank="piece_rank").drop("_salts")
    return dealt.withColumn("sequence_id", F.col("first_sequence") + F.col("piece_rank") - F.col("span_lo")).drop("first_sequence", "span_lo", "piece_rank")


#: Texts that could differ between lower-casing a text and lower-casing its chunks, or that hold special strings, are
#: left to the tokenizer chunk by chunk.
_ODD = re.compile("[^\t-\r\x20-ɏ]|<\\|")
_GAPS = re.compile("[\t-\r ]+")
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")


@functools.cache
def _word_coder(file: str) -> Encoder:
    """Chunks between white space to ids: plain words and marks behind them by array merging, all others by the library."""
    from tokenizers import Tokenizer

    library, bpe = Tokenizer.from_file(file), ByteBPE(file, "</w>")

    def split(text: str) -> list[str]:
        return _GAPS.split(text) if _ODD.search(text) else text.lower().split()

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [_PLAIN.fullmatch(x) for x in new]
        # Marks behind a plain word (but for apostrophes) are a word of their own.
        words: list[str] = []
        begin = []
        for m in found:
            if m:
                begin.append(len(words))
                words += m.groups() if m[2] else (m[1],)
        plain = np.fromiter((m is not None for m in found), bool, len(found))
        lens = np.empty(len(new), np.int64)
        ids, starts = bpe.encode([w.encode() for w in words]) if words else (np.empty(0, np.int32), np.zeros(1, np.int64))
        lens[plain] = np.diff(starts[np.array([*begin, len(words)])])
        other = [e.ids for e in library.encode_batch([x for x, m in zip(new, found, strict=True) if not m], add_special_tokens=False)]
        lens[~plain] = [len(x) for x in other]
        mine = np.repeat(plain, lens)
        flat = np.empty(len(mine), np.int32)
        flat[mine], flat[~mine] = ids, [i for x in other for i in x]
        return flat, np.concatenate(([0], np.cumsum(lens)))

    return Encoder(split, encode)


def cut(docs: DataFrame, file: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Tokenizes whole texts and cuts them: doc_id, start, length, ids_crc32, doc_tokens, one row for each piece. A
    document is its ids and ``end_id``; a null text is empty. Pieces but the last have ``size`` ids. Repeated rows are cut
    each; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = _word_coder(file), np.array([end_id], np.int32)
        for ids, texts in blocks(batches):
            numbers = [coder.number(t) for t in texts]
            coder.settle()
            rows = []
            for doc_id, n in zip(ids, numbers, strict=True):
                own = np.concatenate((coder.of(n), end)).astype("<u4")
                rows += [(doc_id, s, min(size, len(own) - s), zlib.crc32(own[s : s + size].data), len(own)) for s in range(0, len(own), size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            coder.retire([np.concatenate(numbers)])

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, file: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """cut() and pack(): one row for each piece with its sequence_id and offset. A null text is empty and has the end id only;
    a text of any length is cut where sequences end; repeated rows are packed each; further columns, whatever their names, are
    ignored; an empty table gives an empty result."""
    return pack(keep(cut(docs, file, size, end_id), "pieces"), size)
