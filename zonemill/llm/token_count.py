"""Token counts by rank-synchronous array merging (see bpe_arrays)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_arrays import ByteBPE
from .common import map_arrow
from .token_blocks import Encoder, blocks, splitter


@functools.cache
def _counter(file: str, pattern: str) -> Encoder:
    bpe = ByteBPE(file)
    return Encoder(splitter(pattern), lambda new: bpe.encode([x.encode() for x in new]))


def count_tokens(docs: DataFrame, file: str, pattern: str, special: str = "<|endoftext|>", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). A null text is empty (0 bytes, 0 tokens). The special
    string inside a text is one token, as the library has it by default. Repeated rows are counted each; further columns
    are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _counter(file, pattern)
        for ids, texts in blocks(batches):
            parts, extra = [], []
            for t in texts:
                pieces = t.split(special)
                extra.append(len(pieces) - 1)
                parts.append(np.concatenate([coder.number(p) for p in pieces]) if len(pieces) > 1 else coder.number(t))
            coder.settle()
            lens = np.diff(coder.starts)
            counts = [int(lens[p].sum()) + x for p, x in zip(parts, extra, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
            coder.retire([np.concatenate(parts)])

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
