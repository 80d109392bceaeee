"""Tokenizing operators against the libraries themselves."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from zonemill.llm import bpe_replay, packing, token_count
from zonemill.llm.bpe_arrays import ByteBPE

os.environ["TOKENIZERS_PARALLELISM"] = "false"
random.seed(5)
ODD = [0x20, 0x85, 0xA0, 0x2003, 0x1C, 0x1F, 0x41, 0xE9, 0xC9, 0x4E2D, 0x1F600, 0x301, 0xB2, 0x2167, 0x660, 0x180E, 0x200B, 0x0A, 0x0D, 0x130, 0x3A3, 0x3C3, 0x2E, 0x2C, 0x27, 0x73, 0x31]
TEXTS = [
    None, "", " ", "a", "Hello world, it's fine. It's 1234!", "a<|endoftext|>b<|startoftext|> <|STARTOFTEXT|>", "aaaa" * 400, "ab" * 700 + "\n\n\n  x", "Straße ÀÉÎ÷×ß ÿŸ ẞ K. don't,we'LL",
    *["".join(chr(random.choice(ODD)) for _ in range(random.randint(1, 80))) for _ in range(300)], *["".join(random.choice("abhesto 1.\n") for _ in range(random.randint(1, 400))) for _ in range(100)],
    "the quick brown fox jumps over the lazy dog " * 600,
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def word_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_counts(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_count.count_tokens(docs(ROWS), P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    assert len(got) == len(ROWS)
    for i, text in ROWS:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 1024)
    assert token_count.count_tokens(docs([]), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert token_count.count_tokens(docs([(1, "x"), (1, "x"), (None, None)]), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 3


def test_arrays_handle_repeats_of_one_symbol():
    bpe = ByteBPE(P.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    words = ["a" * n for n in range(1, 90)]
    ids, starts = bpe.encode([w.encode() for w in words])
    assert all(ids[starts[i] : starts[i + 1]].tolist() == t.encode(w).ids for i, w in enumerate(words))


def test_encode_decode(spark, docs):
    import tiktoken

    file = P.path("byte_bpe_multi_50k.tiktoken")
    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe_replay.encode(docs(ROWS), file, P.PATTERN)
    got = {r.doc_id: r.token_ids for r in encoded.collect()}
    digests = {r.doc_id: r for r in bpe_replay.round_trip_digests(docs(ROWS), file, P.PATTERN).collect()}
    back = {r.doc_id: bytes(r.bytes) for r in bpe_replay.decode(encoded, file).collect()}
    for i, text in ROWS:
        ids = enc.encode_ordinary(text or "")
        assert got[i] == ids and back[i] == (text or "").encode()
        d = digests[i]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe_replay.round_trip_digests(docs([]), file, P.PATTERN).count() == 0


def test_packing(spark, docs, word_ids):
    rows = ROWS + [(1000 + i, "same words in each of these rows") for i in range(300)] + [(5000, "once more "), (5000, "once more ")]
    got = packing.pack_documents(docs(rows), P.path("word_bpe_49k.json")).toPandas()
    texts = dict(rows)
    seen = {}
    for r in got.itertuples():
        ids = np.array([*word_ids(texts[r.doc_id]), 1], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert all(seen[i] == (len(word_ids(t)) + 1) * (2 if i == 5000 else 1) for i, t in rows)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    per = ordered.groupby("sequence_id").length.sum()
    assert per.max() <= 2048 and sorted(per.index) == list(range(len(per)))
    assert per.sum() / (len(per) * 2048) > 0.85
    assert packing.pack_documents(docs([]), P.path("word_bpe_49k.json")).count() == 0


def test_shortest_pack_first_places_all():
    from collections import Counter

    for seed in range(4):
        rng = random.Random(seed)
        lengths = Counter(min(2047, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20000))
        packs = packing.pack_lengths(dict(lengths), 2048)
        placed = Counter()
        for pattern, n in packs:
            assert sum(pattern) <= 2048
            for x in pattern:
                placed[x] += n
        assert placed == lengths
        assert sum(k * v for k, v in lengths.items()) / (2048 * sum(n for _, n in packs)) > 0.98
