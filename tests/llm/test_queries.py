"""Every query of the corpus operators itself, over the smallest tables, against plain code or its own laws."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from zonemill.llm import queries

DATA = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall()
    return dict(rows)


def run(spark, name):
    rows = queries.queries()[name](spark, DATA).collect()
    return rows, {r[0]: r for r in rows}


def test_op1(spark, texts):
    coder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows, _ = run(spark, "op1_packing")
    ids = {i: np.array([*coder.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    seen, places = {i: 0 for i in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(seen[i] == len(x) for i, x in ids.items()) and sorted(places) == list(range(len(places)))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048


def test_op2(spark, texts):
    from test_duplicates import plain_print

    rows, got = run(spark, "op2_simhash")
    prints = {i: plain_print(t) for i, t in texts.items()}
    assert len(rows) == len(texts) and all(int(r.fingerprint, 16) == prints[i] for i, r in got.items())
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(prints):
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in prints}


def test_op3(spark, texts):
    from test_duplicates import plain_removal

    rows, got = run(spark, "op3_substring_dedup")
    for i, (words, gone) in plain_removal(list(texts.items())).items():
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert len(rows) == len(texts)


def test_op4(spark, texts):
    import base64

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows, got = run(spark, "op4_byte_bpe")
    assert len(rows) == len(texts)
    for i, t in texts.items():
        ids = coder.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_op5(spark, texts):
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder.no_truncation(), coder.no_padding()
    rows, got = run(spark, "op5_token_counts")
    for i, t in texts.items():
        n = len(coder.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 1024)
    assert len(rows) == len(texts)


def test_op6(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op6_top_k"]).fetchall()
    rows, _ = run(spark, "op6_top_k")
    assert sorted(tuple(r) for r in rows) == sorted(want)


def test_op7(spark, texts):
    from test_models import plain_spans

    rows, got = run(spark, "op7_pii")
    assert len(rows) == len(texts)
    kinds = ("email", "ip", "card", "phone")
    for i, t in texts.items():
        base = [f"{kinds[k]}:{s}:{e}" for s, k, e in plain_spans(t)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(x.startswith(k) for x in base) for k in kinds]
        every = got[i].spans.split(",") if got[i].spans else []
        assert set(base) <= set(every) and every == sorted(every, key=lambda x: (int(x.split(":")[1]), kinds.index(x.split(":")[0])))


def test_op8(spark, texts):
    rows, got = run(spark, "op8_toxicity")
    assert len(rows) == len(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op9(spark, texts):
    from test_models import plain_measures

    rows, got = run(spark, "op9_quality_rules")
    assert len(rows) == len(texts)
    for i, t in texts.items():
        r, m = got[i], plain_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and r.kept == (not r.base_failed and not r.failed_rules)


def test_op10(spark, texts):
    rows, got = run(spark, "op10_sharding")
    shards: dict = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        shards.setdefault(r.shard, []).append(r.slot)
    n = [len(s) for s in shards.values()]
    assert len(rows) == len(texts) and set(shards) == set(range(40)) and max(n) - min(n) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    homes: dict = {}
    for i, t in texts.items():
        homes.setdefault(t, []).append(got[i].shard)
    quota = len(texts) // 40
    assert all(len(set(h)) == 1 for h in homes.values() if len(h) <= quota)
