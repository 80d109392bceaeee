"""Near-duplicates, repeated passages, components and top-k against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from zonemill.llm import simhash, substrings, topk
from zonemill.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text):
    words = [w.encode().lower() for w in WORD.findall(text or "")]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows():
    rng = random.Random(3)
    base = [" ".join(rng.choice(["one", "two", "three", "Four", "five", "six", "é"]) + str(rng.randrange(30)) for _ in range(rng.randrange(40, 120))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(200):
        words = base[k % 12].split()
        words[rng.randrange(len(words))] = "x"
        rows.append((100 + k, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "word"), (904, "WORD"), (905, "a b"), (906, base[0]), (906, base[0])]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_simhash(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = near_rows()
    got = simhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    prints = {i: plain_print(t) for i, t in rows}
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16 for r in got)
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(prints):
        for j in sorted(prints):
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in prints}
    kept = simhash.keep_one(docs(rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({find(i) for i in prints})


def test_every_close_pair_meets_at_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for flips in ((), (0,), (31, 63), (1, 2, 3), (5, 40, 63), (32, 33, 62)):
        y = x.copy()
        for f in flips:
            y ^= np.uint64(1 << f)
        a, b = simhash.anchors(x), simhash.anchors(y)
        for p, q in zip(a, b, strict=True):
            assert ({p[0], p[16]} & set(q[q >= 0])) or ({q[0], q[16]} & set(p[p >= 0]))


def test_dense_group_is_joined_by_a_forest():
    center = np.uint64(0x123456789ABCDEF0)
    fps = np.unique(np.array([center] + [center ^ np.uint64(1 << i) for i in range(64)] + [center ^ np.uint64(3 << i) for i in range(63)], np.uint64))
    links = simhash._forest(fps)
    assert sum(len(a) for a, _ in links) == len(fps) - 1


def test_empty_and_single(spark, docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert [r.component_id for r in simhash.near_duplicates(docs([(7, "x")])).collect()] == [7]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    got = {r.node: r.root for r in components(spark.createDataFrame([(5, 4), (4, 3), (3, 9), (8, 7), (7, 8), (6, 6)], "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}


def passages():
    rng = random.Random(9)
    words = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(n)]
    common = words(60)
    rows = []
    for i in range(60):
        own = words(rng.randrange(5, 80))
        if i % 3 == 0:
            at, a = rng.randrange(len(own)), rng.randrange(30)
            own[at:at] = common[a : a + rng.randrange(5, 30)]
        rows.append((i * 7 % 61, " ".join(own) + ("\n" if i % 2 else "")))
    rows += [(200 + i, "\n".join(common)) for i in range(40)]  # one passage in many documents
    rows += [(300, None), (301, ""), (302, "short text"), (303, " ".join(["again"] * 40)), (304, " ".join(["again"] * 20)), (305, " ".join(words(5000)))]
    rows += [(306, "\t" + " ".join(common) + "  tail "), (306, "\t" + " ".join(common) + "  tail ")]
    return rows


def plain_removal(rows, n=13):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out[i] = (w, gone)
    return out


@pytest.mark.parametrize("block", [12 << 20, 600])
def test_repeated_passages(spark, docs, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    rows = passages()
    df = docs(rows).repartition(3)
    want = plain_removal(rows)
    got = substrings.removal_digests(df).collect()
    assert len(got) == len(rows)
    for r in got:
        w, gone = want[r.doc_id]
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    texts = dict(rows)
    out = substrings.remove_repeats(df).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == set(df.columns)
    for r in out:
        w, gone = want[r.doc_id]
        assert r.text == texts[r.doc_id] if not any(gone) else WORD.findall(r.text) == [x for x, g in zip(w, gone, strict=True) if not g]
    assert substrings.removal_digests(docs([])).count() == 0


def test_levels_double(spark, docs):
    rows = [(1, " ".join(map(str, range(60)))), (2, " ".join(map(str, range(55))) + " end"), (3, " ".join(map(str, range(100, 120))))]
    assert {r.doc_id: r.longest for r in substrings.repeat_levels(docs(rows)).collect()} == {1: 52, 2: 52}


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-9, 9)) for _ in range(8)]) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 420)]
    rows += [(420, None), (440, [float("nan")] * 8), (460, [1.0, None] * 4), (480, []), (500, [2.0] * 5), (501, [3.0] * 5), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20, query_rows=7, rows=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: v for i, v in rows if i is not None and v and all(x is not None and x == x for x in v)}
    for q in [i for i in good if i % 20 == 0]:
        best = sorted((-int(sum(a * b for a, b in zip(good[q], v, strict=True))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:20]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.top_k(df.filter("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_passages_with_any_id(spark, docs):
    text, top = " ".join(f"w{i}" for i in range(30)), 2**63 - 1
    for low, high in ((-9, -2), (2, 9), (-(2**63), top)):
        df = docs([(low, text), (high, text)]).repartition(2)
        assert {r.doc_id: r.n_removed for r in substrings.removal_digests(df).collect()} == {low: 0, high: 30}
    other = text + " and more"
    rows = [(5, text), (5, other), (None, text), (8, other), (8, "short")]
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.removal_digests(docs(rows)).collect()}
    assert got == {(5, 30): 0, (5, 32): 0, (None, 30): 0, (8, 32): 32, (8, 1): 0}


def test_top_k_resolutions_prune():
    """Directions of falling energy, as trained embeddings have them: most pairs never meet the exact product."""
    rng = np.random.default_rng(1)
    y = np.floor(rng.normal(0, 1, (20000, 64)) * (40 * 0.8 ** np.arange(64)) @ np.linalg.qr(rng.normal(0, 1, (64, 64)))[0])
    ids = np.arange(len(y))
    best = topk.Best(ids[::20], y[::20], 20, topk.rotation(y[:4096]))
    for c in range(0, len(y), 1000):
        d = y[c : c + 1000]
        best.add(ids[c : c + 1000], d, [topk.summaries(d @ best.turn, h) for h in topk.HEADS])
    share = best.met / best.met[0]
    assert (np.diff(share) <= 0).all() and share[-1] < 0.06, share
    scores = y[::20] @ y.T
    scores[np.arange(1000), ids[::20]] = -np.inf
    assert (np.sort(scores, axis=1)[:, ::-1][:, :20] == best.score).all()
