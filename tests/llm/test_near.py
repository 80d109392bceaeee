"""The near-duplicate stage against exact similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from zonemill.llm import near


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("chunk", [2048, 7])
def test_stage_finds_all_copies_of_similarity_08(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(near, "CHUNK", chunk)
    rng = random.Random(4)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 200))]
        for k in range(4 if g else 30):
            words = list(base)
            for _ in range(k % 4):
                words[rng.randrange(len(words))] = "x"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, "few words"), (903, "FEW  words"), (904, rows[0][1])]
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = docs(rows + [(None, "no id"), (None, "no id")])
    got = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({find(i) for i in sets})
    assert sum(r.doc_id is None for r in got) == 2


def test_stage_keeps_rows_by_id_and_text(spark, docs):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(7, a), (7, b), (7, b), (3, a), (-4, b + " more"), (9, None), (8, ""), (None, a)]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs(rows), "").collect()), key=str)
    assert got == sorted([(3, a), (-4, b + " more"), (8, ""), (None, a)], key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, docs([]), "").count() == 0


def test_prints_find_copies_that_bands_do_not(spark, docs, monkeypatch):
    # Without bands the covering of prints is the only source of candidates; some pairs differ in more bits than it covers.
    monkeypatch.setattr(near, "BANDS", 0)
    monkeypatch.setattr(near, "bands", lambda own: near.np.empty(0, near.np.int64))
    rows = []
    for i in range(20):
        words = [f"w{i}.{n}" for n in range(1500)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:700], "x", *words[701:]]))]
    left = {r.doc_id for r in near.keep_one(docs(rows)).collect()}
    assert left >= set(range(0, 40, 2)) and len(left) <= 32
