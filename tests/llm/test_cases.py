"""Cases that every operator and stage must handle: very long texts, empty tables, clashing names, lengths that follow texts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_duplicates import plain_print
from zonemill.llm import near, pii, sharding, simhash, substrings, topk, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    return " ".join(rng.choice(words) for _ in range(300_000))


def test_very_long_texts(docs, long_text):
    twin = long_text + " one more word"
    rows = [(1, long_text), (2, twin), (3, "short text"), (4, long_text), (5, "x" * 1_000_000)]
    prints = {r.doc_id: r for r in simhash.near_duplicates(docs(rows)).collect()}
    assert int(prints[1].fingerprint, 16) == plain_print(long_text) and prints[4].component_id == 1 and prints[2].component_id == 1
    assert sorted(r.doc_id for r in near.keep_one(docs(rows)).collect()) == [1, 3, 5]
    shards = {r.doc_id: r for r in sharding.shard_documents(docs(rows)).collect()}
    assert shards[1].size == len(long_text) + 16 and {r.slot for r in shards.values()} == {0} and shards[5].size == 1_000_016


def test_empty_tables(spark, docs, tmp_path):
    none, no_labels = docs([]), spark.createDataFrame([], LABELS)
    assert toxicity.reject(none, no_labels).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert pii.mask(none, pii.train([], made_up=20, steps=2)).count() == 0
    assert near.keep_one(none).count() == 0
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    no_labels.write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_run_goes_through_all_stages(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(20)
    rows = [(i, text(80), "en", "s", 0) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[1][1] + " end", "en", "s", 0), (102, f"{text(30)} {passage}", "en", "s", 0), (103, f"{text(30)} {passage} last", "en", "s", 0), (104, text(20) + " mail ann.lee@mail.example.com now", "en", "s", 0), (105, None, "en", "s", None)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS).write.parquet(f"{folder}/labels.parquet")
    packed = corpus_pipeline.run(spark, folder).toPandas()
    assert set(packed.doc_id) == {r[0] for r in rows} - {100, 101}
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()


def test_lengths_follow_texts(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    rows = [(1, f"first {passage}", 0), (2, f"second {passage} end", 0), (3, "call ann.lee@mail.example.com", 0), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    cut = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()}
    assert cut[2].text == "second end" and all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.values())
    masked = {r.doc_id: r for r in corpus_pipeline.mask_personal_data(spark, docs, "").collect()}
    assert masked[3].text == "call <EMAIL>" and masked[4].text is None and all(r.n_chars == (None if r.text is None else len(r.text)) for r in masked.values())
    assert dict(docs.dtypes)["n_chars"] == dict(corpus_pipeline.drop_repeated_passages(spark, docs, "").dtypes)["n_chars"] == "int"


def test_vectors_beside_clashing_names(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-9, 9)) for _ in range(6)]) for i in range(60)]
    plain = spark.createDataFrame(rows, "vec_id long, v array<double>")
    more = plain
    for name in ("score", "rank", "query_id", "dim", "group", "lane", "asks", "ids", "data", "block", "part", "serial"):
        more = more.withColumn(name, F.lit("x"))
    want = sorted(map(tuple, topk.top_k(plain, F.col("vec_id") % 20 == 0, 5).collect()))
    assert sorted(map(tuple, topk.top_k(more, F.col("vec_id") % 20 == 0, 5).collect())) == want and len(want) == 15
