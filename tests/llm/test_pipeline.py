"""The stages one after another on the smallest documents."""

import corpus_pipeline
from zonemill.llm import substrings
from zonemill.llm.common import documents, keep

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, DATA)
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns
        after = docs.count()
        assert 0 < after <= before and (after == before or name in ("toxicity", "simhash_near_dedup"))
        assert after == docs.select("doc_id").distinct().count()
        if name == "substring_dedup":
            assert substrings.removal_digests(docs).count() == after
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert packed.doc_id.nunique() == before
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()


def test_names_and_registration():
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "pii", "packing"]
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
