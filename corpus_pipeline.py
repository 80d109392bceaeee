"""A corpus pipeline over documents: toxicity, near-duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; a text that a stage changes gets its n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonemill.llm import near, packing, pii, substrings, toxicity
from zonemill.llm.common import documents, keep


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is fitted on labelled documents among docs. A null text is
    judged as an empty one; each of several rows with one doc_id is judged by its own text; an empty table stays empty."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a 5-word Jaccard similarity of 0.8 or more the document with the smallest doc_id stays.
    Candidates come from SimHash prints by anchor-point covering, and, as prints at a similarity of 0.8 mostly differ in more bits
    than it covers (see README), from MinHash bands too; all are compared exactly. Texts without words are like no other and stay; so do rows without a doc_id. An
    empty table stays empty."""
    return near.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside 13-word windows that an earlier document holds are taken out; every document stays.
    A null text stays null; n_chars follows the text; an empty table stays empty."""
    return _counted(substrings.remove_repeats(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays, null texts as they are; n_chars follows the text; an empty
    table stays empty."""
    return _counted(pii.mask(docs, pii.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2,048 tokens. A null text is empty; an empty table has no pieces."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Trained models decide in two stages, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
