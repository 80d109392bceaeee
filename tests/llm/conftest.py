import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (doc_id, text) rows, with columns whose names clash with working names."""

    def make(rows, clash=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if clash:
            from pyspark.sql import functions as F

            for name in ("fp", "places", "length", "rank", "shard", "_salt", "grp", "bucket", "score", "stratum", "start", "_id", "_key", "_places", "_toxic", "key", "node", "size", "least", "bands", "_n", "_r"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
