"""Bins that a stream keeps, against a batch: late rows, restarts, batches run again, compaction."""

import pytest
from pyspark.sql import functions as F

from zonemill.operators import addresses
from zonemill.streaming import counters


@pytest.fixture
def setup(spark, tmp_path):
    rows = spark.range(400).select(
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id % 70 as int))").alias("ts"), (F.col("id") * 37 % 90).cast("double").alias("value"), (F.col("id") % 5).alias("part")
    )
    rows = rows.withColumn("value", F.when(F.col("part") != 4, F.col("value")))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(rows.drop("part").schema).parquet(str(tmp_path / "in"))
    return rows, stream, counters.BinStore(f"file://{tmp_path}/store", 20.0), tmp_path


def content(df):
    return sorted(map(tuple, df.select("day", "bin", "n", F.col("total").cast("double")).collect()))


def test_streamed_bins_equal_a_batch(spark, setup):
    rows, stream, store, folder = setup
    for n in range(5):
        # Every file spans all days, so each one is late for the days that came before.
        rows.filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(str(folder / "in"))
        store.start(stream, str(folder / "at"), availableNow=True).awaitTermination()
        if n in (1, 2):
            store.compact(spark)
        assert content(store.read(spark)) == content(counters.value_bins(rows.filter(F.col("part") <= n), 20.0))
    assert store.read(spark).agg(F.sum("n")).first()[0] == rows.filter("value IS NOT NULL").count()


def test_a_batch_that_runs_again_counts_once(spark, setup):
    rows, _, store, _ = setup
    first, second = rows.filter("part < 2"), rows.filter("part >= 2")
    store.merge(first, 0)
    store.merge(first, 0)
    store.merge(second, 1)
    store.merge(second, 1)
    want = content(counters.value_bins(rows, 20.0))
    assert content(store.read(spark)) == want
    store.compact(spark)
    store.compact(spark)
    assert content(store.read(spark)) == want


def test_a_base_hides_batches_that_were_not_deleted(spark, setup):
    rows, _, store, _ = setup
    store.merge(rows, 0)
    # As if compaction had failed between writing its base and deleting the batch.
    store.read(spark).write.parquet(f"{store.path}/kind=base/number=0")
    assert content(store.read(spark)) == content(counters.value_bins(rows, 20.0))


def test_many_queries_find_what_one_by_one_finds(spark):
    names = ["Strada Mare", "strada  mare", "Mică", "a", "Aleea Mărului", "ab", "șoseaua", "Bab", "", None, "123 a"]
    records = spark.createDataFrame([(n, f"s{i % 3}" if i % 4 else None, "d" if i % 5 else "") for i, n in enumerate(names)], "street string, settlement string, district string")
    texts = ["mare", "a", "ab", "ma", "MĂR", "zzz", "", None, "strada mare", "ada m", "3 a", "șos"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = addresses.search_many(records, asked).collect()
    for i, t in enumerate(texts):
        want = addresses.search(records, t).collect()
        assert sorted((r.street_norm, r.place, str(r.settlement)) for r in got if r.query_id == i) == sorted((r.street_norm, r.place, str(r.settlement)) for r in want)
