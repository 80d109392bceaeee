"""Streaming counters over events. An extension: the batch operators have no streaming counterpart to match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_counts(events: DataFrame, window: str | Column = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and time window, batch or stream; rows later than ``late`` are left out of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    at = F.window("ts", window) if isinstance(window, str) else window
    return rows.groupBy(at.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: events no more than ``gap`` apart."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def value_bins(events: DataFrame, width: float) -> DataFrame:
    """(day, bin, n, total): values of a day in bins of a width, the input of a band computation."""
    rows = events.filter("value IS NOT NULL AND ts IS NOT NULL").withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    return rows.groupBy("day", F.floor(F.col("value") / F.lit(float(width))).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total"))


class BinStore:
    """value_bins() kept up to date by a stream. Every micro-batch adds the bins of its own rows under its number, so rows may
    come as late as they like, and a batch that is run again after a failure replaces what it wrote. compact() sums the
    batches so far into one base; a reader takes the newest base and the batches behind it, so that a failure between its steps
    counts nothing twice."""

    def __init__(self, path: str, width: float):
        self.path, self.width = path.rstrip("/"), width

    def merge(self, batch: DataFrame, number: int) -> None:
        value_bins(batch, self.width).write.mode("overwrite").parquet(f"{self.path}/kind=batch/number={number}")

    def start(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Runs the stream; the same checkpoint goes on where the last run ended."""
        return events.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def _parts(self, spark: SparkSession) -> tuple[DataFrame, int]:
        rows = spark.read.parquet(self.path)
        base = rows.filter("kind = 'base'").agg(F.max("number")).first()[0]
        base = -1 if base is None else base
        return rows.filter((F.col("number") > base) | ((F.col("kind") == "base") & (F.col("number") == base))), base

    def read(self, spark: SparkSession) -> DataFrame:
        return self._parts(spark)[0].groupBy("day", "bin").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,6)").alias("total"))

    def compact(self, spark: SparkSession) -> None:
        rows, base = self._parts(spark)
        last = rows.agg(F.max("number")).first()[0]
        if last is None or last == base:
            return
        old = rows.select("kind", "number").distinct().collect()  # as many as batches since the last time
        self.read(spark).write.mode("overwrite").parquet(f"{self.path}/kind=base/number={last}")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for r in old:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/kind={r['kind']}/number={r['number']}")
            folder.getFileSystem(conf).delete(folder, True)
