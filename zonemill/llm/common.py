"""Parts shared by the corpus operators: tables kept in the shared folder, ranks without gathering a key, word rules."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may go without; anything else is an error, as
    a folder of one machine would lose rows on the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file:///tmp/checkpoints")
    return "file:///tmp/checkpoints"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them back: lineage ends here, and the files survive
    the loss of any executor. What the write shuffled is dropped at its end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes a table that keep() wrote and that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if libc.mallopt and libc.malloc_trim else None
    except (OSError, AttributeError):
        return None


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, lean: bool = False) -> DataFrame:
    """mapInArrow whose tasks give back at their end what memory they have freed, as workers live on between tasks. lean:
    arrays of 1 MB and more are mapped and go back as soon as they are freed, which costs time; else those of 32 MB."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        if libc:
            libc.mallopt(-3, 1 << 20 if lean else 32 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 1 << 20 if lean else 64 << 20)  # M_TRIM_THRESHOLD
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if libc:
            libc.malloc_trim(0)

    return df.mapInArrow(tidy, schema)


def part_rows(total: int) -> int:
    """How many rows of one key are ranked in one group: so few that a key with all rows has 1,024 groups, and 50,000 at most."""
    return max(1, min(50_000, total // 1024))


def salts_for(rows: int, total: int) -> int:
    """How many parts a key with ``rows`` of the ``total`` rows is ranked in."""
    return max(1, -(-rows // part_rows(total)))


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _salted(df: DataFrame, keys: list[str], order: list[str], salts: int | Column) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_salt`` and ``_r`` (rank from 0 in key and salt), and per key and salt the ranks before it."""
    salts = salts if isinstance(salts, Column) else F.lit(salts)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), salts).cast("int"))
    # Dealt by key and salt here: rows that already lie by key would else be ranked where they lie, a hot key in one task.
    salted = salted.repartition(*keys, "_salt")
    sizes = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    here = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return salted.withColumn("_r", F.row_number().over(here).cast("long") - 1), starts


def with_rank(df: DataFrame, keys: list[str], order: list[str], salts: int | Column, name: str = "rank") -> DataFrame:
    """Adds each row's rank from 0 within its keys (which may not be null), gapless. A key with any share of all rows
    is ranked in ``salts`` parts (a column: as many as its own count asks for), so that no task holds all of it."""
    salted, starts = _salted(df, keys, order, salts)
    out = salted.join(starts.drop("_n"), [*keys, "_salt"])
    return out.withColumn(name, F.col("_start") + F.col("_r")).drop("_salt", "_r", "_start")


def deal_by_rank(df: DataFrame, keys: list[str], order: list[str], spans: DataFrame, salts: int | Column, rank: str | None = None) -> DataFrame:
    """Gives each row the columns of the span of ``spans`` (keys, lo, hi, ...) in which its rank within its keys lies
    (lo inclusive, hi exclusive), and, if named, the rank itself. Spans of a key may not overlap in what they add; a rank
    in no span loses its row, so callers cover all ranks. Spans are first cut to the salted parts of the ranking, which
    keeps a hot key out of any single task."""
    salted, starts = _salted(df, keys, order, salts)
    cut = (
        starts.join(spans, keys)
        .filter((F.col("_start") < F.col("hi")) & (F.col("_start") + F.col("_n") > F.col("lo")))
        .withColumns({"_lo": F.col("lo") - F.col("_start"), "_hi": F.col("hi") - F.col("_start")})
        .drop("_n", "lo", "hi")
    )
    out = salted.join(cut, [*keys, "_salt"]).filter((F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi")))
    if rank:
        out = out.withColumn(rank, F.col("_start") + F.col("_r"))
    return out.drop("_salt", "_r", "_lo", "_hi", "_start")


def words_of(text: Column) -> Column:
    """The words of a text (null: none), in order, as an array."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")
