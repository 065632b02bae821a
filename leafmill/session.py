"""Session and table helpers shared by plans, tests and the bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables, read by Spark wherever ``sf_dir`` lives."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the folder of spark.checkpoint.dir and cuts its lineage; only a local session without one gets a temporary folder."""
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="leafmill-"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Deals ``df`` out to all cores where it has fewer partitions: a file of one row group is one split, however much work its rows are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: About what one task holds at most of a table that is dealt out by a key.
TASK_BYTES, TASK_ROWS = 32 << 20, 250_000


def pieces(df: DataFrame, size: Column, most: int) -> int:
    """How many partitions hold about ``most`` of ``size`` each, added up over the rows; no fewer than Spark would make."""
    held = df.agg(F.sum(size)).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(held) // most))


def text_batches(df: DataFrame) -> DataFrame:
    """Keeps Arrow batches small, so that very long texts don't meet in one batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with ``name``: its place in the order, from 1.

    Rows are dealt out by ranges of the order; each range counts its rows, and
    the few counts of the ranges before it are added.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id())
    placed = cut(placed.withColumn("at_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))  # one row a partition
    starts = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("start_"))
    return placed.join(F.broadcast(starts), "part_").withColumn(name, F.col("start_") + F.col("at_") + 1).drop("part_", "at_", "start_")


def broadcastable(df: DataFrame, size: Column, most: int = 16 << 20) -> DataFrame:
    """Marks ``df`` for broadcast if its rows, of ``size`` bytes each, come to at most ``most``; else Spark shuffles it."""
    held = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if held <= most else df
