"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What one Arrow batch carries to Python at most; texts may be megabytes long.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not root:
        have = jsc.getCheckpointDir()
        if not have.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = have.get() if have.isDefined() else tempfile.mkdtemp(prefix="leafmill-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and cuts its lineage; survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_batches(df: DataFrame) -> DataFrame:
    """Keeps Arrow batches small, so that very long texts don't meet in one batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a compressed table in the shared folder and reads it again; smaller on disk than a checkpoint."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int, size: Column | None = None, most: int = 16 << 20) -> DataFrame:
    """Marks ``df`` for broadcast if it has at most ``rows`` rows and, by ``size`` (bytes of a row that vary), ``most`` bytes; else Spark shuffles it."""
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.lit(0) if size is None else size)).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= most else df


def packed(df: DataFrame, *derived) -> DataFrame:
    """All input columns in one struct ``row`` beside derived columns, so that no name can clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *derived)
