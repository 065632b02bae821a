"""Continuously merged state: last write wins, sessions and windows over streams.

State is kept as a versioned table in a shared folder: each micro-batch is
merged with the version before it and written as the next, so a batch that is
run again after a failure gives the same version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="leafmill-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def merge_last_write(state: DataFrame | None, batch: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Last write by (updated_us, change_id) over the state and a batch."""
    columns = [*keys, "updated_us", "change_id", *values]
    rows = batch.select(*columns) if state is None else state.select(*columns).unionByName(batch.select(*columns))
    top = F.max_by(F.struct("updated_us", "change_id", *values), F.struct("updated_us", "change_id")).alias("top")
    return rows.groupBy(*keys).agg(top).select(*keys, "top.*")


def start_last_write(stream: DataFrame, root: str, keys: list[str], values: list[str], **trigger):  # noqa: ANN201
    """Starts the merge of a stream with columns keys, updated_us, change_id and values into ``root``/v<batch>; the last two versions stay."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{root}/v{number - 1}") if number else None
        merge_last_write(state, batch, keys, values).write.mode("overwrite").parquet(f"{root}/v{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v{number - 2}")  # a batch that runs again needs the version before it
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/offsets").trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version of a merged table."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(root))]
    done = [int(n[1:]) for n in found if n[0] == "v" and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{root}/v{max(done)}")


def replay_last_write(spark: SparkSession, path: str, keys: list[str], values: list[str]) -> DataFrame:
    """The events file or folder as a stream, merged to its end."""
    schema = spark.read.parquet(path).schema
    source = path if _is_folder(spark, path) else path.rpartition("/")[0]
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if source == path else path.rpartition("/")[2]).parquet(source)
    log = stream.select(*keys, F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_us"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("change_id"), *values)
    root = shared_root(spark)
    start_last_write(log, root, keys, values).awaitTermination()
    return latest(spark, root)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def windowed_counts(stream: DataFrame, ts: str, late: str, width: str, slide: str | None = None, *by: str) -> DataFrame:
    """Tumbling or sliding counts with a watermark; rows later than ``late`` are left out."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"))


def session_counts(stream: DataFrame, ts: str, late: str, idle: str, *by: str) -> DataFrame:
    """Activity sessions that end after ``idle``."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, idle), *by).agg(F.count(F.lit(1)).alias("n"))
