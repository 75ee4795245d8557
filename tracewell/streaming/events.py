"""Structured Streaming over event files: late data, windows, latest value per key. An extension of our own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Files of a folder as they come (or the one file named); ts as a timestamp with zone, which watermarks need."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        reader, folder = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    raw = reader.parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; an event delivered twice counts once; later than `late` is dropped."""
    return (
        events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def _whole(spark: SparkSession, path: str, kind: str) -> tuple[object, list[int]]:
    """The file system, and the epochs of the whole parts of a kind, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return fs, []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = [n for n in names if n.startswith(f"{kind}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return fs, sorted(int(n.split("=")[1]) for n in found)


def _best(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(order, *keys)).alias("r")).select("r.*")


def latest_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest row per key of all whole epochs that merge_latest wrote, or None."""
    _, bases = _whole(spark, path, "base")
    _, epochs = _whole(spark, path, "epoch")
    parts = [f"base={b}" for b in bases[-1:]] + [f"epoch={e}" for e in epochs if not bases or e > bases[-1]]
    if not parts:
        return None
    keys, order = json.loads(spark.read.text(f"{path}/by").first()[0])
    return _best(spark.read.parquet(*[f"{path}/{p}" for p in parts]), keys, order)


def merge_latest(batch: DataFrame, epoch: int, path: str, keys: list[str], order: str, compact: int = 32) -> None:
    """For foreachBatch: the latest row per key. An epoch only appends its own latest rows; every `compact` epochs all are
    folded into one part, and what that holds is deleted one folding later. Parts are read only once whole, and an epoch
    that runs again writes the same part again, so the table is the same after any failure."""
    spark = batch.sparkSession
    fs, epochs = _whole(spark, path, "epoch")
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/by/_SUCCESS")):
        spark.createDataFrame([(json.dumps([keys, order]),)], "by string").coalesce(1).write.mode("overwrite").text(f"{path}/by")
    _best(batch, keys, order).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    _, bases = _whole(spark, path, "base")
    if len([e for e in {*epochs, epoch} if not bases or e > bases[-1]]) < compact:
        return
    latest_table(spark, path).write.mode("overwrite").parquet(f"{path}/base={epoch}")
    if bases:  # readers of the part before may still be at work on it; what is older goes
        for old in [*(f"base={b}" for b in bases[:-1]), *(f"epoch={e}" for e in epochs if e <= bases[-1])]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """All that is there now, into a table in memory; for tests and small reports."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
