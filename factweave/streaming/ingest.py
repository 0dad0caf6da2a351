"""Structured Streaming on top of the batch operators: an extension, the batch semantics are the reference."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..sources.keyed import insert_ignore
from ..sources.shared import shared_folder


def append_new(sink: str, key: list[str]):
    """A foreachBatch function that appends rows whose key the Parquet sink lacks; safe to repeat for an epoch."""

    def work(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
        old = spark.read.schema(batch.schema).parquet(sink) if there else spark.createDataFrame([], batch.schema)
        insert_ignore(old, batch, key).write.mode("append").parquet(sink)

    return work


def stream_once(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash) of the documents at path, read as a stream to its present end."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(path if _is_folder(spark, path) else path.rsplit("/", 1)[0] + "/documents.parque[t]")
    hashed = source.select(content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    job = hashed.writeStream.foreachBatch(append_new(f"{folder}/out", ["content_hash"])).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema("content_hash string").parquet(f"{folder}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where).isDirectory()


def rate_windows(events: DataFrame, at: str = "at", kind: str = "kind", items: str = "items", window: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Items by kind in sliding windows; late rows are dropped after the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, window, slide), kind).agg(F.sum(items).alias("items"), F.count(F.lit(1)).alias("calls"))


def first_seen(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
