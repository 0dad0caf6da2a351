"""The folder that driver and executors share, and tables written into it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder of the application's own in spark.checkpoint.dir, or (on one machine, as in tests) in one of ours where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/checkpoints/factweave"
    return f"{root.rstrip('/')}/factweave-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove all tables that the application has written so; for its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table: what is expensive (provider calls, pairs) runs once, and a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_batches(uri: str, size: int, start: int = 0, stop: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows start to stop of a file of such a table, at most `size` at a time; for tasks."""
    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    with system.open_input_file(path) as source:
        at = 0
        for batch in pq.ParquetFile(source).iter_batches(size):
            low, high = max(start - at, 0), len(batch) if stop is None else min(stop - at, len(batch))
            at += len(batch)
            if high > low:
                yield batch.slice(low, high - low)
            if stop is not None and at >= stop:
                break
