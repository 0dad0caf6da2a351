"""What the operators share: the shared folder, written tables, text basics and distributed ranks."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let, running_starts  # noqa: F401 (for the operators)

# The six ASCII white-space characters that every contract names as [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (on one machine, as in tests) one of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints", "factweave")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def application_dir(spark: SparkSession) -> str:
    """All tables that an application writes lie in this folder, to be removed with it."""
    return f"{shared_dir(spark)}/factweave-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{application_dir(spark)}/{label}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Removes in the end the tables that were materialised inside, but those that outlive it."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.pop()
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def materialize(df: DataFrame, label: str, outlive: bool = False, parts: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts lineage so that a lost executor costs one re-read, not a re-run; columns computed from
    partition ids or row positions are fixed from then on. With outlive it stays until the scratch outside the
    innermost one ends. With parts it has so many files at most: each file costs calls to the file system, on a
    local one even processes that the executor starts to set permissions.
    """
    path = new_path(df.sparkSession, label)
    for made in _scratch[-1 - outlive : len(_scratch) - outlive]:
        made.append(path)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores until no column of df (in any case) has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def quoted(name: str) -> Column:
    """The column called exactly that, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def global_rank(df: DataFrame, keys: list[Column], rank: str, label: str) -> DataFrame:
    """Add a gapless 0-based rank in the order of keys, without one task seeing all rows.

    Range partitioning deals the rows, so equal leading keys may spread over partitions; each
    partition numbers its own rows, and the starts of the partitions are a table of one row per
    partition (its size is bound by the number of partitions, hence the broadcast). Ties get any
    order, so keys should end in something unique where that matters.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    row = F.monotonically_increasing_id()
    own = [quoted(c) for c in df.columns]
    part, at, other, start = (free_name(df, x) for x in ("_pid", "_pos", "_part", "_start"))
    fixed = materialize(ranged.withColumns({part: F.spark_partition_id(), at: row.bitwiseAND((1 << 33) - 1)}), label)
    counts = fixed.groupBy(quoted(part).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col("p").alias(other), (F.expr("sum(n) over (order by p)") - F.col("n")).alias(start))
    return fixed.join(F.broadcast(starts), quoted(part) == quoted(other)).select(*own, (quoted(start) + quoted(at)).alias(rank))
