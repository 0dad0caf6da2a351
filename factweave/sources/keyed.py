"""Keyed Parquet tables without a transactional format: probe, insert-ignore, upsert, replace, delete.

Caches and entity tables are DataFrames keyed by columns; every operation is a join, and what is
written goes to a new folder first and is swapped in by a rename, so a reader never sees half a
table. One writer per table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hits(requests: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """requests with the cached columns."""
    return requests.join(cache, key, "inner")


def misses(requests: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """One request per key that the cache lacks."""
    return requests.join(cache.select(*key), key, "left_anti").dropDuplicates(key)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append: the first of each key (by all columns in order) that old lacks."""
    order = F.struct(*(c for c in sorted(new.columns) if c not in key))
    firsts = new.groupBy(*key).agg(F.min(order).alias("_row")).select(*key, "_row.*")
    return firsts.join(old.select(*key), key, "left_anti").select(*new.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The whole table with new in place of old rows of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def replace_where(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The whole table with all rows of new's keys replaced by new: the swap of a document's claims."""
    return upsert(old, new, key)


def delete_by(rows: DataFrame, doomed: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(doomed.select(*key), key, "left_anti")


def delete_intra(findings: DataFrame, pairs: DataFrame, claims: DataFrame, document_id: Column | str) -> tuple[DataFrame, DataFrame]:
    """(findings, pairs) without those of scope intra on one document."""
    own = claims.filter(F.col("document_id") == document_id).select(F.col("id").alias("claim_a_id"))
    doomed = pairs.filter("scope = 'intra'").join(own, "claim_a_id", "left_semi")
    return delete_by(findings, doomed.select(F.col("id").alias("pair_id")), ["pair_id"]), delete_by(pairs, doomed.select("id"), ["id"])


def changed(stored: DataFrame, fresh: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Fresh rows whose key is new or whose compared columns differ: what has to be processed again."""
    return fresh.join(stored.select(*key, *compare), [*key, *compare], "left_anti")


def latest(df: DataFrame, by: str, tie: str) -> DataFrame:
    """The one row that is last by a column."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie).desc()).limit(1)


def lookup_document(documents: DataFrame, arxiv_id: str) -> DataFrame:
    """The latest version of a paper that is no evaluation variant."""
    return documents.filter((F.col("arxiv_id") == arxiv_id) & F.col("eval_run_id").isNull()).orderBy(F.col("version").desc()).limit(1)


def backfill(claims: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """The rows that an embedding cache lacks, one per key, filled from claims that have a vector."""
    keyed_ = claims.filter("embedding is not null").withColumn("content_hash", F.sha2(F.concat_ws("\n", "subject", "text"), 256))
    rows = keyed_.select("content_hash", F.lit(model).alias("model"), F.size("embedding").alias("dims"), "embedding")
    own = cache.filter(F.col("model") == model) if "model" in cache.columns else cache
    return insert_ignore(own, rows, ["content_hash"])


def backfill_stats(claims: DataFrame, cache: DataFrame) -> DataFrame:
    """(rows, distinct, inserted) of filling an embedding cache from claims."""
    key = F.sha2(F.concat_ws("\n", "subject", "text"), 256).alias("content_hash")
    keyed = claims.filter("embedding is not null").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = cache.select("content_hash").distinct().withColumn("known", F.lit(True))
    return keyed.join(known, "content_hash", "left").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("known").isNull()).alias("inserted"))


#: The layout of a store's tables; a store of a later one isn't touched.
STORE_VERSION = 1


class Store:
    """A folder of Parquet tables.

    A table is a folder of versions and the file `current`, which names the one that counts. A swap writes a new
    version first and then replaces that small file, so there is a whole table at every moment, on
    object stores too (nothing is renamed); the version before stays for readers that have begun.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        found = self._text(f"{self.root}/version")
        if found is not None and int(found) > STORE_VERSION:
            raise ValueError(f"the store at {root} has version {found}, this is {STORE_VERSION}")

    def migrate(self) -> None:
        """Bring the store to this version; there has been one so far."""
        self._put(f"{self.root}/version", str(STORE_VERSION))

    def _files(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def _text(self, path: str) -> str | None:
        fs, where = self._files(path)
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        fs, where = self._files(path)
        stream = fs.create(where, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def path(self, name: str) -> str | None:
        """The folder of the table's current version."""
        version = self._text(f"{self.root}/{name}/current")
        return version and f"{self.root}/{name}/{version}"

    def exists(self, name: str) -> bool:
        return self.path(name) is not None

    def read(self, name: str, schema) -> DataFrame:
        """The table, or an empty one of that schema."""
        path = self.path(name)
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame) -> None:
        path = self.path(name)
        if path:
            rows.write.mode("append").parquet(path)
        else:
            self.swap(name, rows)

    def swap(self, name: str, rows: DataFrame) -> None:
        """Write first, then point to it; rows may read the table itself. Versions before the last two are removed."""
        old, version = self._text(f"{self.root}/{name}/current"), uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{name}/{version}")
        self._put(f"{self.root}/{name}/current", version)
        fs, where = self._files(f"{self.root}/{name}")
        for status in fs.listStatus(where):
            if status.isDirectory() and status.getPath().getName() not in (version, old):
                fs.delete(status.getPath(), True)
