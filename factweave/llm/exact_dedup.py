"""Exact deduplication in the manner of a Grace hash join.

Records are partitioned by a hash of their normalised text into as many buckets as the input's size needs.
Spark's shuffle files and tables in the shared folder are the spill files, so a lost executor costs a
retry and nothing is kept on one machine's disk. Where that would be more buckets than a shuffle can have,
a bucket has several parts by further bits of the hash: Spark's external sort brings them one after the
other, and each gets a table of its own, so one level does any amount. A part streams through an
open-addressing table that compares complete content. A table that is full admits no further content:
known contents still find their entry, while the rest goes, with all its copies, to the next level, which
partitions it by other bits. Every level is done when nothing is left over.

Copies meet first within a map task, so a text that makes up a third of all rows reaches its bucket
about once per map task, not once per row.

Defined cases: a null text counts as empty, and both equal texts of white space only; a null doc_id
comes after every other one; of rows alike in every respect any one stays (they cannot be told
apart); an empty table gives an empty result; columns with clashing names are carried through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, free_name, materialize, quoted, table

#: Bytes that the table of one task holds, and what an entry takes besides its content.
TABLE_BYTES = 96 << 20
ENTRY_BYTES = 512
#: Most buckets of a level, as a shuffle can't have any number; beyond it buckets have parts.
MAX_BUCKETS = 1 << 16
MAP_BYTES = 32 << 20


class ContentTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.contents: list[bytes] = []
        self.hashes: list[int] = []
        self.held = 0

    def find(self, content: bytes, hash_: int) -> tuple[int, int]:
        """(entry or -1, slot)."""
        mask = len(self.slots) - 1
        at = hash_ & mask
        while (entry := self.slots[at]) >= 0:
            if self.contents[entry] == content:
                return entry, at
            at = (at + 1) & mask
        return -1, at

    def admit(self, content: bytes, hash_: int, at: int) -> int:
        entry = self.slots[at] = len(self.contents)
        self.contents.append(content)
        self.hashes.append(hash_)
        self.held += len(content) + ENTRY_BYTES
        if 2 * len(self.contents) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for known, h in enumerate(self.hashes):
                at = h & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = known
        return entry


def _better(a: tuple, b: tuple) -> bool:
    """Whether (code points, doc_id) a stays rather than b: longer, then the smaller id, null last."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


def _combine(table_: pa.Table, text: str, key: str, hash_: str, rank: str, count: str) -> pa.Table:
    """The best row of every distinct content in table_, with the number of rows it stands for."""
    known, best, sums = ContentTable(), [], []
    marks = list(zip(table_[rank].to_pylist(), table_[key].to_pylist()))
    counts, digests = table_[count].to_pylist(), []
    for i, raw in enumerate(table_[text]):
        content = (raw.as_py() or b"").translate(None, SPACE.encode())
        digest = hashlib.sha256(content).digest()
        h = int.from_bytes(digest[:8], "little")
        entry, at = known.find(content, h)
        if entry < 0:
            known.admit(content, h, at)
            best.append(i)
            sums.append(counts[i])
            digests.append(digest)
        else:
            sums[entry] += counts[i]
            if _better(marks[i], marks[best[entry]]):
                best[entry] = i
    out = table_.take(pa.array(best, pa.int64()))
    out = out.set_column(out.schema.get_field_index(count), count, pa.array(sums, pa.int64()))
    return out.set_column(out.schema.get_field_index(hash_), hash_, pa.array(digests, pa.binary()))


def distinct_contents(docs: DataFrame, text: str = "text", key: str = "doc_id", table_bytes: int = TABLE_BYTES, keep_text: bool = True) -> tuple[DataFrame, str, str, str]:
    """(rows that stay, and the names of the added columns digest, group size and code points).

    Rows are equal when their texts are identical without white space. Of equal rows the one with
    the most code points stays, then the one with the smallest key. Without keep_text the text is
    null in the result, once its bucket is done with it.
    """
    digest, size, points, over, part = (free_name(docs, x) for x in ("text_sha256", "group_size", "code_points", "overflow", "bucket_part"))
    kind = docs.schema[text].dataType
    rows = docs.withColumns({
        text: quoted(text).cast("binary"), digest: F.lit(None).cast("binary"), size: F.lit(1).cast("long"),
        points: F.length(F.coalesce(quoted(text), F.lit(""))), over: F.lit(False), part: F.lit(0).cast("long"),
    })
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])

    def before_shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_ = [], 0
        for batch in batches:
            held.append(batch)
            bytes_ += batch.nbytes
            if bytes_ >= MAP_BYTES:
                yield from _combine(pa.Table.from_batches(held), text, key, digest, points, size).to_batches(2000)
                held, bytes_ = [], 0
        if held:
            yield from _combine(pa.Table.from_batches(held), text, key, digest, points, size).to_batches(2000)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best, at_part = ContentTable(), [], None
        arrow = None

        def stay() -> Iterator[pa.RecordBatch]:
            for start in range(0, len(best), 2000):
                some = best[start : start + 2000] if keep_text else [r | {text: None} for r in best[start : start + 2000]]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in some], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            arrow = batch.schema
            names = arrow.names
            left = []
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                row = dict(zip(names, row))
                if row[part] != at_part:
                    yield from stay()
                    known, best, at_part = ContentTable(), [], row[part]
                content = (row[text] or b"").translate(None, SPACE.encode())
                h = int.from_bytes(row[digest][8:16], "little")
                entry, at = known.find(content, h)
                if entry >= 0:
                    kept = best[entry]
                    total = kept[size] + row[size]
                    if _better((row[points], row[key]), (kept[points], kept[key])):
                        best[entry] = kept = row
                    kept[size] = total
                elif not best or 2 * (known.held + len(content) + ENTRY_BYTES) <= table_bytes:
                    known.admit(content, h, at)
                    best.append(row)
                else:
                    left.append(i)
            if left:
                rest = batch.take(pa.array(left, pa.int64()))
                flags = pa.array([True] * len(left), pa.bool_())
                yield pa.RecordBatch.from_arrays([flags if name == over else c for name, c in zip(names, rest.columns)], schema=arrow)
        yield from stay()

    def dealt(rows: DataFrame, level: int, n: int, bytes_: int) -> DataFrame:
        # so many tables that each is filled by half
        tables = -(-4 * (bytes_ + n * ENTRY_BYTES) // table_bytes)
        buckets = min(MAX_BUCKETS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tables))
        by = rows.repartition(buckets, F.xxhash64(quoted(digest), F.lit(level)))
        if tables <= buckets:
            return by
        return by.withColumn(part, F.pmod(F.xxhash64(quoted(digest), F.lit(~level)), F.lit(-(-tables // buckets)))).sortWithinPartitions(part)

    # the first level is sized by the whole input, before copies meet in the map tasks
    n, bytes_ = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(quoted(text)))).first()
    rows = rows.mapInArrow(before_shuffle, schema)
    done, level = None, 0
    while True:
        out = materialize(dealt(rows, level, n, bytes_ or 0).mapInArrow(bucket, schema), "dedup-level")
        done = out if done is None else done.filter(~quoted(over)).unionByName(out)
        rows = out.filter(quoted(over)).withColumns({over: F.lit(False), part: F.lit(0).cast("long")})
        level += 1
        n, bytes_ = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length(quoted(text)))).first()
        if not n:
            break
    stay = done.filter(~quoted(over)).withColumns({text: quoted(text).cast(kind), digest: F.lower(F.hex(quoted(digest)))}).drop(over, part)
    return stay, digest, size, points


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, one per distinct content, whole and with docs' own columns."""
    return distinct_contents(docs, text, key)[0].select(*(quoted(c) for c in docs.columns))


def members(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256."""
    stay, digest, size, points = distinct_contents(docs.select(quoted(key), quoted(text)), text, key, keep_text=False)
    groups = stay.select(quoted(digest).alias("text_sha256"), quoted(key).alias("keep_id"), quoted(size).alias("group_size"), quoted(points).alias("best"))
    whole = F.coalesce(quoted(text), F.lit(""))
    narrow = docs.select(quoted(key), F.length(whole).alias("points"), F.sha2(F.translate(whole, SPACE, ""), 256).alias("text_sha256"))
    # rows alike in all three are interchangeable: the first of them stands for the one that stays
    alike = narrow.groupBy(quoted(key), "points", "text_sha256").agg(F.count(F.lit(1)).cast("int").alias("n"))
    joined = alike.join(groups, "text_sha256")
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    kept = quoted(key).eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("best")) & (F.col("copy") == 1)
    return copies.select(quoted(key), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER w AS keep_id
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
