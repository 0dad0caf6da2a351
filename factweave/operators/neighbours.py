"""Nearest-neighbour pairs within documents (intra) or across them (cross).

For each vector the k nearest partners by cosine, then those of at least the threshold; a pair is kept
if either side ranked the other. Ties rank by partner id, pairs are (least id, greatest id). Zero and null
vectors take no part. The threshold is applied before the rank: both keep a prefix of the same
order, so the result is the same and less is sorted.

Strategies: `sql` (a join, for small inputs and as the reference for tests), `block` (exact matrix products
of parts of the vectors, the default) and `lsh` (random projections, approximate, for inputs on which n^2
products are out of reach; what it returns is exact, what it may miss is measured in the tests).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalise, norm
from ..sources.shared import stored_batches, written

# Neighbours per claim and least cosine.
TOP_K, MIN_SIMILARITY = 12, 0.72
#: A task of the exact strategy holds at most four blocks of this many vectors, and reads the others a batch at a time.
BLOCK, BATCH = 2048, 512


def unit_vectors(df: DataFrame, id_: str, doc: str, vec: str) -> DataFrame:
    """(id, doc, v) with v of length 1, without null and zero vectors."""
    rows = df.select(F.col(id_).alias("id"), F.col(doc).alias("doc"), F.col(vec).alias("raw")).filter("raw is not null")
    return rows.filter(norm(F.col("raw")) > 0).select("id", "doc", l2_normalise(F.col("raw")).alias("v"))


def _sql(units: DataFrame, scope: str, k: int, t: float) -> DataFrame:
    a, b = units.select([F.col(c).alias(f"a_{c}") for c in units.columns]), units.select([F.col(c).alias(f"b_{c}") for c in units.columns])
    same = F.col("a_doc") == F.col("b_doc") if scope == "intra" else F.col("a_doc") != F.col("b_doc")
    return a.join(b, same & (F.col("a_id") != F.col("b_id"))).select("a_id", "b_id", dot(F.col("a_v"), F.col("b_v")).alias("sim")).filter(F.col("sim") >= t)


class _Best:
    """The k best partners of each left row so far; partners come in the order of their ids, so a later one only counts if it is nearer."""

    def __init__(self, n: int, k: int, t: float):
        self.k, self.least = k, np.full(n, t)
        self.row, self.at, self.sim, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), None
        self.waiting, self.held = [], 0

    def add(self, row: np.ndarray, at: np.ndarray, sim: np.ndarray, ids: np.ndarray) -> None:
        if len(row):
            self.waiting.append((row, at, sim, ids))
            self.held += len(row)
        if self.held > len(self.least):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        known = [(self.row, self.at, self.sim, self.id)] if self.id is not None else []
        row, at, sim, ids = (np.concatenate(part) for part in zip(*known, *self.waiting))
        rounded = np.floor(sim * 1e9 + 0.5)
        order = np.lexsort((at, -rounded, row))
        first = np.r_[True, row[order][1:] != row[order][:-1]]
        place = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        full = order[place == self.k - 1]
        # slightly less than what would be rounded to more than the k-th
        self.least[row[full]] = np.maximum(self.least[row[full]], (rounded[full] + 0.49) * 1e-9)
        order = order[place < self.k]
        self.row, self.at, self.sim, self.id = row[order], at[order], sim[order], ids[order]
        self.waiting, self.held = [], 0


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _nearest(part: tuple[int, int, int], files: list, scope: str, k: int, t: float) -> pa.RecordBatch | None:
    """The k best partners, at least t, of the rows start to stop of one file, over all files that have any."""
    own, start, stop = part
    left = pa.Table.from_batches(list(stored_batches(files[own]["file"], BATCH, start, stop)))
    v, ids = np.concatenate([_vectors(b) for b in left.to_batches()]), left["id"].to_numpy()
    doc, names = pd.factorize(left["doc"].to_pandas())
    names = pd.Index(names)
    low, high = own, own
    if scope == "intra":  # rows are in the order of documents, so these stand in files side by side
        while low and files[low - 1]["last"] == names[0]:
            low -= 1
        while high + 1 < len(files) and files[high + 1]["first"] == names[-1]:
            high += 1
    else:
        low, high = 0, len(files) - 1
    best, at = _Best(len(v), k, t), 0
    for file in files[low : high + 1]:
        for batch in stored_batches(file["file"], BATCH):
            r, rid, rdoc = _vectors(batch), batch["id"].to_numpy(zero_copy_only=False), names.get_indexer(batch["doc"].to_pandas())
            place, rows = at + np.arange(len(r)), slice(0, len(v))
            at += len(r)
            if scope == "intra":
                met = rdoc >= 0
                if not met.any():
                    continue
                r, rid, rdoc, place = r[met], rid[met], rdoc[met], place[met]
                rows = slice(np.searchsorted(doc, rdoc.min()), np.searchsorted(doc, rdoc.max(), "right"))
            s = v[rows] @ r.T
            same = doc[rows, None] == rdoc[None, :]
            x, y = np.nonzero((s >= best.least[rows, None]) & (same if scope == "intra" else ~same))
            sim, x = s[x, y], x + rows.start
            other = ids[x] != rid[y]
            best.add(x[other], place[y[other]], sim[other], rid[y[other]])
    best.settle()
    if best.id is None:
        return None
    kind = left.schema.field("id").type
    return pa.RecordBatch.from_arrays([left["id"].combine_chunks().take(pa.array(best.row)), pa.array(best.id, kind), pa.array(best.sim)], ["a_id", "b_id", "sim"])


def _block(units: DataFrame, scope: str, k: int, t: float) -> DataFrame:
    """Vectors are stored once, sorted; a task holds some of them and reads the others' files one after the other.

    So what is shuffled and written is the vectors once and k partners of each, however many products there are.
    """
    spark = units.sparkSession
    kind = units.schema["id"].dataType.simpleString()
    schema = f"a_id {kind}, b_id {kind}, sim double"
    units = units.filter("id is not null and doc is not null")
    order = ["doc", "id"] if scope == "intra" else ["id"]
    n = units.count()
    stored = written(units.repartitionByRange(max(1, math.ceil(n / (4 * BLOCK))), *order).sortWithinPartitions(*order), "vectors")
    place = F.struct(*order)
    ranges = stored.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    found = ranges.orderBy("low").collect()
    if not found:
        return spark.createDataFrame([], schema)
    files = [{"file": r["file"], "first": r["low"][0], "last": r["high"][0]} for r in found]
    held = min(4 * BLOCK, max(BLOCK // 4, math.ceil(n / (2 * spark.sparkContext.defaultParallelism))))
    parts = [(i, at, min(at + held, r["n"])) for i, r in enumerate(found) for at in range(0, r["n"], held)]

    def product(batches):
        for batch in batches:
            for i in batch["id"].to_pylist():
                out = _nearest(parts[i], files, scope, k, t)
                if out is not None:
                    yield out

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(product, schema)


def _lsh(units: DataFrame, scope: str, k: int, t: float, tables: int = 8, width: float = 1.0) -> DataFrame:
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = written(units, "lsh").withColumn("vector", array_to_vector("v"))
    model = BucketedRandomProjectionLSH(inputCol="vector", outputCol="buckets", bucketLength=width, numHashTables=tables, seed=7).fit(rows)
    near = model.approxSimilarityJoin(rows, rows, math.sqrt(max(0.0, 2 - 2 * t)) + 1e-9, "distance")
    a, b = F.col("datasetA"), F.col("datasetB")
    same = a["doc"] == b["doc"] if scope == "intra" else a["doc"] != b["doc"]
    return near.filter(same & (a["id"] != b["id"])).select(a["id"].alias("a_id"), b["id"].alias("b_id"), dot(a["v"], b["v"]).alias("sim")).filter(F.col("sim") >= t)


def neighbours(df: DataFrame, scope: str = "intra", k: int = TOP_K, t: float = MIN_SIMILARITY, id_: str = "id", doc: str = "document_id", vec: str = "embedding", strategy: str = "block") -> DataFrame:
    """(a_id, b_id, similarity): unordered pairs, a_id < b_id."""
    if scope not in ("intra", "cross"):
        raise ValueError(f"scope is intra or cross, not {scope}")
    near = {"sql": _sql, "block": _block, "lsh": _lsh}[strategy](unit_vectors(df, id_, doc, vec), scope, k, t)
    ranked = near.withColumn("rank", F.expr("row_number() over (partition by a_id order by round(sim, 9) desc, b_id)")).filter(F.col("rank") <= k)
    return ranked.groupBy(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).agg(F.max("sim").alias("similarity"))


def baseline(df: DataFrame, doc: str = "document_id") -> DataFrame:
    """One row: claims, documents, and how many pairs there are within and across documents.

    cross_estimate is right for documents of equal size only; cross_pairs always is.
    """
    sizes = df.groupBy(doc).agg(F.count(F.lit(1)).alias("n"))
    sums = sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.sum(F.expr("n * n")).alias("sq"), F.sum(F.expr("n * (n - 1) div 2")).alias("intra"))
    return sums.select(
        F.coalesce("n", F.lit(0)).alias("claims"), F.col("d").alias("documents"), F.coalesce("intra", F.lit(0)).alias("intra_pairs"),
        F.expr("coalesce((n * n - sq) div 2, 0)").alias("cross_pairs"),
        F.expr("coalesce(cast(floor(n * (n - n / d) / 2 + 0.5) as bigint), 0)").alias("cross_estimate"),
    )


def reduction_percent(kept, total):
    """How much of the baseline the candidates save, in percent."""
    return 100 - F.try_divide(kept * 100.0, total)
