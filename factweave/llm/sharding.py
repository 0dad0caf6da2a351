"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Plan and data are kept apart. Best-fit decreasing looks at sizes alone, so the plan is made on the
driver from the histogram of group sizes: groups of one size are interchangeable, and a run of them
fills the tightest bin as far as it goes in one step. A histogram over groups of T bytes in all has
at most about 2 * sqrt(T) distinct sizes (sizes up to sqrt(T), and fewer than sqrt(T) groups above
it), whatever the number of rows; that is what reaches the driver and is broadcast. The rows
themselves are ranked by size with a range partitioning and look up their interval of the plan.

Defined cases: a null text is a group of its own (size 1, CRC of the empty text), an empty text is
another; repeated rows belong to one group and get slots of their own; a null doc_id sorts first;
an empty table gives an empty result. A group larger than an even share gets a shard to itself, and
the others share out the rest evenly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, global_rank, materialize, quoted, table


class _Node:
    __slots__ = ("key", "height", "left", "right")

    def __init__(self, key):
        self.key, self.height, self.left, self.right = key, 1, None, None


def _height(node):
    return node.height if node else 0


def _fix(node):
    node.height = 1 + max(_height(node.left), _height(node.right))
    lean = _height(node.left) - _height(node.right)
    if lean > 1:
        if _height(node.left.left) < _height(node.left.right):
            node.left = _rotate(node.left, "right", "left")
        return _rotate(node, "left", "right")
    if lean < -1:
        if _height(node.right.right) < _height(node.right.left):
            node.right = _rotate(node.right, "left", "right")
        return _rotate(node, "right", "left")
    return node


def _rotate(node, up, down):
    top = getattr(node, up)
    setattr(node, up, getattr(top, down))
    setattr(top, down, node)
    node.height = 1 + max(_height(node.left), _height(node.right))
    top.height = 1 + max(_height(top.left), _height(top.right))
    return top


class BalancedTree:
    """A height-balanced tree of (remaining capacity, bin)."""

    def __init__(self):
        self.root = None

    def add(self, key) -> None:
        def put(node):
            if node is None:
                return _Node(key)
            side = "left" if key < node.key else "right"
            setattr(node, side, put(getattr(node, side)))
            return _fix(node)

        self.root = put(self.root)

    def remove(self, key) -> None:
        def cut(node, key):
            if key < node.key:
                node.left = cut(node.left, key)
            elif key > node.key:
                node.right = cut(node.right, key)
            elif node.left is None or node.right is None:
                return node.left or node.right
            else:
                low = node.right
                while low.left:
                    low = low.left
                node.key = low.key
                node.right = cut(node.right, low.key)
            return _fix(node)

        self.root = cut(self.root, key)

    def tightest(self, size):
        """The least (remaining, bin) with remaining >= size, or None."""
        node, best = self.root, None
        while node:
            if node.key[0] >= size:
                node, best = node.left, node.key
            else:
                node = node.right
        return best


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, max_bins: int | None = None):
    """Runs (size, count, bin) in packing order for (size, count) sorted by size, largest first.

    Items over the capacity get a bin each. None if more than max_bins bins were needed.
    """
    tree, runs, bins = BalancedTree(), [], 0
    for size, left in sizes:
        while left:
            found = tree.tightest(size)
            if found:
                tree.remove(found)
                room, at = found
            else:
                if max_bins is not None and bins >= max_bins:
                    return None
                room, at, bins = max(capacity, size), bins, bins + 1
            # the bin stays the tightest one for this size until it is too full for it
            n = min(left, room // size) if size else left
            runs.append((size, n, at))
            left -= n
            tree.add((room - n * size, at))
    return runs


def plan_even(sizes: list[tuple[int, int]], n_bins: int):
    """Runs (size, count, bin) over exactly n_bins bins of nearly equal sums.

    Groups above an even share of what is left get bins of their own; for the others the least
    capacity is bisected at which best-fit decreasing needs no more than the bins left.
    """
    sizes = sorted(sizes, reverse=True)
    total, alone, rest, bins = sum(s * n for s, n in sizes), [], [], n_bins
    for size, n in sizes:
        while n and not rest and bins > 1 and size * bins > total:
            alone.append((size, 1, n_bins - bins))
            total, n, bins = total - size, n - 1, bins - 1
        if n:
            rest.append((size, n))
    if not rest:
        return alone
    low = max(-(-total // bins), rest[0][0])
    high, best = low, None
    while best is None:  # grows geometrically from the ideal, so the bisection starts near the answer
        best = best_fit_decreasing(rest, high, bins)
        low, high = (low, high) if best is not None else (high + 1, high + max(1, (high - total // bins) * 2, total // bins >> 12))
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(rest, middle, bins)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
    return alone + [(s, n, at + n_bins - bins) for s, n, at in best]


def shard_groups(docs: DataFrame, group_key: str, size: str, n_shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """docs with shard (int) and slot (long, gapless from 0 in each shard); groups stay together.

    Give n_shards for that many shards of nearly equal sums, or capacity for as few shards of that
    capacity as best-fit decreasing needs. size must be a non-negative long; a null counts as 0.
    """
    if (n_shards is None) == (capacity is None):
        raise ValueError("give either n_shards or capacity")
    spark = docs.sparkSession
    gsize, count, rank, shard, slot, grank, other, first = (free_name(docs, x) for x in ("gsize", "gcount", "row_rank", "shard", "slot", "group_rank", "group_key", "shard_first"))
    groups = docs.groupBy(quoted(group_key)).agg(F.sum(F.coalesce(quoted(size), F.lit(0))).alias(gsize), F.count(F.lit(1)).alias(count))
    ranked = global_rank(groups, [F.col(gsize).desc(), quoted(group_key)], grank, "shard-groups")
    histogram = [(r[0], r[1]) for r in ranked.groupBy(gsize).agg(F.count(F.lit(1)).alias(count)).orderBy(F.col(gsize).desc()).toPandas().itertuples(index=False)]
    sizes = [(int(s), int(n)) for s, n in histogram]
    runs = plan_even(sizes, n_shards) if capacity is None else best_fit_decreasing(sizes, capacity)
    # alone and the rest are both in falling order of size, so a run's ranks follow the runs before it
    starts = np.cumsum([0, *(n for _, n, _ in runs)])[:-1]
    places = spark.sparkContext.broadcast((starts, np.array([at for _, _, at in runs], dtype=np.int32)))

    @F.pandas_udf("int")
    def place(rank: pd.Series) -> pd.Series:
        starts, at = places.value
        return pd.Series(at[np.searchsorted(starts, rank.to_numpy(), side="right") - 1] if len(rank) else [], dtype="int32")

    placed = materialize(ranked.withColumn(shard, place(F.col(grank))), "shard-plan")
    # a null key joins with itself; AQE splits the copies of a hot group over tasks
    key = quoted(group_key)
    joined = docs.join(placed.select(key.alias(other), grank, shard), key.eqNullSafe(F.col(other))).drop(other)
    ordered = global_rank(joined, [F.col(shard), F.col(grank), *([quoted("doc_id")] if "doc_id" in docs.columns else [])], rank, "shard-rows")
    per_shard = placed.groupBy(F.col(shard).alias("s")).agg(F.sum(count).alias("n"))
    starts = per_shard.select(F.col("s").alias(other), (F.expr("sum(n) over (order by s)") - F.col("n")).alias(first))
    return ordered.join(F.broadcast(starts), F.col(shard) == F.col(other)).select(*(quoted(c) for c in docs.columns), shard, (F.col(rank) - F.col(first)).alias(slot))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law `bytes`: equal texts stay together, sums of sizes are nearly equal."""
    text = F.col("text")
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.unhex(F.coalesce(F.sha2(text, 256), F.lit(""))).alias("text_key"),
    )
    narrow = materialize(narrow, "shard-docs")
    out = shard_groups(narrow, "text_key", "size", n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
