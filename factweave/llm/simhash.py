"""SimHash near-duplicates by vantage-point trees over 64-bit fingerprints.

Two fingerprints within `radius` = 3 bits differ by at most 1 bit in one of their 32-bit halves.
So each half gets a vantage-point tree under the Hamming distance of that half, queried with radius
1: every node has a vantage point of its own, a member, and the radius that parts its fingerprints
best, which an exact histogram of their distances gives. A fingerprint whose distance is so near the
boundary that the triangle bound can't rule out a partner beyond it is also sent there as a boundary
copy. About one in seven fingerprints is near a boundary where they are spread evenly, more where
they agree in many bits; a radius of 3 over all 64 bits would copy 28 % at every level.

The upper tree is grown level by level with one record per node on the driver: nodes are split while
they hold more than SHARD fingerprints, and SHARD grows with the input so that there are some
thousands of nodes at most. Its leaves are the shards. A task splits its shard further in the same way,
until a part holds LEAF fingerprints; what agrees in the half goes on by the distance of all 64 bits. Within a part
the pairs are exact: a fingerprint is compared with those that the triangle bound to one more vantage
point leaves, on all 64 bits. A part emits a spanning forest of its links, never all pairs, and what
is linked already is not compared again; a group of thousands of near copies costs one pass.
Components of up to HELD edges are found on the driver; those of more form by alternating large-star and small-star
steps over tables in the shared folder.

Defined cases: a text without words has fingerprint zero and links like any other; null counts as
empty; a null doc_id takes part but is never the smallest unless the whole component has none; rows with one
doc_id are one document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, quoted, table

#: Fingerprints of a part, and of a shard at least; shards are at most some MAX_SHARDS.
LEAF, SHARD = 2048, 16_384
MAX_SHARDS = 1 << 13
#: Keys that are sent to all tasks at most.
SENT = 2_000_000
#: Edges whose components the driver finds at most.
HELD = 1_000_000
RADIUS = 3

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WEIGHTS = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of lower-cased word shingles hashed with XXH64, seed 42; zero without words."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashed, n = xxhash.xxh64_intdigest, len(tokens) - words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        some = slice(at, min(n, at + 65536))
        h = np.fromiter((hashed(joined[s:e], 42) for s, e in zip(starts[some].tolist(), ends[some.start + words - 1 : some.stop + words - 1].tolist())), np.uint64, some.stop - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[2 * ones > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3) -> DataFrame:
    """docs without their text, with the fingerprint as a (signed) long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            prints = np.fromiter((fingerprint(t.as_py() or b"", words) for t in batch.column(at)), np.uint64, batch.num_rows)
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(prints.view(np.int64))], names=[*(batch.schema.names[i] for i in rest), out])

    rows = docs.withColumn(text, quoted(text).cast("binary"))
    schema = docs.drop(text).withColumn(out, F.lit(0).cast("long")).schema
    return rows.mapInArrow(work, schema)


def _part(fps: np.ndarray, half: np.ndarray | int) -> np.ndarray:
    """The half (0: low, 1: high) of each fingerprint."""
    return np.where(np.asarray(half) == 1, fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF))


def split_radius(counts: np.ndarray, reach: int) -> int | None:
    """The largest distance of the inner side that makes the larger child, copies included, least; None if no radius parts them.

    counts are fingerprints by distance. What the inner side has within `reach` of the boundary is copied out.
    """
    inner = np.cumsum(counts)
    before = np.concatenate([np.zeros(reach, np.int64), inner])[: len(inner)]  # inner side beyond the reach
    outer = inner[-1] - before
    larger = np.maximum(inner, outer)[:-1]
    if not len(larger) or 10 * larger.min() > 9 * inner[-1]:
        return None
    return int(np.argmin(larger))


class Tree:
    """The upper nodes: number -> (vantage point, radius, reach). Node 2 + half is a root, 2n and 2n + 1 are n's sides.

    Reach 1 goes with the distance of the half, reach RADIUS with that of all 64 bits.
    """

    def __init__(self, nodes: dict[int, tuple[int, int, int]]):
        self.nodes = np.array(sorted(nodes), np.int64)
        self.points = np.array([nodes[n][0] for n in sorted(nodes)], np.uint64)
        self.radii = np.array([nodes[n][1] for n in sorted(nodes)], np.int64)
        self.reach = np.array([nodes[n][2] for n in sorted(nodes)], np.int64)

    def leaves(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, leaf) of each fingerprint in each leaf that it or a partner within reach can be in."""
        row, half = np.tile(np.arange(len(fps)), 2), np.repeat([0, 1], len(fps))
        leaf, done = 2 + half, []
        while len(row):
            at = np.searchsorted(self.nodes, leaf)
            inside = self.nodes[np.minimum(at, len(self.nodes) - 1)] == leaf if len(self.nodes) else np.zeros(len(row), bool)
            done.append((row[~inside], leaf[~inside]))
            row, half, leaf, at = row[inside], half[inside], leaf[inside], at[inside]
            away = _away(fps[row], half, self.points[at], self.reach[at])
            # of a pair that straddles the boundary the inner one is sent over; both then meet on the outer side
            near = (away <= self.radii[at]) & (away > self.radii[at] - self.reach[at])
            leaf = np.concatenate([2 * leaf + (away > self.radii[at]), 2 * leaf[near] + 1])
            row, half = np.concatenate([row, row[near]]), np.concatenate([half, half[near]])
        return tuple(np.concatenate([d[i] for d in done]) for i in (0, 1))


def _half_of(node: int) -> int:
    return node >> (node.bit_length() - 2) & 1


def _away(fps: np.ndarray, half, points: np.ndarray, reach) -> np.ndarray:
    """Distances to whole vantage points, in the half or (with a reach over 1) in all bits."""
    differ = fps ^ points
    return np.bitwise_count(np.where(np.asarray(reach) == 1, _part(differ, half), differ)).astype(np.int64)


def _placed(prints: DataFrame, tree: Tree) -> DataFrame:
    """(leaf, fp): each fingerprint in its leaves."""
    known = prints.sparkSession.sparkContext.broadcast(tree)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            row, leaf = known.value.leaves(fps)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fps[row].view(np.int64))], names=["leaf", "fp"])

    return prints.select("fp").mapInArrow(work, "leaf long, fp long")


def _sizes(prints: DataFrame, tree: Tree) -> DataFrame:
    """(leaf, n, fp): the fingerprints of each leaf and one of them, added up per task first."""
    known = prints.sparkSession.sparkContext.broadcast(tree)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, int]] = {}
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            row, leaf = known.value.leaves(fps)
            order = np.lexsort((fps[row] * np.uint64(0x9E3779B97F4A7C15), leaf))
            names, first, counts = np.unique(leaf[order], return_index=True, return_counts=True)
            for name, fp, n in zip(names.tolist(), fps[row[order[first]]].tolist(), counts.tolist()):
                m, other = held.get(name, (0, fp))
                held[name] = (m + n, min(fp, other, key=lambda x: x * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        fps = np.array([fp for _, fp in held.values()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array(fps)], names=["leaf", "n", "fp"])

    each = prints.select("fp").mapInArrow(work, "leaf long, n long, fp long")
    return each.groupBy("leaf").agg(F.sum("n").alias("n"), F.min_by("fp", F.xxhash64("fp")).alias("fp"))


def _histograms(prints: DataFrame, tree: Tree, points: dict[int, int], reach: int) -> DataFrame:
    """(leaf, d, n): how many fingerprints of some leaves are at each distance to its vantage point, added up per task first."""
    known = prints.sparkSession.sparkContext.broadcast((tree, np.array(sorted(points), np.int64), np.array([points[n] for n in sorted(points)], np.uint64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, wanted, points = known.value
        half = np.array([_half_of(n) for n in wanted.tolist()])
        counts = np.zeros(65 * len(wanted), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            row, leaf = tree.leaves(fps)
            at = np.minimum(np.searchsorted(wanted, leaf), len(wanted) - 1)
            row, at = row[wanted[at] == leaf], at[wanted[at] == leaf]
            counts += np.bincount(65 * at + _away(fps[row], half[at], points[at], reach), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[seen // 65]), pa.array(seen % 65), pa.array(counts[seen])], names=["leaf", "d", "n"])

    return prints.select("fp").mapInArrow(work, "leaf long, d long, n long").groupBy("leaf", "d").agg(F.sum("n").alias("n"))


def grow(prints: DataFrame, n: int) -> Tree:
    """The upper tree of n distinct fingerprints. What reaches the driver is a row per large node, and its histogram of at most 65 rows."""
    most = max(SHARD, n // MAX_SHARDS)
    nodes: dict[int, tuple[int, int, int]] = {}
    whole: set[int] = set()  # nodes that no radius parts
    while n > most:
        tree = Tree(nodes)
        points = {r["leaf"]: r["fp"] & (1 << 64) - 1 for r in _sizes(prints, tree).filter(F.col("n") > most).collect() if r["leaf"] not in whole}
        if not points:
            break
        for reach in (1, RADIUS):  # by the half, and by all bits what agrees in the half
            left = {leaf: point for leaf, point in points.items() if leaf not in nodes}
            histograms = {leaf: np.zeros(65, np.int64) for leaf in left}
            for r in _histograms(prints, tree, left, reach).collect() if left else ():
                histograms[r["leaf"]][r["d"]] = r["n"]
            for leaf, counts in histograms.items():
                radius = split_radius(counts, reach)
                if radius is not None:
                    nodes[leaf] = (points[leaf], radius, reach)
        whole |= points.keys() - nodes.keys()
    return Tree(nodes)


def parts(fps: np.ndarray, half: int) -> Iterator[np.ndarray]:
    """Parts of a shard of at most LEAF fingerprints (more if nothing parts them) such that linked pairs near in that half meet in one."""
    todo = [fps]
    while todo:
        fps = todo.pop()
        split = None
        if len(fps) > LEAF:
            point = fps[len(fps) // 2]
            for reach in (1, RADIUS):
                away = _away(fps, half, point, reach)
                radius = split_radius(np.bincount(away, minlength=65), reach)
                if radius is not None:
                    split = (fps[away <= radius], fps[away > radius - reach])
                    break
        if split is None:
            yield fps
        else:
            todo += split


def forest(prints: np.ndarray, radius: int = RADIUS, point: int = 0x9E3779B97F4A7C15) -> list[tuple[int, int]]:
    """Index pairs that span the components of prints (distinct, uint64) linked at <= radius bits."""
    away = np.bitwise_count(prints ^ np.uint64(point)).astype(np.int16)
    order = np.argsort(away, kind="stable")
    prints, away = prints[order], away[order]
    starts = np.searchsorted(away, np.arange(66 + radius))
    open_ = np.ones(len(prints), bool)
    links = []
    for seed in range(len(prints)):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            # the triangle bound: only distances to the point within radius of x's own can be near it
            low, high = starts[max(0, away[x] - radius)], starts[away[x] + radius + 1]
            near = np.flatnonzero(open_[low:high]) + low
            near = near[np.bitwise_count(prints[near] ^ prints[x]) <= radius]
            open_[near] = False
            queue.extend(near.tolist())
            links.extend((int(order[seed]), int(order[y])) for y in near)
    return links


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints fp that span every component of each shard."""
    shards = _placed(prints, grow(prints, prints.count()))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by leaf; a leaf may go over several batches
        def done(leaf, held):
            for fps in parts(np.concatenate(held).view(np.uint64), _half_of(leaf)):
                found = np.array(forest(fps), np.int64).reshape(-1, 2)
                fps = fps.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(fps[found[:, 0]]), pa.array(fps[found[:, 1]])], names=["a", "b"])

        leaf, held = None, []
        for batch in batches:
            names, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
            for name, part in zip(names[np.concatenate([[0], cuts])].tolist() if len(names) else [], np.split(fps, cuts)):
                if name != leaf and held:
                    yield from done(leaf, held)
                    held = []
                leaf = name
                held.append(part)
        if held:
            yield from done(leaf, held)

    dealt = shards.repartition("leaf").sortWithinPartitions("leaf", "fp")
    return dealt.mapInArrow(within, "a long, b long").distinct()


def joined(u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """The nodes of the edges (u, v) in order, and the smallest node of the component of each."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = list(range(len(names)))
    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    for x in range(len(up)):  # what is above has a smaller number, so it is at its root already
        up[x] = up[up[x]]
    return [names, names[up]]


def components(edges: DataFrame, label: str = "simhash", parts: int | None = None) -> DataFrame:
    """(node, root): the smallest node of the component of every node that edges (a, b) touch.

    Few edges go to the driver. Others alternate large-star and small-star steps, until a round of both changes no edge.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = materialize(edges.filter("a <> b").select(high, low).distinct(), f"{label}-edges", parts=parts)
    if 0 < now.count() <= HELD:
        found = pa.table(joined(*(c.to_numpy() for c in now.toArrow().columns)), names=["node", "root"])
        return materialize(edges.sparkSession.createDataFrame(found), f"{label}-roots", parts=1)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = large.join(least, "u").select(stars.alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        now = materialize(small, f"{label}-edges", parts=parts)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id): one row per row of docs."""
    fp = "fp"
    base = docs.select(quoted(key).alias("id"), quoted(text).alias("text"))
    prints = materialize(fingerprints(base, "text", fp), "simhash-prints")
    distinct = materialize(prints.groupBy(fp).agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select(fp))).withColumnRenamed("node", fp)
    rooted = distinct.join(roots, fp, "left").withColumn("root", F.coalesce("root", fp))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select(fp, "component_id")
    hexed = F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint")
    return prints.join(classes, fp).select(F.col("id").alias(key), hexed, "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of docs that hold the smallest key of their component.

    Without a similarity fingerprints of three-word shingles link; with one, texts that are so similar by
    the Jaccard measure of their shingles, found by fingerprints first and completely then (see similar.py).
    """
    if similarity is None:
        classes = near_duplicates(docs, key, text)
    else:
        from . import similar

        classes = similar.near_duplicates(docs, key, text, words, similarity)
    # what goes is less than what stays: its keys are sent to the rows, so that no text is moved, unless there are too many
    gone = free_name(docs, "gone_key")
    drop = classes.filter(~quoted(key).eqNullSafe(F.col("component_id"))).select(quoted(key).alias(gone)).distinct()
    drop = materialize(drop, "simhash-gone")
    return docs.join(F.broadcast(drop) if drop.count() <= SENT else drop, quoted(key).eqNullSafe(quoted(gone)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
