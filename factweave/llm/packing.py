"""Best-fit packing into sequences of several permitted lengths.

Best-fit decreasing sees lengths only, and lengths are at most the longest permitted sequence L
(longer documents are first cut into pieces of L). So the plan is made from a histogram of at most
L rows, however many documents there are: runs of equal lengths go into runs of equal bins, and the
number of recorded runs is bound by L * L and in practice near L. The balanced tree over remaining
capacities is a bitmap tree with one leaf per capacity. The documents are ranked by length with a
range partitioning (a hot length spreads over tasks) and look up their run in the broadcast plan.

When no open bin takes a piece, the bin size is opened whose cost per token that it can expect to hold is least;
what it can expect is the piece's own copies plus what the shorter pieces still to come can fill. In the end each
bin shrinks to the least permitted length that holds its contents.

`pack` places all documents at once and returns places; `sequences` lays the texts out, for a table in
reading order (as mixing leaves it): every stretch of BLOCK_TOKENS tokens of a task's rows is packed by itself,
so the blocks of the mix stay together, nothing is shuffled and a task holds one block.

Defined cases: null and empty texts are one token long (the end of the document); repeated rows are
packed each; a null key sorts first; an empty table gives an empty result; columns that clash with the
added ones stay, the added ones get underscores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, global_rank, materialize, quoted, table
from .mixing import BLOCK_TOKENS, token_count

#: Permitted sequence lengths in tokens, of the query and of the pipeline.
LENGTHS = (512, 1024, 2048, 4096)

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def default_cost(length: int, longest: int) -> float:
    """Linear in the tokens plus a quadratic share, as attention over a sequence costs."""
    return length * (1 + length / (8 * longest))


class RoomTree:
    """A complete binary tree over capacities 0..top; finds the least capacity >= x that has bins."""

    def __init__(self, top: int):
        self.width = 1 << max(1, top.bit_length())
        self.full = [False] * (2 * self.width)

    def set(self, room: int, full: bool) -> None:
        at = room + self.width
        self.full[at] = full
        while at > 1:
            at >>= 1
            full = self.full[2 * at] or self.full[2 * at + 1]
            if self.full[at] == full:
                break
            self.full[at] = full

    def tightest(self, room: int) -> int | None:
        at = room + self.width
        if room >= self.width:
            return None
        if self.full[at]:
            return room
        while at > 1:
            if at % 2 == 0 and self.full[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.full[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def pack_lengths(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, cost=default_cost):
    """(runs, bins) for {piece length: count}.

    runs: (first rank, pieces, first bin, copies per bin, offset in the bin, length), by rank; pieces rank from
    the longest down. bins: (first bin, count, permitted length, contents), by first bin.
    """
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    mass = np.zeros(longest + 1, np.int64)
    for size, n in histogram.items():
        mass[size] = size * n
    mass = np.cumsum(mass).tolist()  # tokens in pieces up to that length
    tree, open_, runs, rank, n_bins = RoomTree(longest), {}, [], 0, 0

    def put(room, group):
        if not open_.setdefault(room, []):
            tree.set(room, True)
        open_[room].append(group)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                def per_token(c, size=size, left=left):
                    own = min(c // size, left)
                    slack = c - own * size
                    opened = -(-left // own)
                    return cost(c, longest) / (own * size + min(slack, mass[min(slack, size - 1)] / opened)), c

                room = min((c for c in lengths if c >= size), key=per_token)
                count = -(-left // (room // size))
                group = (n_bins, count, room)
                n_bins += count
            else:
                group = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            first, count, permitted = group
            copies = room // size
            filled = min(count, left // copies)
            if filled:
                runs.append((rank, filled * copies, first, copies, permitted - room, size))
                put(room - copies * size, (first, filled, permitted))
                rank, left, first, count = rank + filled * copies, left - filled * copies, first + filled, count - filled
            if count and left and left < copies:
                runs.append((rank, left, first, left, permitted - room, size))
                put(room - left * size, (first, 1, permitted))
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            if count:
                put(room, (first, count, permitted))
    bins = [(first, count, min(c for c in lengths if c >= max(1, permitted - room)), permitted - room) for room, groups in open_.items() for first, count, permitted in groups]
    return runs, sorted(bins)


def pieces(docs: DataFrame, tokens: str, longest: int, piece: str, start: str, length: str) -> DataFrame:
    """docs with a row for each piece of at most `longest` tokens."""
    last = ((quoted(tokens) - 1) / longest).cast("int")
    out = docs.withColumn(piece, F.explode(F.sequence(F.lit(0), last)))
    out = out.withColumn(start, F.col(piece).cast("long") * longest)
    return out.withColumn(length, F.least(F.lit(longest).cast("long"), quoted(tokens) - F.col(start)))


def pack(docs: DataFrame, key: str = "doc_id", tokens: str = "n_tokens", lengths: tuple[int, ...] = LENGTHS, cost=default_cost) -> DataFrame:
    """docs' rows by piece, with piece, piece_start, piece_tokens, bin_id, bin_length and bin_offset.

    tokens must be a long of at least 1.
    """
    spark = docs.sparkSession
    longest = max(lengths)
    piece, start, length, rank, place = (free_name(docs, x) for x in ("piece", "piece_start", "piece_tokens", "rank", "place"))
    cut = pieces(docs, tokens, longest, piece, start, length)
    ranked = global_rank(cut, [F.col(length).desc(), quoted(key), F.col(piece)], rank, "packing")
    histogram = {int(r[0]): int(r[1]) for r in ranked.groupBy(length).agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, bins = pack_lengths(histogram, lengths, cost)
    plan = spark.sparkContext.broadcast((np.array(runs, np.int64).reshape(-1, 6), np.array(bins, np.int64).reshape(-1, 4)))

    @F.pandas_udf("bin_id long, bin_length int, bin_offset int")
    def placed(ranks: pd.Series) -> pd.DataFrame:
        runs, bins = plan.value
        ranks = ranks.to_numpy()
        first, _, bin_, copies, offset, size = runs[np.searchsorted(runs[:, 0], ranks, side="right") - 1].T
        at = bin_ + (ranks - first) // copies
        permitted = bins[np.searchsorted(bins[:, 0], at, side="right") - 1, 2]
        return pd.DataFrame({"bin_id": at, "bin_length": permitted.astype(np.int32), "bin_offset": (offset + (ranks - first) % copies * size).astype(np.int32)})

    out = ranked.withColumn(place, placed(F.col(rank)))
    added = (F.col(f"{place}.{c}").alias(free_name(docs, c)) for c in ("bin_id", "bin_length", "bin_offset"))
    return out.select(*(quoted(c) for c in docs.columns), piece, start, length, *added)


def cut(text: bytes, longest: int) -> Iterator[tuple[int, bytes]]:
    """(tokens, slice) of the pieces of a text, which together are the text; the last has one token more, its end."""
    n = len(text.split())
    if n < longest:
        yield n + 1, text
        return
    start = 0
    for i, word in enumerate(_WORD.finditer(text), 1):
        if i % longest == 0:
            yield longest, text[start : word.end()]
            start = word.end()
    yield n % longest + 1, text[start:]


def lay_out(sizes: list[int], lengths: tuple[int, ...], cost) -> list[tuple[int, list[tuple[int, int]]]]:
    """(permitted length, [(item, offset)]) of each bin for items of these sizes."""
    runs, bins = pack_lengths(dict(Counter(sizes)), lengths, cost)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    held: dict[int, list[tuple[int, int]]] = {}
    for first, n, bin_, copies, offset, size in runs:
        for k in range(n):
            held.setdefault(bin_ + k // copies, []).append((order[first + k], offset + k % copies * size))
    permitted = {first + i: length for first, count, length, _ in bins for i in range(count)}
    return [(permitted[b], sorted(items, key=lambda x: x[1])) for b, items in sorted(held.items())]


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = LENGTHS, cost=default_cost, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(bin_id, bin_length, n_tokens, doc_ids, pieces, texts): one row per sequence, its pieces in order.

    texts holds the pieces' own text, white space included; a piece with `ends` is followed by the end of its document.
    """
    kind = docs.schema[key].dataType
    piece_type = T.StructType.fromDDL("piece int, n_tokens int, bin_offset int, ends boolean")
    schema = T.StructType([
        *T.StructType.fromDDL("bin_id long, bin_length int, n_tokens int").fields, T.StructField("doc_ids", T.ArrayType(kind)),
        T.StructField("pieces", T.ArrayType(piece_type)), T.StructField("texts", T.ArrayType(T.StringType())),
    ])
    longest = max(lengths)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bin_id, held, tokens, key_type = TaskContext.get().partitionId() << 33, [], 0, None
        arrow_piece = pa.struct([("piece", pa.int32()), ("n_tokens", pa.int32()), ("bin_offset", pa.int32()), ("ends", pa.bool_())])

        def packed():
            nonlocal bin_id
            bins = lay_out([h[2] for h in held], lengths, cost)
            for at in range(0, len(bins), 256):
                some = bins[at : at + 256]
                rows = [[held[i] for i, _ in items] for _, items in some]
                places = [[{"piece": held[i][1], "n_tokens": held[i][2], "bin_offset": offset, "ends": held[i][3]} for i, offset in items] for _, items in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(bin_id, bin_id + len(some)), pa.int64()), pa.array([length for length, _ in some], pa.int32()),
                    pa.array([sum(h[2] for h in r) for r in rows], pa.int32()), pa.array([[h[0] for h in r] for r in rows], pa.list_(key_type)),
                    pa.array(places, pa.list_(arrow_piece)), pa.array([[h[4] for h in r] for r in rows], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                ], names=[f.name for f in schema])
                bin_id += len(some)

        for batch in batches:
            key_type = batch.column(0).type
            for id_, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                pieces_ = list(cut(raw.as_py() or b"", longest))
                for i, (n, part) in enumerate(pieces_):
                    held.append((id_, i, n, i == len(pieces_) - 1, part))
                    tokens += n
                if tokens >= block_tokens:
                    yield from packed()
                    held, tokens = [], 0
        if held:
            yield from packed()

    return docs.select(quoted(key), quoted(text).cast("binary")).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 512, 1024, 2048 or 4096 tokens; texts are counted once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", token_count().alias("n_tokens"))
    return pack(materialize(docs, "packing-tokens"))
