"""SimHash near-duplicates with a similarity: links all pairs with a Jaccard similarity of at least `similarity`.

The whole form of simhash.one_of_each, for the pipeline. Fingerprints within three bits find the nearest
copies through the vantage-point trees; an exact check of the shingle sets follows. Fingerprints alone would miss
most pairs at 0.8 (they differ in about ten bits there), so the search is then completed: a text is the
set of the hashes of its lower-cased word shingles, texts with one set are one node, and two similar sets share one of
their first n - ceil(similarity * n) + 1 hashes in any order that is common to all sets, so an index of
these prefixes holds every pair. The order puts frequent shingles last, which decides the speed only:
a passage that many texts share then stands in no prefix, unless it makes up most of the text.

Large groups don't become all their pairs: first every node is compared with its nearest smallest
node of a list, then, while lists are long, in rounds with some drawn from its lists; what is in one component by then
needs no further comparison. Of the nodes of different components that meet in a list all pairs are compared, in the task that
holds the list or two blocks of it; only those that the bounds leave become rows. A pair first passes bounds that no similar pair fails: what stands before
the shared hash in either set can't be shared if it is the first shared one, so it tells how much can be (a
large group whose texts each have too much of their own drops out of its lists so, before any pair is
made); parity sketches differ in at most as many cells as the sets do in elements. Then the exact count on
the texts decides. Texts are read again where they are needed and never copied for all documents.

Defined cases: texts of fewer words have one shingle; texts without words are alike; null counts as
empty; a null key takes part but is never the smallest unless the whole component has none; an empty
table gives an empty result. Hashes and names of sets and texts have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, quoted, scratch
from .simhash import _LOWER, _WEIGHTS, components, links

WORDS, SIMILARITY = 5, 0.8
#: Shingles counted at a time, and the counts from which a shingle goes last; they decide the speed only.
COUNTED, SEEN, FREQUENT, MOST = 500_000, 3, 32, 100_000
#: Texts worked on at a time.
ROWS = 500
#: Documents for each file of a table that is written on the way, at least.
PER_FILE = 5_000
#: Cells of a sketch at least.
CELLS = 128
#: Rounds in which nodes of lists that hold over LONG nodes, weighted by their nodes, meet others, at most; others that a
#: node meets in a round. They decide the speed only.
DRAWS, LONG, CENTERS = 12, 50, 8
#: Nodes of a list that meet in a task, on average; pairs that are compared at a time.
BLOCK, PAIRS = 2048, 100_000
#: Names of texts that are sent to the tasks that read them; more of them meet in a shuffle.
SENT = 2_000_000


def shingles(text: bytes, words: int, repeats: bool = False) -> np.ndarray:
    """The sorted distinct hashes of the word shingles; or all of them, in order."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(words, len(tokens)) - 1
    hashed = xxhash.xxh64_intdigest
    found = np.fromiter((hashed(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[last:].tolist())), np.uint64)
    return found if repeats else np.unique(found)


def _fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, repeats included."""
    ones = sum((np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(0, len(hashes), 65536)), np.zeros(64, np.int64))
    return int(_WEIGHTS[2 * ones > len(hashes)].sum(dtype=np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """The parities of the counts in as many cells as the set has elements, rounded up to a power of two."""
    cells = max(CELLS, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """In how many cells sketches differ, the longer ones folded to the length of the shorter."""
    lengths = np.array([list(map(len, one)), list(map(len, two))], np.int64)
    out = np.zeros(len(one), np.int64)
    for x, y in np.unique(lengths, axis=1).T:
        at = np.flatnonzero((lengths[0] == x) & (lengths[1] == y))
        pair = [np.frombuffer(b"".join(side[i] for i in at), np.uint8).reshape(len(at), -1) for side in (one, two)]
        while pair[0].shape[1] != pair[1].shape[1]:
            k = int(pair[1].shape[1] > pair[0].shape[1])
            half = pair[k].shape[1] // 2
            pair[k] = pair[k][:, :half] ^ pair[k][:, half:]
        out[at] = np.bitwise_count(pair[0] ^ pair[1]).sum(axis=1, dtype=np.int64)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, tid, node, n, sketch s, fp) of docs (id, tid, text); also rows with n < 0: shingle `node` stands in -n texts of some."""
    schema = docs.drop("text").withColumns({"node": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "s": F.lit(None).cast("binary"), "fp": F.lit(None).cast("long")}).schema
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    names = [f.name for f in schema]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            some, counts = np.unique(np.concatenate(held), return_counts=True)
            some, counts = some[counts >= SEEN], counts[counts >= SEEN]
            held.clear()
            none = [pa.nulls(len(some), kind) for kind in (own, pa.int64(), pa.binary(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none[:2], pa.array(some.view(np.int64)), pa.array(-counts, pa.int64()), *none[2:]], names=names)

        for batch in _pieces(batches):
            own, nodes, sizes, sketches, prints = batch.schema.field("id").type, [], [], [], []
            for t in batch.column(2):
                whole = shingles(t.as_py() or b"", words, repeats=True)
                h = np.unique(whole)
                prints.append(_fingerprint(whole))
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), 42))
                sizes.append(len(h))
                sketches.append(sketch(h))
                held.append(h)
            size += sum(sizes)
            whole = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), whole[0], pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), whole[1]], names=names)
            if size > COUNTED:
                yield counted()
                size = 0
        if held:
            yield counted()

    return docs.mapInArrow(work, schema)


def _index(docs: DataFrame, words: int, least: Fraction, frequent: np.ndarray) -> DataFrame:
    """(h, node, n, p): every set, with its size, under the hashes of its prefix, each with its place in the order."""
    known = docs.sparkSession.sparkContext.broadcast(np.sort(frequent))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.append(known.value, known.value[-1:] if len(known.value) else np.uint64(0))
        for batch in _pieces(batches):
            rows, nodes, sizes = [], [], []
            for t in batch.column(0):
                h = shingles(t.as_py() or b"", words)
                common = last[np.searchsorted(last[:-1], h)] == h if len(last) > 1 else np.zeros(len(h), bool)
                rows.append(np.concatenate([h[~common], h[common]])[: len(h) - -(-least.numerator * len(h) // least.denominator) + 1 if len(h) else 0])
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), 42))
                sizes.append(len(h))
            each = np.fromiter(map(len, rows), np.int64, len(rows))
            hashes = np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)
            own = np.array(nodes, np.uint64).view(np.int64)
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(each) - each, each)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.repeat(own, each)), pa.array(np.repeat(np.array(sizes, np.int32), each)), pa.array(place.astype(np.int32))], names=["h", "node", "n", "p"])

    return docs.select("text").mapInArrow(work, "h long, node long, n int, p int")


def _lists(index: DataFrame) -> DataFrame:
    """(h, node, n, p, center, size, place): the lists of at least two nodes, with their smallest, its size and place; one shuffle, and no list is held."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h0 = center = last = None
        alone = False
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            hs = columns[0]
            if not len(hs):
                continue
            # most hashes stand once: only rows next to one of the same hash are looked at, and those at the ends
            same = np.concatenate([[False], hs[1:] == hs[:-1], [False]])
            look = np.flatnonzero(same[1:] | same[:-1] | (np.arange(len(hs)) % max(1, len(hs) - 1) == 0))
            out = []
            for h, node, n, p in zip(*(c[look].tolist() for c in columns)):
                if h != h0:
                    h0, center, last, alone = h, (node, n, p), node, True
                elif node != last:
                    out += [(h, *center, *center)] if alone else []
                    out.append((h, node, n, p, *center))
                    last, alone = node, False
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["h", "node", "n", "p", "center", "size", "place"])

    return index.repartition("h").sortWithinPartitions("h", "node").mapInArrow(work, "h long, node long, n int, p int, center long, size int, place int")


def _near(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """(a, b, differ) for those of pairs (a, b) that the bounds leave."""
    p, q = least.numerator, least.denominator

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            differ = differing(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            stay = ((q + p) * differ <= (q - p) * (n + m)) & (q * np.minimum(n, m) >= p * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([pa.array(a[stay]), pa.array(b[stay]), pa.array(differ[stay])], names=["a", "b", "differ"])

    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("s").alias("s"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("s").alias("t"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "s", "t").mapInArrow(near, "a long, b long, differ long")


def _across(meet: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """(a, b): the pairs of different roots that the bounds leave, out of the lists (h, node, n, p, root).

    Lists meet in tasks, long ones in pairs of blocks. A pair comes out of the first list that holds both, so it comes once and no
    further pairs are made: its entries bring the hashes that stand before them in other lists.
    """
    p, q = least.numerator, least.denominator

    def pairs(n, place, root, left, right):
        """Rows and columns of those of left x right that can be similar by their places in the list."""
        for at in range(0, len(left), 256):
            x, y = np.ix_(left[at : at + 256], right)
            both = np.minimum(n[x] - place[x], n[y] - place[y])
            can = (root[x] != root[y]) & ((p + q) * both >= p * (n[x] + n[y])) & (q * np.minimum(n[x], n[y]) >= p * np.maximum(n[x], n[y]))
            if left is right:
                can &= x < y
            i, j = np.nonzero(can)
            yield left[at : at + 256][i], right[j]

    def near(rows: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, n, place, root, low, block = (rows.column(name).to_numpy() for name in ("node", "n", "p", "root", "low", "block"))
        n, place, sketches, before, held = n.astype(np.int64), place.astype(np.int64), rows.column("s").to_pylist(), {}, []
        known = rows.column("before").combine_chunks()
        starts, hashes = known.offsets.to_numpy(), known.values.to_numpy()

        def earlier(i):
            if i not in before:
                before[i] = frozenset(hashes[starts[i] : starts[i + 1]].tolist())
            return before[i]

        def checked():
            x, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held.clear()
            for at in range(0, len(x), PAIRS):
                i, j = x[at : at + PAIRS], y[at : at + PAIRS]
                differ = differing([sketches[k] for k in i.tolist()], [sketches[k] for k in j.tolist()])
                stay = (q + p) * differ <= (q - p) * (n[i] + n[j])
                i, j = i[stay], j[stay]
                first = np.fromiter((earlier(k).isdisjoint(earlier(m)) for k, m in zip(i.tolist(), j.tolist())), bool, len(i))
                one, two = node[i[first]], node[j[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

        size = 0
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own, other = (np.arange(start, end)[side] for side in (block[start:end] == low[start:end], block[start:end] != low[start:end]))
            for found in pairs(n, place, root, own, other if rows.column("high")[start].as_py() != low[start] else own):
                held.append(found)
                size += len(found[0])
                if size > PAIRS:
                    yield from checked()
                    size = 0
        if held:
            yield from checked()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest else rows
            keys = [rows.column(name).to_numpy() for name in ("h", "low", "high")]
            cuts = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1])
            if len(cuts) > 1:  # the last list may go on
                yield from near(rows.slice(0, cuts[-1]).combine_chunks(), cuts)
            rest = rows.slice(cuts[-1]).combine_chunks()
        if rest:
            yield from near(rest, np.array([0, rest.num_rows]))

    own = meet.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("p", "h"))).alias("x")).join(sets.select("node", "s"), "node")
    each = own.select("node", "n", "root", "s", F.col("x.h").alias("hs"), F.posexplode("x").alias("at", "x"))
    each = each.select("node", "n", "root", "s", "x.h", "x.p", F.slice("hs", 1, F.col("at")).alias("before"))
    long_ = meet.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > BLOCK)
    block, low, high = F.lit(0).alias("block"), F.lit(0).alias("low"), F.lit(0).alias("high")
    if long_.count():
        blocks = F.coalesce(F.ceil(F.col("k") / BLOCK), F.lit(1)).cast("int")
        each = each.join(long_, "h", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        each = each.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        block, low, high = F.col("block"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    dealt = each.select("h", low, high, block, "node", "n", "p", "root", "s", "before").repartition("h", "low", "high").sortWithinPartitions("h", "low", "high")
    return dealt.mapInArrow(work, "a long, b long")


def _similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, least: Fraction, label: str, parts: int) -> DataFrame:
    """Those of the written pairs (a, b) that are similar, by their texts."""
    p, q = least.numerator, least.denominator

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, None
        for batch in _pieces(batches):
            stay = []
            for x, s, t in zip(batch.column(0), batch.column(2), batch.column(3)):
                if x != name:
                    name, own = x, shingles(s.as_py() or b"", words)
                other = shingles(t.as_py() or b"", words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                stay.append(q * both >= p * (len(own) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    touched = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialize(sets.select("node", "tid").join(touched, "node", "left_semi"), f"{label}-wanted", parts=parts)
    wanted = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    # rows with one text have one tid: any of them gives the text
    texts = materialize(docs.select("tid", "text").join(wanted, "tid").dropDuplicates(["node"]).select("node", "text"), f"{label}-texts", parts=parts)
    one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(y)) for x, y in (("a", "s"), ("b", "t")))
    return materialize(pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "s", "t").mapInArrow(exact, "a long, b long"), f"{label}-links", parts=parts)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, component_id): one row per row of docs; what it writes on the way is removed again."""
    with scratch(docs.sparkSession):
        return materialize(_classes(docs, key, text, words, Fraction(str(similarity))), "similar-classes", outlive=True)


def _classes(docs: DataFrame, key: str, text: str, words: int, least: Fraction) -> DataFrame:
    whole = F.coalesce(quoted(text), F.lit(""))
    base = docs.select(quoted(key).alias("id"), F.xxhash64(whole).alias("tid"), whole.cast("binary").alias("text"))
    made = materialize(_sets(base, words), "similar-sets")
    rows = made.filter("n >= 0")
    parts = -(-max(1, rows.count()) // PER_FILE)
    written = partial(materialize, parts=parts)
    sets = written(rows.groupBy("node").agg(F.min("tid").alias("tid"), F.max("n").alias("n"), F.first("s").alias("s"), F.min("fp").alias("fp")), "similar-nodes")
    rooted = lambda lists, roots: lists.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").drop("_node").withColumn("root", F.coalesce("root", "node"))

    # fingerprints within three bits, and sets that share one
    ends = sets.groupBy("fp").agg(F.min("node").alias("node"))
    same = sets.join(ends.withColumnRenamed("node", "a"), "fp").select("a", F.col("node").alias("b"))
    far = links(ends.select("fp")).join(ends.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(ends.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    pairs = same.unionByName(far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).filter("a <> b").distinct()
    near = written(_near(pairs, sets, least), "similar-near")
    found = _similar(near, sets, base, words, least, "similar-prints", parts)
    roots = components(found, "similar", parts)

    often = made.filter("n < 0").groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") <= -FREQUENT).orderBy("n", "node").limit(MOST)
    frequent = np.array([r[0] for r in often.select("node").collect()], np.int64).view(np.uint64)
    lists = written(_lists(_index(base, words, least, frequent)), "similar-lists")
    t, over = least.numerator, least.numerator + least.denominator
    # similar sets of n and m elements share t / (1 + t) of n + m; from the places p and q on they share n - p or m - q at most
    shared = lambda left, sizes: over * left.cast("long") >= t * sizes.cast("long")
    can = lambda n, p, m, q: shared(F.least(F.col(n) - F.col(p), F.col(m) - F.col(q)), F.col(n) + F.col(m)) & (least.denominator * F.least(n, m) >= t * F.greatest(n, m))

    # each node with the nearest smallest node of its lists
    stars = rooted(lists.filter("node <> center").filter(can("n", "p", "size", "place")).select(F.col("center").alias("a"), "node").distinct(), roots)
    stars = rooted(stars.select(F.col("node").alias("b"), F.col("root").alias("r"), F.col("a").alias("node")), roots).filter("root <> r").select(F.col("node").alias("a"), "b")
    best = _near(stars, sets, least).groupBy("b").agg(F.min(F.struct("differ", "a")).alias("x")).select("x.a", "b")
    found = found.unionByName(_similar(written(best, "similar-near"), sets, base, words, least, "similar-stars", parts))
    roots = components(found, "similar", parts)

    # what still meets in a list with another component
    def meeting(roots: DataFrame) -> DataFrame:
        known = written(rooted(lists.select("h", "node", "n", "p"), roots), "similar-rooted")
        open_ = known.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least")).filter("low < high").select("h", "least")
        # of a list those stay that could share enough with its smallest set, or with the smallest that could be similar
        smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * t / least.denominator))
        return written(known.join(open_, "h").filter(shared(F.col("n") - F.col("p"), F.col("n") + smallest)).drop("least"), "similar-meet")

    meet = meeting(roots)
    # a large group first joins by rounds in which each node meets some others of its lists, drawn anew
    for draw in range(DRAWS):
        held = meet.groupBy("h").agg(F.count(F.lit(1)).cast("double").alias("k")).agg(F.sum("k"), F.sum(F.col("k") * F.col("k")))
        (entries, squares), nodes = held.first(), meet.agg(F.count_distinct("node")).first()[0]
        if not nodes or squares <= LONG * entries:
            break
        some = meet.filter(F.pmod(F.xxhash64("h", F.lit(draw)), F.lit(max(1, int(entries) // (CENTERS * nodes)))) == 0)
        drawn = some.groupBy("h").agg(F.min_by(F.struct("node", "n", "p", "root"), F.xxhash64("h", "node", F.lit(draw))).alias("c"))
        drawn = drawn.select("h", F.col("c.node").alias("a"), F.col("c.n").alias("size"), F.col("c.p").alias("place"), F.col("c.root").alias("r"))
        tried = some.join(drawn, "h").filter((F.col("root") != F.col("r")) & can("n", "p", "size", "place")).select("a", F.col("node").alias("b")).distinct()
        best = _near(tried, sets, least).groupBy("b").agg(F.min(F.struct("differ", "a")).alias("x")).select("x.a", "b")
        more = _similar(written(best, "similar-near"), sets, base, words, least, "similar-drawn", parts)
        found = found.unionByName(more)
        roots = components(found, "similar", parts)
        meet = meeting(roots)
        if more.count() * 50 < nodes:
            break
    near = written(_across(meet, sets, least), "similar-near")
    found = found.unionByName(_similar(near, sets, base, words, least, "similar-rest", parts))

    roots = components(found, "similar", parts)
    classes = rooted(rows.groupBy("node").agg(F.min("id").alias("least")), roots)
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("id", "node").join(classes.join(smallest, "root").select("node", "component_id"), "node").select(F.col("id").alias(key), "component_id").coalesce(parts)
