import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from factweave.llm import simhash

from .data import DOCS, WORD, documents


def fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("leaf", [4, 100_000])
def test_near_duplicates_against_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "SHARD", 2 * leaf)
    rows = documents(80)
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    prints = [fingerprint(t) for _, t, *_ in rows]
    least = defaultdict(list)
    for (i, *_), root in zip(rows, found := roots(prints)):
        if i is not None:
            least[root].append(i)
    want = [(i, f"{p:016x}", min(least[r], default=None)) for (i, *_), p, r in zip(rows, prints, found)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


@pytest.mark.parametrize("leaf", [2, 16])
def test_links_of_clustered_and_chained_fingerprints(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "SHARD", 2 * leaf)
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for seed in list(prints)[:10]:
        for _ in range(15):  # chains that wander away from their seed
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                seed ^= 1 << bit
            prints.add(seed)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    got = {np.int64(r.node).astype(np.uint64).item(): r.root for r in simhash.components(simhash.links(df)).collect()}
    classes, want = defaultdict(set), defaultdict(set)
    for p, r in zip(prints, roots(prints)):
        want[r].add(p)
        classes[got.get(p, ("alone", p))].add(p)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("agree", [0.5, 0.9, 1.0])
def test_parts_are_bounded_and_lose_no_pair(agree):
    """Fingerprints of which each bit is set with that probability; with 1.0 all agree in the low half."""
    rng = np.random.default_rng(3)
    bits = rng.random((6000, 64)) < agree
    if agree == 1.0:
        bits[:, :32] = rng.random((6000, 32)) < 0.5
    fps = np.unique(np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel())
    fps = np.unique(np.concatenate([fps, fps[:300] ^ np.uint64(0b1001), fps[300:600] ^ np.uint64(1 << 63 | 1 << 40)]))
    seen = {0: set(), 1: set()}
    for half in (0, 1):
        sizes = []
        for part in simhash.parts(fps, half):
            sizes.append(len(part))
            near = np.argwhere(np.triu(np.bitwise_count(part[:, None] ^ part[None, :]) <= 3, 1))
            seen[half] |= {(int(min(part[i], part[j])), int(max(part[i], part[j]))) for i, j in near}
        assert max(sizes) <= simhash.LEAF and sum(sizes) < 4 * len(fps)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
    assert seen[0] | seen[1] == {(int(fps[i]), int(fps[j])) for i, j in near}


def test_the_upper_tree_parts_skewed_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 500)
    rng = np.random.default_rng(4)
    fps = np.unique(np.packbits(rng.random((8000, 64)) < 0.9, axis=1).view(">u8").astype(np.uint64).ravel())
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    tree = simhash.grow(df, len(fps))
    _, leaf = tree.leaves(fps)
    sizes = np.unique(leaf, return_counts=True)[1]
    # what crowds around one point is parted least
    assert sizes.max() < len(fps) // 4 and np.median(sizes) <= 500 and len(set(tree.points.tolist())) > 10


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1300)}


def test_one_of_each_keeps_columns(spark):
    rows = [(3, "a b c d", 1), (2, "a b c d", 2), (2, "a b c d", 2), (9, "z y x w v", 3), (None, None, 4)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, component_id int"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(2, "a b c d", 2), (2, "a b c d", 2), (9, "z y x w v", 3), (None, None, 4)], key=repr)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("held", [0, 10**6])
def test_components_of_few_edges_write_few_tables(spark, monkeypatch, held):
    rng = random.Random(8)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    tables, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label, **more: tables.append(label) or write(df, label, **more))
    monkeypatch.setattr(simhash, "HELD", held, raising=False)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert len(tables) <= 2 or not held
