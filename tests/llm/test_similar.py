import random

import corpus_pipeline
import numpy as np
import pytest

from factweave.llm import similar, simhash
from factweave.llm.common import materialize

from .data import DOCS, documents


def components(texts, words=5, least=0.8):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) * 10 >= round(least * 10) * len(a | b):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_sketches_of_any_length_bound_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 1, 100, 130, 4000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 2**64, len(s) // 10, dtype=np.uint64)])) for s in sets]
    pairs = [(a, b) for a in sets for b in sets]
    found = similar.differing([similar.sketch(a) for a, _ in pairs], [similar.sketch(b) for _, b in pairs])
    apart = [len(np.setxor1d(a, b)) for a, b in pairs]
    assert all(d <= x for d, x in zip(found, apart))
    other = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
    assert similar.differing([similar.sketch(sets[4])], [similar.sketch(other)])[0] > 8000 / 9  # unlike long sets are told apart


def edited():
    """Chains of edits, a passage in many texts, and short texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for k in range(12):
        words = [word() for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(8):
            texts.append(" ".join(words))
            for _ in range(max(1, len(words) // rng.choice([40, 60, 90]))):
                words[rng.randrange(len(words))] = word()
    texts += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(20)]) for _ in range(50)]
    return texts + ["a b", "A  b", "a b c d e", "a b c d e f", "", None]


@pytest.mark.parametrize("frequent", [2, 10**9])
def test_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    texts = edited() + [r[1] for r in documents(30) if r[1] is None or len(r[1]) < 20_000]
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    least = {}
    for i, root in enumerate(found := components(texts)):
        least.setdefault(root, i)
    assert got == {i: least[root] for i, root in enumerate(found)}


def test_the_stage_drops_what_fingerprints_miss(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(12):
        mine = list(words)
        for at in rng.sample(range(300), 2 if i else 0):
            mine[at] = f"x{i}"
        rows.append((i, " ".join(mine), "en", "s", None))
    df = spark.createDataFrame(rows, DOCS)
    assert simhash.one_of_each(df).count() > 1
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()] == [0]


def test_few_documents_make_few_files(spark, monkeypatch):
    """However many partitions shuffles have; every file that a task writes costs the executor processes on a local file system."""
    files, settings = {}, {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def counted(df, label, *more, **named):
        out = materialize(df, label, *more, **named)
        files[label] = max(len(out.inputFiles()), files.get(label, 0))
        return out

    monkeypatch.setattr(similar, "materialize", counted)
    monkeypatch.setattr(simhash, "materialize", counted)
    before = {k: spark.conf.get(k) for k in settings}
    texts = edited()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in similar.near_duplicates(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    least = {}
    for i, root in enumerate(found := components(texts)):
        least.setdefault(root, i)
    assert got == {i: least[root] for i, root in enumerate(found)}
    assert {"similar-edges", "similar-lists", "similar-nodes", "similar-rest-links"} <= files.keys()
    assert all(n <= 1 for label, n in files.items() if label != "similar-sets"), files


@pytest.mark.parametrize("block", [7, 10**6])
def test_a_large_group_is_not_joined_pair_by_pair(spark, monkeypatch, block):
    """Variants of one text, about as often similar as not: their pairs are compared in the tasks, in blocks if a list is long."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(9000)}" for _ in range(150)]
    texts = []
    for i in range(160):
        mine = list(words)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4])):
            mine[at] = f"x{rng.randrange(9000)}"
        texts.append(" ".join(mine))
    joined, near, made, exact = [], similar._near, [], similar._similar

    def counted(pairs, *more):
        joined.append(pairs.count())
        return near(pairs, *more)

    def seen(pairs, *more):
        made.extend((r.a, r.b) for r in pairs.collect() if more[-2] == "similar-rest")
        return exact(pairs, *more)

    monkeypatch.setattr(similar, "_near", counted)
    monkeypatch.setattr(similar, "_similar", seen)
    monkeypatch.setattr(similar, "DRAWS", 0 if block == 7 else 1, raising=False)
    monkeypatch.setattr(similar, "BLOCK", block, raising=False)
    monkeypatch.setattr(similar, "PAIRS", 100, raising=False)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    least = {}
    for i, root in enumerate(found := components(texts)):
        least.setdefault(root, i)
    assert got == {i: least[root] for i, root in enumerate(found)}
    assert made and len(made) == len(set(made))
    assert sum(joined) < 10 * len(texts), joined
