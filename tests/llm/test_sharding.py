import random
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.llm import sharding

from .data import DOCS, documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(20, 80))
def test_best_fit_decreasing_is_the_textbook_rule(sizes, capacity):
    sizes = sorted((min(s, capacity) for s in sizes), reverse=True)
    bins, expected = [], []
    for s in sizes:
        fits = [(capacity - sum(b), i) for i, b in enumerate(bins) if sum(b) + s <= capacity]
        at = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[at].append(s)
        expected.append((s, at))
    runs = sharding.best_fit_decreasing([(s, 1) for s in sizes], capacity)
    assert [x for s, n, at in runs for x in [(s, at)] * n] == expected


def test_runs_of_equal_sizes_equal_single_items():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 30) for _ in range(300)), reverse=True)
    runs = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
    spread = lambda found: [x for s, n, at in found for x in [(s, at)] * n]
    assert spread(sharding.best_fit_decreasing(runs, 64)) == spread(sharding.best_fit_decreasing([(s, 1) for s in sizes], 64))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 10_000), max_size=200))
def test_the_tree_finds_the_tightest(values):
    tree, held = sharding.BalancedTree(), set()
    for i, v in enumerate(values):
        tree.add((v, i))
        held.add((v, i))
        if i % 3 == 2:
            tree.remove(min(held))
            held.remove(min(held))
        assert tree.tightest(v // 2) == min((x for x in held if x[0] >= v // 2), default=None)


def test_a_group_above_an_even_share_gets_a_shard_and_the_rest_is_even():
    runs = sharding.plan_even([(9000, 1), *((s, 3) for s in range(1, 60))], 4)
    sums = [sum(s * n for s, n, at in runs if at == b) for b in range(4)]
    assert sums[0] == 9000 and max(sums[1:]) - min(sums[1:]) <= 59


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=40), st.integers(2, 5))
def test_the_capacity_is_the_least_that_the_bisection_can_trust(sizes, bins):
    """By brute force: plan_even's largest shard is that of the least capacity from which on best-fit decreasing fits,
    and no capacity below an even share was needed."""
    runs = sharding.plan_even([(s, sizes.count(s)) for s in set(sizes)], bins)
    sums = [0] * bins
    for s, n, at in runs:
        sums[at] += s * n
    assert sum(sums) == sum(sizes) and Counter(s for s, n, _ in runs for _ in range(n)) == Counter(sizes)
    alone = {at for s, n, at in runs if n == 1 and s * bins > sum(sizes)}
    if not alone:
        least = max(-(-sum(sizes) // bins), max(sizes))
        plain = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
        fits = [c for c in range(least, sum(sizes) + 1) if sharding.best_fit_decreasing(plain, c, bins) is not None]
        assert max(sums) <= max(c for c in fits if c == fits[0] or c - 1 not in fits)


def test_names_that_clash(spark):
    df = spark.range(20).select((F.col("id") % 3).alias("_key"), F.lit(2).cast("long").alias("_n"), F.lit(1).alias("_pid"), F.lit(1).alias("_first"))
    out = sharding.shard_groups(df, "_key", "_n", n_shards=2)
    assert out.columns == ["_key", "_n", "_pid", "_first", "shard", "slot"] and out.count() == 20


def test_all_documents_get_a_shard_and_a_slot(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.query(spark, str(tmp_path)).toPandas()
    assert len(out) == len(rows) and set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
    size = lambda t: len((t or "").encode()) + 1
    wanted = sorted((-1 if i is None else i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted(zip(out["doc_id"].fillna(-1).astype(int), out["size"], out["text_crc32"])) == wanted
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    groups = {}
    for i, t, *_ in rows:
        if i is not None:
            groups.setdefault(t, set()).add(i)
    shard = dict(zip(out["doc_id"], out["shard"]))
    assert all(len({shard[i] for i in ids}) == 1 for ids in groups.values())


def test_general_form_keeps_columns_and_capacity(spark):
    df = spark.range(100).select(F.col("id").alias("shard"), (F.col("id") % 10).alias("slot"), F.lit(7).cast("long").alias("gsize"))
    out = sharding.shard_groups(df, "slot", "gsize", capacity=150)
    assert {"shard", "slot", "gsize", "_shard", "_slot"} == set(out.columns) and out.count() == 100
    assert out.groupBy("_shard").agg(F.sum("gsize").alias("n")).filter("n > 150").isEmpty()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert sharding.query(spark, str(tmp_path)).count() == 0
