import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factweave.llm import mixing

from .data import DOCS, WORD, documents


def tokens(text):
    return len(WORD.findall(text or "")) + 1


def totals(rows):
    out = Counter()
    for _, t, _, source, _ in rows:
        out[source] += tokens(t)
    return out


def test_exponent_meets_the_repetition_limit(spark):
    sizes = [10, 55, 400, 9000]
    df = spark.createDataFrame([(f"s{n}", float(n), math.log(n)) for n in sizes], "source string, t double, ln_t double")
    for limit in (1.0, 1.5, 4.0, 1e9):
        a = mixing.find_exponent(df, repetition=limit)
        want = max(0.0, 1 - math.log(limit) / math.log(9000 / 10))
        assert want <= a + 1e-12 and a - want < 1e-5
        assert (9000 / 10) ** (1 - a) <= limit * (1 + 1e-9)


def test_exponent_meets_the_entropy(spark):
    sizes = [10, 55, 400, 9000]
    df = spark.createDataFrame([(f"s{n}", float(n), math.log(n)) for n in sizes], "source string, t double, ln_t double")

    def entropy(a):
        w = [n**a for n in sizes]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    for target in (0.5, 1.0, 1.3):
        a = mixing.find_exponent(df, entropy=target)
        assert entropy(a) >= target - 1e-9 and entropy(a + 1e-4) < target
    assert mixing.find_exponent(df, entropy=2.0) == 0.0
    assert mixing.find_exponent(df.limit(0), entropy=1.0) == 1.0
    with pytest.raises(ValueError):
        mixing.find_exponent(df)


def test_mix_keeps_all_and_repeats_within_the_limit(spark):
    rows = documents()
    out = mixing.mix(spark.createDataFrame(rows, DOCS), repetition=2.0, block_tokens=5000).toPandas()
    want = Counter((-1 if i is None else i, tokens(t)) for i, t, *_ in rows)
    got = Counter(zip(out["doc_id"].fillna(-1).astype(int), out["n_tokens"]))
    assert set(got) == set(want) and all(want[k] <= got[k] <= 2 * want[k] for k in want)
    size, mixed = totals(rows), out.assign(source=out["source"].fillna("-")).groupby("source")["n_tokens"].sum()
    largest = max(size, key=size.get)
    assert mixed[largest or "-"] == size[largest]
    longest = max(tokens(t) for _, t, *_ in rows)
    weight = {s or "-": w for s, w in zip(out["source"].where(out["source"].notna(), None), out["weight"])}
    budget = size[largest] / weight[largest or "-"]
    for source, n in mixed.items():
        assert budget * weight[source] - longest - 40 * 201 <= n <= budget * weight[source] * 1.0001 + 2


def test_blocks_have_the_sources_by_weight(spark):
    rows = [(i, f"word {i} x", None, "big" if i % 5 else "small", None) for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), repetition=2.0, block_tokens=2000).toPandas()
    blocks = out.groupby(["block", "source"])["n_tokens"].sum().unstack(fill_value=0)
    share = blocks["small"] / blocks.sum(axis=1)
    assert len(blocks) >= 8 and (abs(share - out[out.source == "small"]["weight"].iloc[0]) < 0.02).all()
    assert out.groupby("block")["n_tokens"].sum().between(1500, 2500).all()


def test_a_budget_below_the_corpus_is_kept(spark):
    rows = [(i, "a b c", None, f"s{i % 3}", None) for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), exponent=1.0, budget=600).toPandas()
    assert out.groupby("source")["n_tokens"].sum().tolist() == [200, 200, 200] and out["doc_id"].is_unique


def test_realise_agrees_with_mix_and_is_deterministic(spark):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS)
    counts = lambda frame: Counter(r[0] for r in frame.collect())
    real = mixing.realise(df)
    assert real.columns == df.columns
    assert counts(real.select("doc_id")) == counts(mixing.mix(df).select("doc_id")) == counts(mixing.realise(df.repartition(7)).select("doc_id"))
    clash = df.withColumns({"mix_pass": F.lit(1), "mix_h": F.lit(2)})
    assert mixing.realise(clash).columns == clash.columns


def plain_mix(rows, exponent, block_tokens):
    """The mix in plain Python, given the engine's hashes: (key, tokens, pass, block) of every row that is read."""
    size = totals([(r["key"], r["text"], None, r["source"], None) for r in rows])
    power = {s: (n / max(size.values())) ** exponent for s, n in size.items()}
    whole = max(size.values()) * sum(power.values())
    budget = {s: round(p / sum(power.values()) * whole) for s, p in power.items()}
    blocks = -(-sum(budget.values()) // block_tokens)
    out = []
    for s in size:
        for n in range(budget[s] // size[s] + 1):
            mine = sorted((r for r in rows if r["source"] == s), key=lambda r: r[f"h{n}"])
            at = 0
            for r in mine:
                at += tokens(r["text"])
                if n < budget[s] // size[s] or at <= budget[s] % size[s]:
                    out.append((r["key"], tokens(r["text"]), n, min(blocks - 1, int((n * size[s] + at - tokens(r["text"])) / budget[s] * blocks))))
    return sorted(out)


def test_the_mix_against_plain_python(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) + f" {i}", None, f"s{min(i % 13, 4)}", None) for i in range(500)]
    df = spark.createDataFrame(rows, DOCS)
    seeded = mixing._hashed(df, "doc_id", "text", mixing.SEED)
    hashed = df.select(F.col("doc_id").alias("key"), "text", "source", *(F.xxhash64(seeded, F.lit(n)).alias(f"h{n}") for n in range(6)))
    for exponent in (0.3, 1.0):
        out = mixing.mix(df, exponent=exponent, block_tokens=700).collect()
        assert sorted((r.doc_id, r.n_tokens, r["pass"], r.block) for r in out) == plain_mix([r.asDict() for r in hashed.collect()], exponent, 700)


def test_realise_leaves_the_rows_in_the_order_of_the_mix(spark, tmp_path):
    rows = [(i, f"word {i} x y z", None, "big" if i % 5 else "small", None) for i in range(4000)]
    df = spark.createDataFrame(rows, DOCS)
    mixing.realise(df, block_tokens=2000).write.parquet(str(tmp_path / "mix"))
    read = spark.read.parquet(str(tmp_path / "mix"))
    rows = read.select("doc_id", "source", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    small = [r.source == "small" for r in rows]
    share = sum(small) / len(small)
    for at in range(0, len(small) - 400, 400):  # every stretch has the sources by their weights
        assert abs(sum(small[at : at + 400]) / 400 - share) < 0.1
    once = mixing.realise(df.repartition(5), block_tokens=2000).select("doc_id").collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in once)


def test_no_python_on_the_main_path(spark):
    plan = mixing.mix(spark.createDataFrame(documents(20), DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(df).count() == 0 and mixing.realise(df).count() == 0
