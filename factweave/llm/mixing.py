"""Mixing sources by temperature, with DataFrame functions only.

Source i with t_i tokens gets the weight w_i = t_i^a / sum_j t_j^a. The exponent a (1: in proportion
to size, 0: all alike) is bisected, several sections at a time, until the mix meets a target entropy
or a limit on repetition. Every probe is one aggregate over the table of source totals, which stays
a distributed table: the number of sources is not bound by anything.

A source whose budget is b_i = w_i * B tokens is read in passes, each pass a permutation of its
documents by a seeded hash; the last pass stops where the budget ends. The mix is cut into blocks
and every source spreads its stream evenly over them, so each block has the sources by their
weights, and within a block the documents are permuted again.

Budget `cover` is the least at which no source falls short of one pass: nothing is dropped, small
sources repeat. Running sums over a source (one may hold a third of all rows) are made by ranges of
rows plus the starts of the ranges.

Defined cases: a null source is a source of its own; null and empty texts have one token (the end
of the document); rows alike in key and text are taken together; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, free_name, materialize, quoted, table

SEED = 20240229
#: Production parameters of the query and of the pipeline.
REPETITION = 2.0
BLOCK_TOKENS = 1 << 20
SECTIONS, ROUNDS = 24, 5


def token_count(text: str = "text"):
    """White-space words, plus one for the end of the document."""
    return (F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)) + 1).cast("long")


def source_totals(docs: DataFrame, source: str, tokens: str) -> DataFrame:
    """(source, tokens, ln_t): pre-aggregated before the shuffle, so a hot source is no hot task."""
    totals = docs.groupBy(quoted(source).alias("source")).agg(F.sum(quoted(tokens)).cast("double").alias("t")).filter("t > 0")
    return materialize(totals.withColumn("ln_t", F.ln("t")), "mix-totals")


def _probe(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy in nats, most passes under the budget `cover`) of the mix at each exponent."""
    x = totals.withColumn("z", F.col("ln_t") - totals.agg(F.max("ln_t")).first()[0])
    sums = [f for a in exponents for f in (F.sum(F.exp(F.col("z") * a)), F.sum(F.exp(F.col("z") * a) * F.col("z")))]
    *row, low = x.agg(*sums, F.min("z")).first()
    # with z_i = ln(t_i / max t) the passes of source i are (t_i / max t)^(a - 1)
    return [(math.log(row[2 * k]) - a * row[2 * k + 1] / row[2 * k], math.exp(low * (a - 1))) for k, a in enumerate(exponents)]


def find_exponent(totals: DataFrame, entropy: float | None = None, repetition: float | None = None) -> float:
    """The largest exponent of at least that entropy, or the smallest within that repetition limit.

    entropy is in nats; over ln(number of sources) it can't be met, and the exponent is 0 then.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either entropy or repetition")
    if totals.isEmpty():
        return 1.0
    fits = (lambda e, p: e >= entropy) if repetition is None else (lambda e, p: p <= repetition)
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        at = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        met = [fits(*x) for x in _probe(totals, at)]
        if repetition is None:  # holds from 0 up to the answer
            k = max((k for k in range(SECTIONS + 1) if met[k]), default=0)
            low, high = at[k], at[min(k + 1, SECTIONS)]
        else:  # holds from the answer up to 1
            k = min((k for k in range(SECTIONS + 1) if met[k]), default=SECTIONS)
            low, high = at[max(k - 1, 0)], at[k]
        if low == high:
            break
    return low if repetition is None else high


def weights(totals: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """(source, t, weight, budget, full, rest): passes in full, and the tokens of the last pass.

    budget is the number of tokens of the whole mix; None stands for `cover`.
    """
    top = totals.agg(F.max("ln_t")).first()[0] or 0.0
    power = F.exp((F.col("ln_t") - top) * exponent)
    power_sum = totals.agg(F.sum(power)).first()[0] or 1.0
    share = totals.withColumn("weight", power / power_sum)
    whole = F.lit(math.exp(top) * power_sum if budget is None else float(budget))
    out = share.withColumn("budget", F.round(F.col("weight") * whole).cast("long")).withColumn("t", F.col("t").cast("long"))
    return out.withColumn("full", F.expr("budget div t")).withColumn("rest", F.expr("budget % t")).select("source", "t", "weight", "budget", "full", "rest")


def running(rows: DataFrame) -> DataFrame:
    """rows (source, pass, h, tokens, ...) with cum: the tokens of the pass up to the row, in the order of h."""
    keys = ["source", "pass", "h"]
    ranged = rows.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id())
    ranged = materialize(ranged, "mix-passes")
    sums = ranged.groupBy("source", "pass", "_pid").agg(F.sum("tokens").alias("_n"))
    before = sums.select(F.col("source").alias("_s"), F.col("pass").alias("_p"), "_pid", (F.expr("sum(_n) over (partition by source, pass order by _pid)") - F.col("_n")).alias("_before"))
    # each range of rows is a window of its own; ties in h (equal key and text) get one sum
    local = ranged.withColumn("_in", F.expr("sum(tokens) over (partition by _pid, source, pass order by h)"))
    same = (F.col("_pid") == F.col("_q")) & (F.col("pass") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))
    joined = local.join(before.withColumnRenamed("_pid", "_q"), same)
    return joined.withColumn("cum", F.col("_before") + F.col("_in")).drop("_pid", "_q", "_p", "_s", "_before", "_in")


def _hashed(docs: DataFrame, key: str, text: str, seed: int):
    return F.xxhash64(F.lit(seed), quoted(key), quoted(text))


def plan(docs: DataFrame, key: str, text: str, source: str, exponent: float | None, entropy: float | None, repetition: float | None, budget: int | None, seed: int):
    """(narrow rows in their passes with cum and the source's shares; shares)."""
    narrow = materialize(docs.select(quoted(key).alias("key"), quoted(source).alias("source"), token_count(text).alias("tokens"), _hashed(docs, key, text, seed).alias("seeded")), "mix-docs")
    totals = source_totals(narrow, "source", "tokens")
    if exponent is None:
        exponent = find_exponent(totals, entropy, repetition)
    shares = materialize(weights(totals, exponent, budget), "mix-shares")
    wide = narrow.join(shares.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    passes = wide.withColumn("pass", F.explode(F.expr("sequence(0, cast(full as int))")))
    passes = passes.filter("pass < full or rest > 0").withColumn("h", F.xxhash64("seeded", "pass"))
    return running(passes).filter("pass < full or cum <= rest"), shares


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", exponent: float | None = None, entropy: float | None = None, repetition: float | None = REPETITION, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The mix: (key, source, n_tokens, weight, pass, block, place), to be read by block, then place."""
    repetition = None if exponent is not None or entropy is not None else repetition
    taken, shares = plan(docs, key, text, source, exponent, entropy, repetition, budget, seed)
    blocks = -(-(shares.agg(F.sum("budget")).first()[0] or 1) // block_tokens)
    at = (F.col("pass") * F.col("t") + F.col("cum") - F.col("tokens")) / F.col("budget")
    out = taken.withColumn("block", F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("long"))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), F.col("tokens").alias("n_tokens"), F.round("weight", 9).alias("weight"), "pass", "block", F.xxhash64(F.lit(seed), "h", "block").alias("place"))


def realise(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", repetition: float = REPETITION, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """docs with their own columns, each row as often as the mix under `cover` reads it, in reading order.

    Partitions are stretches of blocks and their rows are sorted by block and place, so the files that
    are written from them, read by name and row, are the mix. The last pass takes the documents up to a hash that
    is found per source, and a row's share of the hash space stands for its share of the pass, so
    texts are moved once and never joined: each document looks up its source's passes and that hash.
    """
    taken, shares = plan(docs, key, text, source, None, None, repetition, None, seed)
    cuts = taken.filter("pass = full").groupBy("source").agg(F.max("h").alias("cut"))
    both = shares.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    names = {c: free_name(docs, f"mix_{c}") for c in ("source", "full", "cut", "t", "budget", "pass", "h", "block")}
    both = materialize(both.select(*(F.col(c).alias(names[c]) for c in ("source", "full", "cut", "t", "budget"))), "mix-cuts")
    blocks = -(-(both.agg(F.sum(quoted(names["budget"]))).first()[0] or 1) // block_tokens)
    seeded = docs.withColumn(names["h"], _hashed(docs, key, text, seed))
    wide = seeded.join(both, quoted(source).eqNullSafe(F.col(names["source"])))
    copies = wide.withColumn(names["pass"], F.explode(F.expr(f"sequence(0, cast({names['full']} as int))")))
    copies = copies.withColumn(names["h"], F.xxhash64(names["h"], names["pass"]))
    copies = copies.filter((F.col(names["pass"]) < F.col(names["full"])) | F.coalesce(F.col(names["h"]) <= F.col(names["cut"]), F.lit(False)))
    at = (F.col(names["pass"]) + F.col(names["h"]) / F.lit(2.0**64) + 0.5) * F.col(names["t"]) / F.col(names["budget"])
    placed = copies.withColumn(names["block"], F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("long"))
    partitions = min(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.repartitionById(partitions, F.expr(f"cast({names['block']} * {partitions} div {blocks} as int)"))
    place = F.xxhash64(F.lit(seed), names["h"], names["block"])
    return dealt.sortWithinPartitions(names["block"], place).select(*(quoted(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that no source is read more than twice and every document at least once."""
    return mix(table(spark, sf_dir, "documents"))
