"""Exact search of many passages in many documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..sources.shared import written

#: Words of the key that a passage is looked up by; the most keys or short passages that are sent to all tasks at a time.
WORDS, SENT = 3, 10_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _keys(words: Column) -> Column:
    """The hashes of all runs of WORDS words."""
    run = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS)))
    return F.when(F.size(words) >= WORDS, let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: run(w, i))))


def locate_all(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, quote: str) -> DataFrame:
    """(key, item, start, end): the first place of each item's quote in each text that has it, half-open code points.

    Of a passage of five words or more the second to the fourth are whole words wherever it stands, even if it begins
    or ends inside one; a document is looked at for the keys that these words make. Shorter passages have no
    such words: they are tried on every document, SENT at a time. The passage itself decides in either
    case. Null texts and quotes are nowhere; an empty quote is at 0 of every text.
    """
    rows = items.filter(F.col(quote).isNotNull()).select(item, quote, _words(F.col(quote)).alias("_w"))
    long_ = written(rows.filter(F.size("_w") >= WORDS + 2).select(item, quote, F.get(_keys(F.slice("_w", 2, WORDS)), F.lit(0)).alias("_g")), "passages")
    keys = long_.select("_g").distinct()
    wanted = [r[0] for r in keys.limit(SENT + 1).collect()]
    texts = docs.filter(F.col(text).isNotNull()).select(key, text)
    if len(wanted) <= SENT:  # in the same row: only documents with a key go on
        hits = texts.withColumn("_gs", F.array_distinct(F.filter(_keys(_words(F.col(text))), lambda g: g.isin(wanted) if wanted else F.lit(False))))
        met = hits.filter(F.size("_gs") > 0).select(key, text, F.explode("_gs").alias("_g")).join(long_, "_g")
    else:  # ids and keys meet first, texts later
        pairs = texts.select(key, F.explode(F.array_distinct(_keys(_words(F.col(text))))).alias("_g")).join(long_, "_g").drop("_g")
        met = pairs.join(texts, key)
    found = [met]
    short = written(rows.filter(F.size("_w") < WORDS + 2).select(item, quote), "passages-short")
    parts = -(-short.count() // SENT)
    for i in range(parts):
        part = short.filter(F.pmod(F.xxhash64(item, quote), F.lit(parts)) == i).agg(F.collect_list(F.struct(F.col(item).alias("i"), F.col(quote).alias("q"))).alias("_all"))
        listed = texts.withColumn("_one", F.lit(1)).join(F.broadcast(part.withColumn("_one", F.lit(1))), "_one")
        inside = listed.select(key, text, F.explode(F.filter("_all", lambda x: F.contains(F.col(text), x["q"]))).alias("_x"))
        found.append(inside.select(key, text, F.col("_x.i").alias(item), F.col("_x.q").alias(quote)))
    out = None
    for hits in found:
        at = hits.withColumn("start", F.instr(F.col(text), F.col(quote)) - 1).filter("start >= 0")
        at = at.select(key, item, "start", (F.col("start") + F.length(quote)).alias("end"))
        out = at if out is None else out.unionByName(at)
    return out
