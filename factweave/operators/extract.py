"""Claims from sections: batching, cached provider calls, spans, embeddings.

A provider is any object with the four calls of `Provider` that can be pickled to executors. Answers are JSON
texts or dicts; what doesn't have the asked form counts as not returned. `RuleProvider` is a
deterministic one that needs no network.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measure import QUANTITY
from ..functions.text import embedding_text, locate, should_extract
from ..schemas import CONFLICT_TYPES, stable_id
from ..sources.shared import written
from . import calls

# Sizes of batches.
BATCH_CHARS, EMBED_BATCH, INSERT_BATCH = 12_000, 40, 100
PROMPT_VERSION = "fw-1"
EXTRACTED = f"array<struct<quote:string,claim_type:string,subject:string,quantities:array<{QUANTITY}>>>"


class Provider(Protocol):
    name: str
    dims: int

    def extract(self, sections: list[dict]) -> list[dict]:
        """{path, claims} for sections (path, title, text); what names no path that was asked for is dropped."""

    def embed(self, texts: list[str]) -> np.ndarray:
        """A vector of `dims` figures per text."""

    def classify(self, pairs: list[dict]) -> list[dict | str | None]:
        """A refine.CLASSIFICATION for each pair (subject_a, text_a, subject_b, text_b), None for what isn't returned."""

    def verify(self, findings: list[dict]) -> list[dict | str | None]:
        """A refine.VERIFICATION for each finding (a pair with its rationale)."""


class RuleProvider:
    """Claims by rule: a sentence `<metric> of|is <number> [unit] for <system> on <dataset>`; hashed embeddings."""

    name = "rules"
    _claim = re.compile(r"(?P<metric>[A-Z][\w-]*) (?:of|is|was) (?P<value>-?\d+(?:\.\d+)?)(?: (?P<unit>%|[A-Za-z]+))? for (?P<system>[\w() -]+?)(?: on (?P<dataset>[\w() -]+?))?(?=[.;,]|$)")

    def __init__(self, dims: int = 64):
        self.dims = dims

    def extract(self, sections: list[dict]) -> list[dict]:
        out = []
        for section in sections:
            found = []
            for m in self._claim.finditer(section["text"]):
                quantity = {"value": float(m["value"]), "unit": m["unit"], "subject": m["metric"], "metric": m["metric"], "dataset": m["dataset"], "system": m["system"]}
                found.append({"quote": m[0], "claim_type": "NUMERIC", "subject": f"{m['metric']} for {m['system']}", "quantities": [quantity]})
            out.append({"path": section["path"], "claims": found})
        return out

    def classify(self, pairs: list[dict]) -> list[dict]:
        """The same subject if the claims' subjects consist of the same words."""
        words = lambda text: sorted(set(re.findall(r"\w+", (text or "").lower())))
        out = []
        for p in pairs:
            same = words(p["subject_a"]) == words(p["subject_b"])
            out.append({"same_subject": same, "verdict": "CONTRADICTS" if same else "NEUTRAL", "conflict_type": "NUMERIC", "confidence": 1.0, "rationale": "equal subjects" if same else "different subjects"})
        return out

    _bound = re.compile(r"\b(about|almost|approximately|at least|at most|around|nearly|over|roughly|up to)\b", re.I)

    def verify(self, findings: list[dict]) -> list[dict]:
        """An objection succeeds if one of the claims only gives a bound."""
        out = []
        for f in findings:
            bound = self._bound.search(f["text_a"]) or self._bound.search(f["text_b"])
            out.append({"strongest_objection": f"only a bound: {bound[0]}" if bound else "none", "objection_succeeds": bool(bound), "span_a": f["text_a"], "span_b": f["text_b"]})
        return out

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            # figures differ between claims that contradict each other, so they don't count
            for word in re.findall(r"[a-z]+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dims] += 1 if h >> 63 else -1
        return out


def eligible_sections(sections: DataFrame) -> DataFrame:
    """Sections (title, body) that are long enough and not back matter."""
    return sections.filter(should_extract(F.col("title"), F.length("body")))


def fixed_batches(df: DataFrame, partition: list[str], order: list[str], size: int, out: str = "batch_no") -> DataFrame:
    """Rows numbered by batches of `size` within each partition; a large one is ranked by many tasks."""
    return ranked_within(df, partition, order, "_rank").withColumn(out, F.expr(f"cast(_rank div {size} as int)")).drop("_rank")


def ranked_within(df: DataFrame, partition: list[str], order: list[str], rank: str) -> DataFrame:
    """df with a gapless 0-based rank within each partition.

    Ranges of rows number their own rows; the starts of a partition's ranges are a table of a row
    per partition and range, so no task sees a whole partition.
    """
    keys = [F.col(c) for c in (*partition, *order)]
    ranged = written(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*partition, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = f"sum(_n) over (partition by {', '.join(partition)} order by _range) - _n"
    starts = sizes.select(*(F.col(c).alias(f"_{c}") for c in partition), F.col("_range").alias("_of"), F.expr(before).alias("_start"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), partition, F.col("_range") == F.col("_of"))
    local = f"row_number() over (partition by _range, {', '.join(partition)} order by {', '.join(order)}) - 1"
    joined = ranged.withColumn("_local", F.expr(local)).join(starts, same)
    return joined.withColumn(rank, F.col("_start") + F.col("_local")).select(*df.columns, rank)


def greedy(lengths: list[int], budget: int = BATCH_CHARS) -> list[int]:
    """Batch of each item: a new one when the current isn't empty and the item would exceed the budget."""
    out, batch, size, held = [], 0, 0, 0
    for n in lengths:
        if held and size + n > budget:
            batch, size, held = batch + 1, 0, 0
        out.append(batch)
        size, held = size + n, held + 1
    return out


def greedy_batches(df: DataFrame, key: str, order: str, length: str, budget: int = BATCH_CHARS, out: str = "batch_no") -> DataFrame:
    """Batches of at most `budget` per key, an oversized item on its own.

    The rule depends on the order, so it is folded over each key's lengths; nothing leaves the JVM.
    """
    listed = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(length).cast("long").alias("n")))).alias("items"))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        new = (a["held"] > 0) & (a["size"] + x["n"] > budget)
        b = a["b"] + F.when(new, 1).otherwise(0)
        return F.struct(b.alias("b"), (F.when(new, 0).otherwise(a["size"]) + x["n"]).alias("size"), (F.when(new, 0).otherwise(a["held"]) + 1).alias("held"), F.concat(a["out"], F.array(b)).alias("out"))

    numbered = listed.select(key, F.explode(F.arrays_zip(F.col("items.o").alias("o"), F.aggregate("items", start, step, lambda a: a["out"]).alias("b"))).alias("x"))
    return df.join(numbered.select(F.col(key).alias("_k"), F.col("x.o").alias("_o"), F.col("x.b").alias(out)), (F.col(key) == F.col("_k")) & (F.col(order) == F.col("_o"))).drop("_k", "_o")


def call_extraction(misses: DataFrame, provider: Provider) -> DataFrame:
    """(content_hash, model, prompt_version, claims JSON, call) for sections (content_hash, title, body); a call takes as many as fit its budget."""
    kind = T.StructType.fromDDL(f"path string, claims {EXTRACTED}")

    def answers(sections: list[dict]) -> list[list | None]:
        asked = [{"path": str(i), "title": s["title"], "text": s["body"]} for i, s in enumerate(sections)]
        found = [calls.structured(a, kind) for a in provider.extract(asked)]
        by_path = {a["path"]: a["claims"] for a in found if a}
        return [by_path.get(s["path"]) for s in asked]

    requests = misses.select("content_hash", "title", "body")
    out = calls.ask(requests, "content_hash", provider, "llm.generate", lambda frame: np.array(greedy([len(b) for b in frame["body"]])), answers)
    return out.select("content_hash", F.lit(provider.name).alias("model"), F.lit(PROMPT_VERSION).alias("prompt_version"), F.col("result").alias("claims"), "call")


def located_claims(sections: DataFrame, extracted: DataFrame) -> DataFrame:
    """Claim rows from sections (document_id, id, body, char_start, content_hash) and their cached extraction."""
    each = sections.join(extracted.select("content_hash", F.from_json("claims", EXTRACTED).alias("c")), "content_hash")
    each = each.select(F.col("document_id"), F.col("id").alias("section_id"), "body", F.col("char_start").alias("offset"), F.posexplode("c").alias("pos", "c"))
    each = each.filter(F.col("c.claim_type").isin(*CONFLICT_TYPES)).withColumn("at", locate(F.col("c.quote"), F.col("body")))
    return each.select(
        stable_id(F.col("section_id"), F.col("pos"), F.col("c.quote")).alias("id"), "document_id", "section_id", F.col("c.quote").alias("text"),
        (F.col("offset") + F.col("at.start")).alias("char_start"), (F.col("offset") + F.col("at.end")).alias("char_end"), F.col("at").isNotNull().alias("span_resolved"),
        F.col("c.claim_type").alias("claim_type"), F.col("c.subject").alias("subject"),
        F.coalesce("c.quantities", F.array().cast(f"array<{QUANTITY}>")).alias("quantities"), F.sha2(F.col("c.quote"), 256).alias("content_hash"),
    )


def embed(claims: DataFrame, cache: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """(claims with embedding, new rows for the cache); equal texts are embedded once."""
    keyed = claims.withColumn("key", F.sha2(embedding_text(F.col("subject"), F.col("text")), 256))
    own = cache.filter((F.col("model") == provider.name) & (F.col("dims") == provider.dims))
    todo = keyed.select("key", embedding_text(F.col("subject"), F.col("text")).alias("t")).dropDuplicates(["key"]).join(own.select(F.col("content_hash").alias("key")), "key", "left_anti")

    def vectors(requests: list[dict]) -> list[list[float]]:
        out = np.asarray(provider.embed([r["t"] for r in requests]), float)
        if out.shape != (len(requests), provider.dims):
            raise ValueError(f"{len(requests)} texts gave vectors of shape {out.shape}")
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths > 0, lengths, 1)).astype(np.float32).tolist()

    asked = calls.ask(todo, "key", provider, "llm.embed", calls.fixed(EMBED_BATCH), vectors)
    fresh = asked.select(F.col("key").alias("content_hash"), F.lit(provider.name).alias("model"), F.lit(provider.dims).alias("dims"), F.from_json("result", "array<float>").alias("embedding"), "call")
    known = own.select("content_hash", "embedding").unionByName(fresh.select("content_hash", "embedding"))
    return keyed.join(known.withColumnRenamed("content_hash", "key"), "key").drop("key"), fresh


def embedding_stats(keys: DataFrame, cache_keys: DataFrame) -> DataFrame:
    """(claims, distinct, cached, computed, duplicates) of embedding `keys` (key) against a cache."""
    each = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    flagged = each.join(cache_keys.select("key").distinct().withColumn("known", F.lit(True)), "key", "left")
    return flagged.agg(
        F.sum("n").alias("claims"), F.count(F.lit(1)).alias("distinct_keys"), F.count_if("known").alias("cached"),
        F.count_if(F.col("known").isNull()).alias("computed"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
    )


def claims_by_type(claims: DataFrame) -> DataFrame:
    return claims.groupBy("claim_type").agg(F.count(F.lit(1)).alias("n"))


def extraction_prompt(sections: list[dict]) -> str:
    """What a language model is asked, in our own words."""
    body = "\n\n".join(f"[section {i}] {s['title']}\n{s['text']}" for i, s in enumerate(sections))
    return f"List the factual claims of each section as JSON. Quote each claim word for word. Label every figure with metric, system and, if the text has it, dataset.\n\n{body}"


def classification_prompt(pairs: list[dict]) -> str:
    body = "\n\n".join(f"[pair {i}]\nA ({p['subject_a']}): {p['text_a']}\nB ({p['subject_b']}): {p['text_b']}" for i, p in enumerate(pairs))
    return f"For each pair say whether A and B are about the same thing, and if so whether they contradict each other. Answer as JSON.\n\n{body}"


def verification_prompt(findings: list[dict]) -> str:
    body = "\n\n".join(f"[finding {i}] {f['rationale']}\nA: {f['text_a']}\nB: {f['text_b']}" for i, f in enumerate(findings))
    return f"Try to refute each finding. Give the strongest objection, whether it succeeds, and the words of A and of B that establish the conflict. Answer as JSON.\n\n{body}"

