"""Findings: candidate pairs whose claims state incompatible figures for one measurement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measure import best_conflict, confidence, prepared_list
from ..functions.numbers import rationale
from ..schemas import stable_id
from ..sources.shared import written
from . import calls, refine
from .neighbours import MIN_SIMILARITY, TOP_K, baseline, neighbours

CLAIM = ("id", "document_id", "section_id", "text", "char_start", "char_end", "claim_type", "subject", "quantities")


def corpus(claims: DataFrame, documents: DataFrame, arxiv_ids: list[str] | None = None) -> DataFrame:
    """Claims of the wanted papers without evaluation variants, each paper in its latest version only."""
    own = documents.filter("eval_run_id is null")
    if arxiv_ids is not None:
        own = own.filter(F.col("arxiv_id").isin(*sorted(set(arxiv_ids))))
    latest = own.groupBy("arxiv_id").agg(F.max_by(F.struct("id", "version", "title"), "version").alias("d")).select("arxiv_id", "d.*")
    return claims.join(latest.withColumnRenamed("id", "document_id"), "document_id")


def corpus_size(members: DataFrame) -> DataFrame:
    return members.agg(F.countDistinct("document_id").alias("documents"), F.count("id").alias("claims"))


def candidates(claims: DataFrame, scope: str = "intra", k: int = TOP_K, t: float = MIN_SIMILARITY, strategy: str = "block") -> DataFrame:
    """(a STRUCT, b STRUCT, similarity) for neighbouring claims; text joins only once the pairs are known.

    Quantities are prepared before the join, once per claim, into the field `ready`.
    """
    pairs = written(neighbours(claims, scope, k, t, strategy=strategy), "pairs")
    columns = [c for c in (*CLAIM, "path", "arxiv_id", "version", "title") if c in claims.columns]
    ready = F.when(F.col("claim_type") == "NUMERIC", prepared_list(F.col("quantities"))).alias("ready")
    side = lambda s: claims.select(F.col("id").alias(f"{s}_id"), F.struct(*columns, ready).alias(s))
    return pairs.join(side("a"), "a_id").join(side("b"), "b_id").select("a", "b", "similarity")


def type_compatible(pairs: DataFrame) -> DataFrame:
    """Pairs of one claim type; only NUMERIC has a detector."""
    return pairs.withColumn("survived_type_filter", (F.col("a.claim_type") == F.col("b.claim_type")) & (F.col("a.claim_type") == "NUMERIC"))


def conflicts(pairs: DataFrame) -> DataFrame:
    """pairs (claims a and b, their quantities prepared in `ready`) with `compared` and `best` (see best_conflict)."""
    return pairs.withColumn("_found", best_conflict(F.col("a.ready"), F.col("b.ready"))).withColumns({"compared": F.col("_found.compared"), "best": F.col("_found.best")}).drop("_found")


def findings(pairs: DataFrame, scope: str, verifier_enabled: bool = False) -> DataFrame:
    """Finding rows, with the pair's ids and the two quantities."""
    hit = conflicts(type_compatible(pairs).filter("survived_type_filter")).filter("best is not null")
    hit = hit.withColumns({s: F.col(s).dropFields("ready") for s in ("a", "b")})
    pair_id = stable_id(F.col("a.id"), F.col("b.id"))
    side = lambda s: F.struct(F.col(f"{s}.char_start").alias("start"), F.col(f"{s}.char_end").alias("end")).alias(s)
    return hit.select(
        stable_id(pair_id, F.lit("NUMERIC")).alias("id"), pair_id.alias("pair_id"), F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.lit(scope).alias("scope"),
        F.lit("NUMERIC").alias("conflict_type"), F.lit("CONTRADICTS").alias("verdict"), confidence(F.col("best.r")).alias("confidence"),
        rationale(F.col("best.x.metric"), F.col("best.x.value"), F.col("best.y.value"), F.col("best.c.difference"), F.col("best.c.tolerance"), F.col("best.r")).alias("rationale"),
        F.lit("arithmetic+llm" if verifier_enabled else "arithmetic").alias("detector"), F.lit(True if verifier_enabled else None).cast("boolean").alias("verifier_passed"),
        F.struct(side("a"), side("b")).alias("spans"), "similarity", "compared", F.col("best.x").alias("quantity_a"), F.col("best.y").alias("quantity_b"), "a", "b",
    )


def candidate_rows(pairs: DataFrame, scope: str) -> DataFrame:
    """Rows of candidate_pairs."""
    return type_compatible(pairs).select(stable_id(F.col("a.id"), F.col("b.id")).alias("id"), F.col("a.id").alias("claim_a_id"), F.col("b.id").alias("claim_b_id"), F.col("similarity").cast("float").alias("similarity"), "survived_type_filter", F.lit(scope).alias("scope"))


CACHES = ("classification_cache", "verification_cache")


def detect(
    claims: DataFrame, scope: str = "intra", k: int = TOP_K, t: float = MIN_SIMILARITY, strategy: str = "block", provider=None, store=None, classify: bool = True, verify: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, findings, one row of stats) for all documents at once.

    With a provider the findings are those that the two gates report (see refine); their answers and
    calls go into the store's caches and meter_events, if there is a store. Without one, or with both
    stages off, the arithmetic alone decides.
    """
    if scope == "cross" and len(claims.select("document_id").distinct().take(2)) < 2:
        raise ValueError("cross-document detection needs at least two different documents")
    gated = provider is not None and (classify or verify)
    pairs = candidates(claims, scope, k, t, strategy)
    rows = candidate_rows(pairs, scope)
    found = findings(pairs, scope, gated and verify)
    counted = rows.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("survived_type_filter").alias("after_type_filter"))
    parts = [baseline(claims.filter("embedding is not null")), counted]
    if gated:
        spark = claims.sparkSession
        caches = {c: store.read(c, refine.CACHE) if store else spark.createDataFrame([], refine.CACHE) for c in CACHES}
        judged, new = refine.run(written(found, "arithmetic"), provider, caches, classify, verify)
        judged = written(judged, "judged")
        for cache, fresh in new.items() if store else ():
            store.append(cache, calls.cacheable(fresh))
            store.append("meter_events", calls.events(fresh))
        parts.append(refine.refine_stats(judged, classify, verify).withColumnRenamed("candidates", "conflicts"))
        found = judged.filter("reported").drop("outcome", "reason", "passed", "reported")
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    stats = both.agg(*(F.max(c).alias(c) for c in both.columns)).withColumn("baseline", F.col("intra_pairs") if scope == "intra" else F.col("cross_pairs"))
    return rows, found, stats.withColumn("reduction_percent", 100 - F.try_divide(F.col("candidates") * 100.0, F.col("baseline")))
