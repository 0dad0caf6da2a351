"""Tables of the engine as StructTypes, with their checks and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.measure import QUANTITY

_DDL = {
    "documents": "id string, arxiv_id string, version int, title string, parser_version string, content_hash string, text_length int, fetched_at timestamp, eval_run_id string",
    "sections": "id string, document_id string, path string, title string, level int, ordinal int, char_start int, char_end int, content_hash string",
    "claims": f"id string, document_id string, section_id string, text string, char_start int, char_end int, span_resolved boolean, claim_type string, subject string, quantities array<{QUANTITY}>, embedding array<float>, content_hash string",
    "extraction_cache": "content_hash string, model string, prompt_version string, claims string, input_tokens int, output_tokens int, created_at timestamp",
    "classification_cache": "content_hash string, model string, prompt_version string, result string, created_at timestamp",
    "verification_cache": "content_hash string, model string, prompt_version string, result string, created_at timestamp",
    "embedding_cache": "content_hash string, model string, dims int, embedding array<float>, created_at timestamp",
    "candidate_pairs": "id string, claim_a_id string, claim_b_id string, similarity float, survived_type_filter boolean, scope string",
    "findings": "id string, pair_id string, conflict_type string, verdict string, confidence double, rationale string, detector string, verifier_passed boolean, spans struct<a:struct<start:int,end:int>,b:struct<start:int,end:int>>, created_at timestamp",
    "eval_runs": "id string, started_at timestamp, finished_at timestamp, config string, metrics string, classifier_enabled boolean, verifier_enabled boolean, model string, notes string",
    "injections": "id string, run_id string, source_arxiv_id string, document_id string, mutation_type string, char_start int, char_end int, original_text string, mutated_text string, counterpart_start int, counterpart_end int, section_path string, detected boolean, matched_finding string, note string",
    "meter_events": "at timestamp, kind string, label string, duration_ms double, ok boolean, input_tokens long, output_tokens long, items long, bytes long",
}
TABLES = tuple(_DDL)


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[name])



# The words that enum-like columns may hold, and what is unique in each table.
CONFLICT_TYPES = ("NUMERIC", "DIRECTION", "SCOPE", "DEFINITIONAL")
VERDICTS = ("CONTRADICTS", "ENTAILS", "NEUTRAL", "TENSION")
SCOPES = ("intra", "cross")
METER_KINDS = ("arxiv.http", "llm.generate", "llm.embed", "db.query")
REJECTIONS = ("not-returned", "objection-succeeded", "span-not-quoted", "span-not-found")
UNIQUE = {
    "documents": ("arxiv_id", "version"),
    "sections": ("document_id", "ordinal"),
    "extraction_cache": ("content_hash", "model", "prompt_version"),
    "classification_cache": ("content_hash", "model", "prompt_version"),
    "verification_cache": ("content_hash", "model", "prompt_version"),
    "embedding_cache": ("content_hash", "model", "dims"),
    "candidate_pairs": ("claim_a_id", "claim_b_id"),
}


def stable_id(*parts: Column) -> Column:
    """A deterministic id of the parts; null parts differ from empty ones."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256)


def violations(name: str, df: DataFrame) -> DataFrame:
    """(rule, n): broken rules of a table, empty if it is sound."""
    rules: list[tuple[str, Column]] = []
    if name == "sections":
        rules.append(("0 <= char_start < char_end", ~((F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")))))
    if name == "candidate_pairs":
        rules.append(("scope", ~F.col("scope").isin(*SCOPES)))
    if name == "findings":
        rules += [("conflict_type", ~F.col("conflict_type").isin(*CONFLICT_TYPES)), ("verdict", ~F.col("verdict").isin(*VERDICTS))]
    if name == "meter_events":
        rules.append(("kind", ~F.col("kind").isin(*METER_KINDS)))
    out = None
    for rule, broken in rules:
        one = df.filter(broken).select(F.lit(rule).alias("rule"))
        out = one if out is None else out.unionByName(one)
    if name in UNIQUE:
        twice = df.groupBy(*UNIQUE[name]).count().filter("count > 1").select(F.lit(f"unique {', '.join(UNIQUE[name])}").alias("rule"))
        out = twice if out is None else out.unionByName(twice)
    if out is None:
        return df.sparkSession.createDataFrame([], "rule string, n long")
    return out.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
