"""Gates behind the arithmetic: classification (same subject?) and adversarial verification.

Model output is a table like any other. A row that is missing never counts as a confirmation. `run` is the
whole of both stages: what the caches hold isn't asked again, and only what passes the first stage is
asked in the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import contains_span, pair_hash, trim_all
from ..sources import keyed
from ..sources.shared import written
from . import calls

CLASSIFICATION = "struct<same_subject:boolean,verdict:string,conflict_type:string,confidence:string,rationale:string>"
VERIFICATION = "struct<strongest_objection:string,objection_succeeds:boolean,span_a:string,span_b:string>"
# Pairs and findings in one call.
CLASSIFY_BATCH, VERIFY_BATCH = 20, 10
PROMPT_VERSION = "fw-1"
CACHE = "content_hash string, model string, prompt_version string, result string"


def normalise_classification(raw: Column) -> Column:
    """The verdict that counts: NEUTRAL unless the subjects are the same; a missing row is undecided."""
    same = F.coalesce(raw["same_subject"], F.lit(False))
    number = F.coalesce(raw["confidence"].try_cast("double"), F.lit(0.0))
    return F.struct(
        same.alias("same_subject"),
        F.when(same, F.coalesce(raw["verdict"], F.lit("NEUTRAL"))).otherwise("NEUTRAL").alias("verdict"),
        raw["conflict_type"].alias("conflict_type"),
        F.when(F.isnan(number), 0.0).otherwise(number).alias("confidence"),
        F.when(raw.isNull(), "Not classified.").otherwise(F.coalesce(raw["rationale"], F.lit(""))).alias("rationale"),
    )


def adjudicate(raw: Column, text_a: Column, text_b: Column) -> Column:
    """Reason of rejection, or null if the verification passes."""
    blank = lambda c: F.coalesce(trim_all(c), F.lit("")) == ""
    return (
        F.when(raw.isNull(), "not-returned")
        .when(~raw["objection_succeeds"].eqNullSafe(F.lit(False)), "objection-succeeded")
        .when(blank(raw["span_a"]) | blank(raw["span_b"]), "span-not-quoted")
        .when(~(F.coalesce(contains_span(text_a, raw["span_a"]), F.lit(False)) & F.coalesce(contains_span(text_b, raw["span_b"]), F.lit(False))), "span-not-found")
    )


def refine(findings: DataFrame, classify: bool = True, verify: bool = True, deterministic_conflict: bool = True) -> DataFrame:
    """findings (text_a, text_b, classification, verification) with outcome, reason and reported.

    outcome: different-subject, not-contradiction, rejected or reported. With a stage off its column is
    not looked at; passed is null when verification is off, never false.
    """
    c = normalise_classification(F.col("classification"))
    gate = F.lit(None).cast("string")
    if classify:
        gate = F.when(~c["same_subject"], "different-subject")
        if not deterministic_conflict:
            gate = gate.when(c["verdict"] != "CONTRADICTS", "not-contradiction")
    reason = F.when(F.col("gate").isNull(), adjudicate(F.col("verification"), F.col("text_a"), F.col("text_b"))) if verify else F.lit(None).cast("string")
    judged = findings.withColumn("gate", gate).withColumn("reason", reason)
    passed = F.when(F.col("gate").isNull(), F.col("reason").isNull()) if verify else F.lit(None).cast("boolean")
    outcome = F.coalesce("gate", F.when(F.col("reason").isNotNull(), "rejected"), F.lit("reported"))
    return judged.withColumn("passed", passed).withColumn("outcome", outcome).withColumn("reported", F.col("outcome") == "reported").drop("gate")


def verdicts(requests: DataFrame, cache: DataFrame, provider, stage: str) -> tuple[DataFrame, DataFrame]:
    """((content_hash, result JSON) of requests, new rows for the cache with their calls) of stage classify or verify.

    requests have content_hash and the texts that the provider is asked with. A request without an answer has no row.
    """
    kind, size = {"classify": (CLASSIFICATION, CLASSIFY_BATCH), "verify": (VERIFICATION, VERIFY_BATCH)}[stage]
    form = T._parse_datatype_string(kind)
    own = cache.filter((F.col("model") == provider.name) & (F.col("prompt_version") == PROMPT_VERSION)).select("content_hash", "result")
    ask = lambda rows: [calls.structured(a, form) for a in getattr(provider, stage)(rows)]
    asked = calls.ask(keyed.misses(requests, own, ["content_hash"]), "content_hash", provider, "llm.generate", calls.fixed(size), ask)
    fresh = written(asked.select("content_hash", F.lit(provider.name).alias("model"), F.lit(PROMPT_VERSION).alias("prompt_version"), "result", "call"), stage)
    return keyed.hits(requests.select("content_hash").distinct(), own.unionByName(fresh.select("content_hash", "result")), ["content_hash"]), fresh


def run(findings: DataFrame, provider, caches: dict[str, DataFrame], classify: bool = True, verify: bool = True, deterministic_conflict: bool = True) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(findings with outcome, reason, passed and reported; new rows of each cache) for findings with claims a and b and a rationale.

    caches: the tables classification_cache and verification_cache. A stage that is off asks nothing.
    """
    texts = {f"{x}_{s}": F.col(f"{s}.{x}") for x in ("subject", "text") for s in ("a", "b")}
    own = pair_hash(*(F.coalesce(texts[c], F.lit("")) for c in ("subject_a", "text_a", "subject_b", "text_b")))
    rows = findings.withColumns(texts | {"pair_key": own, "finding_key": F.sha2(F.concat_ws("\x01", own, "rationale"), 256)})
    new, answers = {}, {"classify": F.lit(None).cast(CLASSIFICATION), "verify": F.lit(None).cast(VERIFICATION)}

    def answered(stage: str, key: str, asked: DataFrame, kind: str, cache: str, payload: tuple[str, ...]) -> DataFrame:
        requests = asked.select(F.col(key).alias("content_hash"), *payload)
        found, new[cache] = verdicts(requests, caches[cache], provider, stage)
        return found.select(F.col("content_hash").alias(key), F.from_json("result", kind).alias(f"{stage}_answer"))

    if classify:
        rows = rows.join(answered("classify", "pair_key", rows, CLASSIFICATION, "classification_cache", tuple(texts)), "pair_key", "left")
        answers["classify"] = F.col("classify_answer")
    if verify:
        gated = refine(rows.withColumns({"classification": answers["classify"], "verification": answers["verify"]}), classify, False, deterministic_conflict)
        rows = rows.join(answered("verify", "finding_key", gated.filter("reported"), VERIFICATION, "verification_cache", (*texts, "rationale")), "finding_key", "left")
        answers["verify"] = F.col("verify_answer")
    judged = refine(rows.withColumns({"classification": answers["classify"], "verification": answers["verify"]}), classify, verify, deterministic_conflict)
    return judged.select(*findings.columns, "outcome", "reason", "passed", "reported"), new


def refine_stats(refined: DataFrame, classify: bool = True, verify: bool = True) -> DataFrame:
    """One row of counters; calls count batches, cached or not."""
    survivors = F.count_if(F.col("outcome").isin("rejected", "reported"))
    return refined.agg(
        F.count(F.lit(1)).alias("candidates"),
        (F.ceil(F.count(F.lit(1)) / CLASSIFY_BATCH) if classify else F.lit(0)).cast("long").alias("classifier_calls"),
        (F.ceil(survivors / VERIFY_BATCH) if verify else F.lit(0)).cast("long").alias("verifier_calls"),
        F.count_if(F.col("outcome") == "different-subject").alias("rejected_different_subject"),
        F.count_if(F.col("outcome") == "not-contradiction").alias("rejected_not_contradiction"),
        F.count_if(F.col("outcome") == "rejected").alias("rejected_by_verifier"),
        F.count_if("reported").alias("reported"),
    )


def rejection_reasons(refined: DataFrame) -> DataFrame:
    return refined.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def ablation(findings: DataFrame, deterministic_conflict: bool = True) -> DataFrame:
    """refine_stats of all four settings of the two switches, with an arm column."""
    out = None
    for classify in (True, False):
        for verify in (True, False):
            arm = f"classify={'on' if classify else 'off'},verify={'on' if verify else 'off'}"
            one = refine_stats(refine(findings, classify, verify, deterministic_conflict), classify, verify).withColumn("arm", F.lit(arm))
            out = one if out is None else out.unionByName(one)
    return out
