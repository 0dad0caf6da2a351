"""Recall over known contradictions and false positives on clean documents, with cost."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import schema, stable_id
from ..sources import keyed
from ..sources.shared import written
from . import calls


def recall_by_type(injections: DataFrame) -> DataFrame:
    """(mutation_type, total, detected, recall); recall is null where nothing was injected."""
    counted = injections.groupBy("mutation_type").agg(F.count(F.lit(1)).alias("total"), F.count_if("detected").alias("detected"))
    return counted.withColumn("recall", F.try_divide("detected", "total"))


def recall(injections: DataFrame) -> DataFrame:
    return injections.agg(F.count(F.lit(1)).alias("total"), F.count_if("detected").alias("detected")).withColumn("recall", F.try_divide("detected", "total"))


def false_positives(clean: DataFrame, findings: DataFrame, key: str = "document_id") -> DataFrame:
    """(papers, findings, false_positives_per_paper) of the control arm: every finding on a clean paper is false."""
    per = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = clean.select(key).distinct().join(per, key, "left")
    return joined.agg(F.count(F.lit(1)).alias("papers"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings")).withColumn("false_positives_per_paper", F.try_divide("findings", "papers"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run that started last."""
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(1)


def evaluate(
    documents: DataFrame, sections: DataFrame, provider, per_paper: int = 3, seed: int = 42, control_only: bool = False, k: int | None = None, t: float | None = None,
    classify: bool = False, verify: bool = False, store=None, run_id: str | None = None,
) -> dict:
    """The whole benchmark over documents (doc_id, text) and sections, control and injected arm in one plan each.

    classify and verify switch the two gates on, for an ablation. With a store the run is a row of
    eval_runs from its start on, its metrics are added at its end, and its variants, their sections and its
    injections are saved; verdicts are cached there. Returns the metrics, the run's id, and the
    injections as a DataFrame.
    """
    from . import detect, extract, mutate
    from .neighbours import MIN_SIMILARITY, TOP_K

    spark = documents.sparkSession
    run_id = run_id or uuid.uuid4().hex
    empty = spark.createDataFrame([], "content_hash string, model string, dims int, embedding array<float>")
    settings = {"per_paper": per_paper, "seed": seed, "control_only": control_only, "top_k": k or TOP_K, "min_similarity": MIN_SIMILARITY if t is None else t}
    began = dt.datetime.now(dt.timezone.utc)

    def record(metrics: dict | None) -> None:
        if store is None:
            return
        row = (run_id, began, dt.datetime.now(dt.timezone.utc) if metrics else None, json.dumps(settings), json.dumps(metrics) if metrics else None, classify, verify, provider.name, None)
        store.swap("eval_runs", keyed.upsert(store.read("eval_runs", schema("eval_runs")), spark.createDataFrame([row], schema("eval_runs")), ["id"]))

    def run(docs: DataFrame, secs: DataFrame) -> DataFrame:
        rows = secs.join(docs, "doc_id").withColumn("body", F.expr("substring(text, char_start + 1, char_end - char_start)"))
        rows = rows.select(F.col("doc_id").cast("string").alias("document_id"), F.concat_ws("/", "doc_id", "ordinal").alias("id"), "title", "path", "body", "char_start", F.sha2("body", 256).alias("content_hash"))
        wanted = rows.dropDuplicates(["content_hash"])
        extracted = written(extract.call_extraction(wanted, provider), "eval-extracted")
        claims = extract.located_claims(rows, extracted)
        embedded, fresh = extract.embed(written(claims, "eval-claims"), empty, provider)
        claims = written(embedded, "eval-embedded")
        if store is not None:
            store.append("meter_events", calls.events(extracted))
        _, found, _ = detect.detect(claims, "intra", settings["top_k"], settings["min_similarity"], provider=provider, store=store, classify=classify, verify=verify)
        return written(found.select(F.col("a.document_id").alias("document_id"), "id", "spans"), "eval-findings")

    record(None)
    documents = documents.select("doc_id", "text")
    clean = documents.select(F.col("doc_id").cast("string").alias("document_id"))
    control = false_positives(clean, run(documents, sections)).first()
    metrics = {"control": {"papers": control[0], "findings": control[1], "false_positives_per_paper": control[2]}, "injected": {"total": 0, "detected": 0, "recall": None}}
    if control_only:
        record(metrics)
        return {"metrics": metrics, "injections": None, "run_id": run_id}
    found = mutate.sites(documents, sections)
    found = written(found, "eval-sites")
    planned = written(mutate.sample(mutate.plan(found), mutate.plan_order(found), per_paper, seed), "eval-plan")
    applied = mutate.apply(documents, planned).withColumn("variant", F.concat_ws("#", "doc_id", "index"))
    own = applied.select("doc_id", "variant").join(sections, "doc_id").drop("doc_id").withColumnRenamed("variant", "doc_id")
    hits = run(applied.select(F.col("variant").alias("doc_id"), "text"), own)
    injections = written(mutate.score(applied.drop("text").withColumnRenamed("variant", "document_id"), hits), "eval-injections")
    if store is not None:
        variants = mutate.variants(applied, run_id)
        now = F.current_timestamp().alias("fetched_at")
        rows = variants.select("id", "arxiv_id", "version", "title", F.lit("variant").alias("parser_version"), "content_hash", "text_length", now, "eval_run_id")
        store.swap("documents", keyed.upsert(store.read("documents", schema("documents")), rows, ["arxiv_id", "version"]))
        copies = mutate.variant_sections(applied, sections, run_id)
        store.swap("sections", keyed.replace_where(store.read("sections", schema("sections")), copies, ["document_id"]))
        version = F.lit(mutate.VARIANT_BASE) + F.col("index")
        made = injections.select(
            stable_id(F.lit(run_id), F.col("document_id"), F.col("original_text")).alias("id"), F.lit(run_id).alias("run_id"), F.col("doc_id").cast("string").alias("source_arxiv_id"),
            stable_id(F.lit(run_id), F.col("doc_id"), version).alias("document_id"), "mutation_type", "char_start", "char_end", "original_text", "mutated_text", "counterpart_start", "counterpart_end", "section_path", "detected", "matched_finding", "note",
        )
        store.swap("injections", keyed.upsert(store.read("injections", schema("injections")), made, ["id"]))
    total = recall(injections).first()
    metrics["injected"] = {"total": total[0], "detected": total[1], "recall": total[2]}
    metrics["by_type"] = [r.asDict() for r in recall_by_type(injections).collect()]
    record(metrics)
    return {"metrics": metrics, "injections": injections, "run_id": run_id}
