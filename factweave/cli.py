"""Command line: ingest, analyze, detect, corpus and eval over a folder of source bundles.

    python -m factweave.cli ingest  BUNDLES [--json] [--preview N]
    python -m factweave.cli analyze BUNDLES [--json] [--no-verifier] [--no-classifier]
    python -m factweave.cli detect  [ID...] [--json] [--no-verifier] [--no-classifier]
    python -m factweave.cli corpus  ID ID... [--json] [--no-verifier] [--no-classifier]
    python -m factweave.cli eval    BUNDLES [--per-paper N] [--seed N] [--control-only] [--json] [--no-verifier] [--no-classifier]
    python -m factweave.cli report  [--splice PAGE]
    python -m factweave.cli backfill

A bundle is a file named after its paper, such as 2301.12345v2.gz. Several papers are one job; papers that the
store holds unchanged aren't worked on again. report prints the last evaluation, or puts it between a page's markers.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .config import Config, load
from .operators import calls, detect, evaluate, extract
from .operators.extract import RuleProvider
from .schemas import schema, stable_id
from .sources import bundles, ids, keyed, latex
from .sources.shared import written


def session() -> SparkSession:
    return SparkSession.builder.appName("factweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ingest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents with text, sections with body) of all bundles at path."""
    raw = bundles.read_bundles(spark, path).withColumn("name", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)(\.tar)?\.(gz|tgz|tar|tex)$", ""))
    parsed = written(latex.parse_bundles(raw.withColumnRenamed("error", "bundle_error")), "parsed")
    paper = ids.parse_arxiv_id(F.col("name"))
    docs = parsed.select(
        F.coalesce(paper["id"], F.col("name")).alias("arxiv_id"), F.coalesce(paper["version"], F.lit(1)).alias("version"), "text", "sections", "parser_version",
        F.coalesce("bundle_error", "error", F.when(F.col("pdf_only"), "only a PDF")).alias("error"),
    )
    docs = docs.withColumn("id", stable_id(F.col("arxiv_id"), F.col("version"))).withColumn("content_hash", F.sha2("text", 256))
    sections = latex.section_rows(docs.filter("error is null"), "id").withColumnRenamed("id", "document_id")
    return docs, sections.withColumn("id", stable_id(F.col("document_id"), F.col("ordinal")))


def claims_of(spark: SparkSession, sections: DataFrame, store: keyed.Store, provider) -> DataFrame:
    """Claims of eligible sections; what the caches hold is not asked for again, what is asked is metered."""
    wanted = extract.eligible_sections(sections)
    cache = store.read("extraction_cache", "content_hash string, model string, prompt_version string, claims string")
    own = cache.filter((F.col("model") == provider.name) & (F.col("prompt_version") == extract.PROMPT_VERSION))
    fresh = written(extract.call_extraction(keyed.misses(wanted, own, ["content_hash"]), provider), "extracted")
    claims = written(extract.located_claims(wanted, own.unionByName(fresh.drop("call"))), "located")
    vectors = store.read("embedding_cache", "content_hash string, model string, dims int, embedding array<float>")
    embedded, new = extract.embed(claims, vectors, provider)
    new = written(new, "embedded")
    embedded = written(extract.embed(claims, vectors.unionByName(new.drop("call")), provider)[0], "claims")
    store.append("extraction_cache", calls.cacheable(fresh))
    store.append("embedding_cache", calls.cacheable(new))
    for made in (fresh, new):
        store.append("meter_events", calls.events(made))
    return embedded


def unchanged(store: keyed.Store, documents: DataFrame) -> DataFrame:
    """(id) of documents that the store holds with the same text, read by the same parser."""
    stored = store.read("documents", schema("documents")).select("id", "content_hash", "parser_version")
    good = documents.filter("error is null").select("id", "content_hash", "parser_version")
    return good.join(keyed.changed(stored, good, ["id"], ["content_hash", "parser_version"]).select("id"), "id", "left_anti").select("id")


def save(store: keyed.Store, documents: DataFrame, sections: DataFrame, claims: DataFrame | None) -> None:
    names = schema("documents").names
    rows = documents.filter("error is null").withColumns({"title": F.col("arxiv_id"), "text_length": F.length("text"), "fetched_at": F.current_timestamp(), "eval_run_id": F.lit(None).cast("string")}).select(*names)
    store.swap("documents", keyed.upsert(store.read("documents", schema("documents")), rows, ["arxiv_id", "version"]))
    rows = sections.select(*schema("sections").names)
    store.swap("sections", keyed.replace_where(store.read("sections", schema("sections")), rows, ["document_id"]))
    if claims is not None:
        rows = claims.select(*schema("claims").names)
        store.swap("claims", keyed.replace_where(store.read("claims", schema("claims")), rows, ["document_id"]))


def with_paths(claims: DataFrame, store: keyed.Store) -> DataFrame:
    """claims with the path of their section, which findings name."""
    paths = store.read("sections", schema("sections")).select(F.col("id").alias("section_id"), "path")
    return claims.join(paths, "section_id", "left")


def _report(store: keyed.Store, page: str | None) -> str:
    """The last evaluation run as a table; with a page, put between its markers."""
    last = evaluate.latest_run(store.read("eval_runs", schema("eval_runs"))).first()
    if last is None:
        raise ValueError("no evaluation run is recorded")
    metrics = json.loads(last.metrics) if last.metrics else None
    text = report.results_table({"id": last.id, "started_at": last.started_at, "model": last.model, "classify": last.classifier_enabled, "verify": last.verifier_enabled, "metrics": metrics, "by_type": (metrics or {}).get("by_type")})
    if page:
        with open(page, encoding="utf-8") as f:
            whole = report.splice(f.read(), text)
        with open(page, "w", encoding="utf-8") as f:
            f.write(whole)
    return text


def run_detection(claims: DataFrame, scope: str, config: Config, store: keyed.Store, persist: bool, provider, classify: bool, verify: bool) -> tuple[list[dict], dict]:
    pairs, found, stats = detect.detect(claims, scope, config.top_k, config.min_similarity, provider=provider, store=store, classify=classify, verify=verify)
    found = written(found, "findings")
    if persist:
        store.swap(f"candidate_pairs_{scope}", pairs)
        store.swap(f"findings_{scope}", found.drop("a", "b", "quantity_a", "quantity_b"))
    top = found.orderBy(F.col("confidence").desc(), "id").select("conflict_type", "confidence", "rationale", "detector", "a", "b")
    return [r.asDict(recursive=True) for r in top.toLocalIterator()], stats.first().asDict()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="factweave", description="Finds contradictions between figures in documents.")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("ingest", "analyze", "detect", "corpus", "eval"):
        one = commands.add_parser(name)
        one.add_argument("targets", nargs="*" if name == "detect" else "+")
        one.add_argument("--json", action="store_true")
        if name == "ingest":
            one.add_argument("--save", action="store_true")
            one.add_argument("--preview", type=int, default=0)
        else:
            one.add_argument("--no-verifier", action="store_true")
            one.add_argument("--no-classifier", action="store_true")
        if name == "eval":
            one.add_argument("--per-paper", type=int, default=3)
            one.add_argument("--seed", type=int, default=42)
            one.add_argument("--control-only", action="store_true")
    commands.add_parser("report").add_argument("--splice")
    commands.add_parser("backfill")
    return out


def main(argv: list[str] | None = None) -> int:
    args, config = parser().parse_args(argv), load()
    try:
        print(execute(session(), args, config))
        return 0
    except (ValueError, OSError) as e:
        print(f"factweave: {e}", file=sys.stderr)
        return 1


def execute(spark: SparkSession, args: argparse.Namespace, config: Config) -> str:
    store, provider = keyed.Store(spark, config.store), RuleProvider(config.embedding_dims)
    if args.command == "report":
        return _report(store, args.splice)
    if args.command == "backfill":
        new = written(keyed.backfill(store.read("claims", schema("claims")), store.read("embedding_cache", schema("embedding_cache")), provider.name), "backfill")
        store.append("embedding_cache", new.withColumn("created_at", F.current_timestamp()))
        return f"{new.count()} vectors added"
    if args.command == "ingest":
        docs, sections = ingest(spark, args.targets[0])
        if args.save:
            old = unchanged(store, docs)
            save(store, docs.join(old, "id", "left_anti"), sections.join(old.withColumnRenamed("id", "document_id"), "document_id", "left_anti"), None)
        # of the texts only the beginnings of sections are shown
        shown = F.transform("sections", lambda s: F.substring(F.col("text"), s["char_start"] + 1, F.least(s["char_end"] - s["char_start"], F.lit(args.preview)))) if args.preview else F.array()
        out = docs.withColumn("previews", shown).drop("text").orderBy("arxiv_id", "version")
        rows = (r.asDict(recursive=True) for r in out.toLocalIterator())
        if args.json:
            return json.dumps([{k: v for k, v in r.items() if k != "previews"} for r in rows], indent=2)
        return "\n\n".join(f"{r['arxiv_id']} v{r['version']}: {r['error'] or ''}\n{report.section_tree(r['sections'] or [], r['previews'])}" for r in rows)
    classify, verify = not args.no_classifier, not args.no_verifier
    if args.command == "eval":
        docs, sections = ingest(spark, args.targets[0])
        good = docs.filter("error is null").select(F.col("id").alias("doc_id"), "text")
        own = sections.select(F.col("document_id").alias("doc_id"), "path", "title", "level", "ordinal", "char_start", "char_end")
        out = evaluate.evaluate(good, own, provider, args.per_paper, args.seed, args.control_only, config.top_k, config.min_similarity, classify, verify, store)
        if args.json:
            return json.dumps({"by_type": []} | out["metrics"] | {"run_id": out["run_id"]}, indent=2)
        return report.stats_text({f"{arm} {k}": v for arm in ("control", "injected") for k, v in out["metrics"][arm].items()})
    if args.command == "analyze":
        docs, sections = ingest(spark, args.targets[0])
        old = written(unchanged(store, docs), "unchanged").withColumnRenamed("id", "document_id")
        fresh = sections.join(old, "document_id", "left_anti")
        known = store.read("claims", schema("claims")).join(old, "document_id", "left_semi")
        fresh_claims = claims_of(spark, fresh, store, provider)
        claims = written(known.unionByName(fresh_claims.select(*schema("claims").names)), "analyzed")
        save(store, docs.join(old.withColumnRenamed("document_id", "id"), "id", "left_anti"), fresh, fresh_claims)
        found, stats = run_detection(with_paths(claims, store), "intra", config, store, True, provider, classify, verify)
    else:
        documents = store.read("documents", schema("documents"))
        wanted = [r[0] for r in spark.createDataFrame([(x,) for x in args.targets], "raw string").select(ids.parse_arxiv_id(F.col("raw"))["id"]).collect()] if args.targets else None
        if wanted and None in wanted:
            raise ValueError(f"not a paper id: {args.targets[wanted.index(None)]}")
        members = with_paths(detect.corpus(store.read("claims", schema("claims")), documents, wanted), store)
        found, stats = run_detection(members, "cross" if args.command == "corpus" else "intra", config, store, args.command == "corpus" or not wanted, provider, classify, verify)
    if args.json:
        return json.dumps({"findings": found, "stats": stats}, indent=2, default=str)
    return f"{report.findings_text(found)}\n\n{report.stats_text(stats)}"


if __name__ == "__main__":
    sys.exit(main())
