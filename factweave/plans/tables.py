"""The driver's tables seen as the engine's: claims, sections, verdicts and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measure import QUANTITY


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantity(value, metric, system, dataset, unit=None):
    return F.struct(
        value.cast("double").alias("value"), (F.lit(None) if unit is None else unit).cast("string").alias("unit"), metric.alias("subject"),
        metric.alias("metric"), dataset.cast("string").alias("dataset"), system.cast("string").alias("system"),
    ).cast(QUANTITY)


LINE_FIGURES = ("l_discount", "l_tax", "l_quantity", "l_extendedprice")


def line_quantities(line, part, supplier):
    """A line item's claim: its discount, tax, quantity and price, of a part (system) by a supplier (dataset)."""
    dataset = F.concat(F.lit("supplier "), supplier.cast("string"), F.lit(" test"))
    return F.array(*(quantity(line[c], F.lit(m), part, dataset) for c, m in zip(LINE_FIGURES, ("Discount", "Tax rate", "Quantity", "Price"))))


def vector_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per embedding; its label is the document, its figure hangs on its id."""
    v = read(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    metric = F.when(n % 5 == 0, "Accuracy").otherwise("BLEU")
    system = F.concat(F.lit("Model "), (n % 2).cast("string"))
    return v.select(
        n.alias("id"), F.col("label").cast("long").alias("document_id"), F.concat(F.lit("s"), (n % 7).cast("string")).alias("section_id"),
        F.concat(F.lit("claim "), n.cast("string")).alias("text"), (n * 10).cast("int").alias("char_start"), (n * 10 + 8).cast("int").alias("char_end"),
        F.when(n % 11 == 0, "SCOPE").otherwise("NUMERIC").alias("claim_type"), metric.alias("subject"),
        F.array(quantity(n % 13 + 0.5, metric, system, F.lit("WMT 2014 EN-DE test"))).alias("quantities"), "embedding",
    )


def verdict_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per labelled document with raw answers of both models, some missing, some wrong; quotes come from the middle of the text."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t")), "doc_id")
    n = F.col("doc_id")
    a, b = F.coalesce("t", F.lit("")), F.concat(F.lit("other "), n.cast("string"))
    classification = F.when(
        n % 9 != 0,
        F.struct(
            (F.col("quality") == 1).alias("same_subject"), F.when(n % 4 == 0, "TENSION").when(n % 4 != 3, "CONTRADICTS").alias("verdict"), F.lit("NUMERIC").alias("conflict_type"),
            F.when(n % 6 == 0, "high").otherwise("0.5").alias("confidence"), F.lit("r").alias("rationale"),
        ),
    )
    verification = F.when(
        n % 7 != 0,
        F.struct(
            F.lit("none").alias("strongest_objection"), F.when(n % 5 != 0, n % 5 == 1).alias("objection_succeeds"),
            F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("  "), F.substring(a, F.expr("cast(1 + length(coalesce(t, '')) div 2 as int)"), F.lit(20)), F.lit(" "))).alias("span_a"), F.when(n % 8 == 0, "made up").otherwise(b).alias("span_b"),
        ),
    )
    return rows.select("doc_id", a.alias("text_a"), b.alias("text_b"), classification.alias("classification"), verification.alias("verification"))


def measured_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents, sections): each document twice states figures in two sections, as an abstract and a results part do."""
    n = F.col("doc_id")
    score = F.format_string("%d.%d", n % 90 + 1, n % 9 + 1)
    share = F.format_string("0.%d%d", n % 7 + 1, n % 9 + 1)
    figures = F.concat(F.lit(" BLEU of "), score, F.lit(" for Model "), (n % 5).cast("string"), F.lit(" on test. Accuracy of "), share, F.lit(" for Model "), (n % 5).cast("string"), F.lit(" on test."))
    head = F.concat(F.lit("We report"), figures)
    body = F.concat(F.lit("\n\nHere"), figures)
    docs = read(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", head.alias("head"), F.concat(body, F.lit(" "), F.coalesce("text", F.lit(""))).alias("body"))
    whole = docs.select("doc_id", F.concat("head", "body").alias("text"), F.length("head").alias("h"), (F.length("head") + F.length("body")).alias("e"))
    section = lambda o, title, start, end: F.struct(F.lit(o).alias("ordinal"), F.lit(title).alias("path"), F.lit(title).alias("title"), F.lit(1).alias("level"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"))
    sections = whole.select("doc_id", F.explode(F.array(section(0, "Abstract", F.lit(0), F.col("h")), section(1, "1 Results", F.col("h"), F.col("e")))).alias("s")).select("doc_id", "s.*")
    return whole.select("doc_id", "text"), sections


def meter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as metered calls: the amount is the duration, k of the properties the items."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "event_id", F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("label"), F.col("value").alias("duration_ms"), (F.col("event_id") % 10 != 0).alias("ok"),
        (F.col("event_id") % 100).alias("input_tokens"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 50).alias("output_tokens"), k.alias("items"), F.lit(None).cast("long").alias("bytes"),
    )
