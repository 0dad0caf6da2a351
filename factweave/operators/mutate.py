"""Known contradictions: plan, sample, apply and score mutations of repeated decimals.

A decimal that stands in two sections with the same word beside it is changed in the first of them,
to another of the same width, so every other offset stays valid.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import perturb_same_length, sample_order
from ..functions.text import decimal_sites
from ..schemas import stable_id

VARIANT_BASE = 900_000


def sites(documents: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, literal, signature, path): decimals inside a section and with a signature.

    documents have (key, text), sections (key, path, ordinal, char_start, char_end).
    """
    found = documents.filter(F.col("text").rlike(r"[0-9]\.[0-9]")).select(key, F.explode(decimal_sites(F.col("text"))).alias("s")).select(key, "s.*").filter("signature is not null")
    inside = found.join(sections.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col("start") >= F.col("char_start")) & (F.col("start") < F.col("char_end")))
    first = inside.groupBy(key, "start", "end", "literal", "signature").agg(F.min_by("path", "ordinal").alias("path"))
    return first


def plan(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One mutation per literal: of the word groups in order of appearance the first that stands in two sections."""
    per_path = found.groupBy(key, "literal", "signature", "path").agg(F.min(F.struct("start", "end")).alias("site"))
    groups = per_path.groupBy(key, "literal", "signature").agg(F.sort_array(F.collect_list(F.struct("site", "path"))).alias("at"))
    paired = groups.filter(F.size("at") >= 2)
    best = paired.groupBy(key, "literal").agg(F.min(F.struct(F.col("at")[0]["site"]["start"].alias("first"), "signature", "at")).alias("b"))
    a, b = F.col("b.at")[0], F.col("b.at")[1]
    rows = best.select(
        key, F.lit("NUMERIC").alias("mutation_type"), a["site"]["start"].alias("char_start"), a["site"]["end"].alias("char_end"), F.col("literal").alias("original_text"),
        perturb_same_length("literal").alias("mutated_text"), b["site"]["start"].alias("counterpart_start"), b["site"]["end"].alias("counterpart_end"),
        a["path"].alias("section_path"), b["path"].alias("counterpart_section_path"), F.col("b.signature").alias("signature"),
    ).filter("mutated_text is not null")
    note = F.format_string('%s %s stands in "%s" and in "%s"; the first becomes %s', "original_text", "signature", "section_path", "counterpart_section_path", "mutated_text")
    return rows.withColumn("note", note)


def plan_order(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, literal, first): where each literal first stands, which orders the plan."""
    return found.groupBy(key, F.col("literal").alias("original_text")).agg(F.min("start").alias("first"))


def sample(planned: DataFrame, order: DataFrame, count: int, seed: int, key: str = "doc_id") -> DataFrame:
    """`count` mutations of each document, drawn with the seed; index is the place in the draw.

    The draw depends on the number of mutations of the document alone, so each rank looks up its
    place; a document's mutations are bound by its own decimals.
    """
    ranked = planned.join(order, [key, "original_text"]).withColumn("rank", F.expr(f"cast(row_number() over (partition by {key} order by first, original_text) - 1 as int)"))
    ranked = ranked.withColumn("of", F.expr(f"cast(count(*) over (partition by {key}) as int)"))

    @F.pandas_udf("int")
    def place(rank: pd.Series, of: pd.Series) -> pd.Series:
        places: dict[int, dict[int, int]] = {}
        for n in set(of):
            places[n] = {j: i for i, j in enumerate(sample_order(int(n), seed))}
        return pd.Series([places[n][r] for r, n in zip(rank, of)], dtype="int32")

    return ranked.withColumn("index", place("rank", "of")).filter(F.col("index") < count).drop("rank", "of", "first")


def apply(documents: DataFrame, mutations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mutations with the mutated text; fails if a site doesn't hold what was planned."""
    joined = mutations.join(documents.select(key, "text"), key)
    width = F.col("char_end") - F.col("char_start")
    there = F.substring(F.col("text"), F.col("char_start") + 1, width) == F.col("original_text")
    moved = F.concat(F.lit("a mutation site moved: "), F.col("original_text"), F.lit(" at "), F.col("char_start").cast("string"))
    text = F.when(there, F.overlay("text", "mutated_text", F.col("char_start") + 1, width)).otherwise(F.raise_error(moved))
    return joined.withColumn("text", text)


def variants(applied: DataFrame, run_id: str, key: str = "doc_id") -> DataFrame:
    """Document rows of the mutated variants."""
    version = F.lit(VARIANT_BASE) + F.col("index")
    return applied.select(
        stable_id(F.lit(run_id), F.col(key), version).alias("id"), F.col(key).cast("string").alias("arxiv_id"), version.alias("version"),
        F.concat(F.col(key).cast("string"), F.lit(" [eval variant "), F.col("index").cast("string"), F.lit("]")).alias("title"),
        F.sha2("text", 256).alias("content_hash"), F.length("text").alias("text_length"), F.lit(run_id).alias("eval_run_id"), "text",
    )


def variant_sections(applied: DataFrame, sections: DataFrame, run_id: str, key: str = "doc_id") -> DataFrame:
    """Section rows of the variants: the clean document's, hashed again over the mutated text."""
    version = F.lit(VARIANT_BASE) + F.col("index")
    rows = applied.select(key, "index", "text").join(sections, key)
    document = stable_id(F.lit(run_id), F.col(key), version)
    body = F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return rows.select(stable_id(document, F.col("ordinal")).alias("id"), document.alias("document_id"), "path", "title", "level", "ordinal", "char_start", "char_end", F.sha2(body, 256).alias("content_hash"))


def overlaps(start, end, low, high):
    """Half-open spans overlap; a null span overlaps nothing."""
    return F.coalesce((start < high) & (end > low), F.lit(False))


def score(mutations: DataFrame, findings: DataFrame, key: str = "document_id") -> DataFrame:
    """mutations (key, char_start, char_end, ...) with detected and the first finding (by id) that overlaps.

    findings have (key, id, spans STRUCT<a, b>).
    """
    names = mutations.columns
    f = findings.select(F.col(key).alias("_k"), F.col("id").alias("_f"), F.col("spans").alias("_s"))
    hit = overlaps(F.col("_s.a.start"), F.col("_s.a.end"), F.col("char_start"), F.col("char_end")) | overlaps(F.col("_s.b.start"), F.col("_s.b.end"), F.col("char_start"), F.col("char_end"))
    joined = mutations.join(f, (F.col(key) == F.col("_k")) & hit, "left")
    return joined.groupBy(*names).agg(F.min("_f").alias("matched_finding")).withColumn("detected", F.col("matched_finding").isNotNull())
