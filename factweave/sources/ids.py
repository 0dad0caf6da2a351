"""Paper identifiers and their metadata feed, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import first_tag, one_line, trim_all, unescape_xml

# The two shapes of an identifier and the prefixes people write before one.
MODERN = r"^(\d{4}\.\d{4,5})(?:v(\d+))?$"
LEGACY = r"^([a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v(\d+))?$"
PREFIXES = (r"(?i)^https?://arxiv\.org/(?:abs|pdf|e-print)/", r"(?i)\.pdf$", r"(?i)^arxiv:")


def parse_arxiv_id(raw: Column) -> Column:
    """STRUCT<id, version>; null for what is no identifier. The version is null if none is given."""
    text = trim_all(raw)
    for prefix in PREFIXES:
        text = F.regexp_replace(text, prefix, "")

    def fields(pattern: str) -> Column:
        return F.struct(F.regexp_extract(text, pattern, 1).alias("id"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("version"))

    return F.when(text.rlike(MODERN), fields(MODERN)).when(text.rlike(LEGACY), fields(LEGACY))


def format_arxiv_id(id_: Column, version: Column) -> Column:
    return F.when(version.isNull(), id_).otherwise(F.concat(id_, F.lit("v"), version.cast("string")))


def abs_url(id_with_version: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/abs/"), id_with_version)


def metadata(atom: Column, id_: Column, version: Column) -> Column:
    """STRUCT<id, version, title, published, updated, error> of a feed's first entry."""
    entry = F.when(atom.rlike(r"<entry>[\s\S]*?</entry>"), F.regexp_extract(atom, r"<entry>([\s\S]*?)</entry>", 1))

    def fields(e: Column) -> Column:
        resolved = F.coalesce(version, F.regexp_extract(trim_all(first_tag(e, "id")), r"v(\d+)$", 1).try_cast("int"))
        return let(F.struct(e.alias("entry"), resolved.alias("version"), first_tag(e, "title").alias("title")), checked)

    def checked(m: Column) -> Column:
        e = m["entry"]
        error = (
            F.when(e.isNull(), "no entry")
            .when(e.contains("<title>Error</title>"), F.concat(F.lit("error: "), F.coalesce(trim_all(first_tag(e, "summary")), F.lit(""))))
            .when(m["version"].isNull() | (m["version"] < 1), "no version")
            .when(F.coalesce(m["title"], F.lit("")) == "", "no title")
        )
        return let(error, lambda why: row(m, why))

    def row(m: Column, error: Column) -> Column:
        good = lambda c: F.when(error.isNull(), c)
        return F.struct(
            id_.alias("id"), good(m["version"]).alias("version"), good(one_line(unescape_xml(m["title"]))).alias("title"),
            good(F.coalesce(trim_all(first_tag(m["entry"], "published")), F.lit(""))).alias("published"),
            good(F.coalesce(trim_all(first_tag(m["entry"], "updated")), F.lit(""))).alias("updated"), error.alias("error"),
        )

    return let(entry, fields)
