"""Source bundles (gzip, tar, plain LaTeX, PDF) as a table of files."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How the formats begin, and the names of files that are read.
GZIP, PDF, TAR_AT_257 = b"\x1f\x8b", b"%PDF", b"ustar"
TEXTUAL = re.compile(r"\.(tex|bbl|cls|sty|txt)$", re.I)
CACHE_DAYS = 7
#: Bytes that a bundle may hold unpacked; a larger one is a row with an error.
MAX_BYTES = 1 << 30


def _inflated(data: bytes) -> bytes:
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as stream:
        body = stream.read(MAX_BYTES + 1)
    if len(body) > MAX_BYTES:
        raise OSError(f"more than {MAX_BYTES} bytes unpacked")
    return body


def unpack(data: bytes) -> tuple[dict[str, str], bool, str | None]:
    """(files by path, whether there is only a PDF, error)."""
    try:
        body = _inflated(data) if data.startswith(GZIP) else data
        if data.startswith(PDF) or body.startswith(PDF):
            return {}, True, None
        if body[257:262] != TAR_AT_257:
            return {"main.tex": body.decode("utf-8", "replace")}, False, None
        with tarfile.open(fileobj=io.BytesIO(body)) as tar:
            members = [m for m in tar if m.isreg() and TEXTUAL.search(m.name)]
            return {m.name: tar.extractfile(m).read().decode("utf-8", "replace") for m in members}, False, None
    except (OSError, EOFError, tarfile.TarError, zlib.error) as e:
        return {}, False, f"{type(e).__name__}: {e}"


def read_bundles(spark: SparkSession, path: str, newer_than_days: int | None = None) -> DataFrame:
    """(path, modified, files MAP, pdf_only, error) of the bundles at path; old ones are left out if asked."""
    raw = spark.read.format("binaryFile").load(path)
    if newer_than_days is not None:
        raw = raw.filter(F.col("modificationTime") >= F.current_timestamp() - F.expr(f"interval {newer_than_days} days"))
    return unpack_bundles(raw.select("path", F.col("modificationTime").alias("modified"), "content"))


def unpack_bundles(raw: DataFrame) -> DataFrame:
    """raw (..., content) with files, pdf_only and error for content; one row at a time, so memory is one bundle's."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[[i]]
                files, pdf, error = unpack(bytes(row["content"].iloc[0] or b""))
                yield row.drop(columns="content").assign(files=[files], pdf_only=pdf, error=error)

    schema = raw.drop("content").withColumns({"files": F.lit(None).cast("map<string,string>"), "pdf_only": F.lit(False), "error": F.lit(None).cast("string")}).schema
    return raw.select(*[c for c in raw.columns if c != "content"], "content").mapInPandas(work, schema)
