"""WARC archives compressed with Zstandard and a shared dictionary: writer and reader.

An archive is one leading skippable frame with the dictionary, then one frame per record. The reader
loads the dictionary, decodes frame by frame with bounded memory, and checks headers, lengths and
digests. Archives lie in the shared folder and are opened through pyarrow's file systems by URI
(file, hdfs, s3, gs), so any executor reads what another has written; an archive is written under a
name of its attempt and then renamed, so a retried task leaves no half archive behind.

Records with equal payloads: the one with the largest page id is the response, the others are
revisits that refer to it. The choice is one pre-aggregated maximum per digest; no group is collected.

Defined cases: null html is an empty payload; a null page id is smaller than any other; rows with the same page id
and payload as the response are responses too (one capture, repeated); a null or strange URL is
percent-encoded where a header can't hold it; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, quoted, table

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Pages whose first bytes train the dictionary, and how many bytes of each. Only compression depends on them.
SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 256, 8192, 32768
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or record that doesn't hold what its headers say."""


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path within it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary; with too few samples the samples themselves are the (raw) dictionary."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {quote(v, safe=_SAFE)}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(32, 127))


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One response record, or a revisit record that has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("WARC-Block-Digest", "sha1:" + base32_sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return record(headers, block)


class Writer:
    """Writes the dictionary frame, then a frame per record."""

    def __init__(self, stream, dictionary: bytes, level: int = 3):
        self.stream = stream
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
        stream.write(SKIPPABLE.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)

    def write(self, data: bytes) -> None:
        self.stream.write(self.compressor.compress(data))


def read_dictionary(stream) -> bytes:
    head = stream.read(8)
    if len(head) < 8 or int.from_bytes(head[:4], "little") != SKIPPABLE:
        raise WarcError("no dictionary frame at the start of the archive")
    size = int.from_bytes(head[4:], "little")
    data = stream.read(size)
    if len(data) != size:
        raise WarcError("the dictionary frame is cut short")
    return zstandard.ZstdDecompressor().decompressobj().decompress(data) if data[:4] == ZSTD_MAGIC else data


def read_frames(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decoded frames after the dictionary; memory for one record and one chunk."""
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(read_dictionary(stream)))
    rest = b""
    while rest or (rest := stream.read(chunk)):
        frame, parts = decompressor.decompressobj(), []
        try:
            while not frame.eof:
                if not rest and not (rest := stream.read(chunk)):
                    raise WarcError("the last frame is cut short")
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from e
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of exactly one record, checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line or end of headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"no header: {line[:80]}")
        headers[name.strip()] = value.strip()
    for name in MANDATORY:
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't fit the frame")
    block = rest[:-4]
    if headers.get("WARC-Block-Digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise WarcError("WARC-Block-Digest doesn't fit the block")
    return headers, block


def _page(headers: dict[str, str], name: str) -> int | None:
    number = headers[name].removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_page(data: bytes) -> dict:
    """The row of a page's record, with its payload (None for revisits)."""
    headers, block = parse_record(data)
    http, found, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not found or length is None:
        raise WarcError("no HTTP header in the block")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (length != len(payload) or digest != base32_sha1(payload)):
        raise WarcError("the payload doesn't fit its length or digest")
    return {
        "page_id": _page(headers, "WARC-Record-ID"), "url": headers.get("WARC-Target-URI"), "payload": None if revisit else payload, "payload_bytes": length,
        "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": _page(headers, "WARC-Refers-To") if revisit else None,
    }


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", dictionary: bytes | None = None) -> DataFrame:
    """Write archives into folder (an URI that all executors reach); (path, records) of each."""
    rows = pages.select(quoted(key).alias("page_id"), quoted(url).alias("url"), F.coalesce(quoted(html), F.lit("")).cast("binary").alias("payload"))
    if dictionary is None:
        some = rows.select(F.substring("payload", 1, SAMPLE_BYTES)).limit(SAMPLE_PAGES).collect()
        dictionary = train([bytes(r[0]) for r in some])
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    newest = keyed.groupBy("digest").agg(F.max("page_id").alias("newest")).withColumnRenamed("digest", "of")
    ready = keyed.join(newest, F.col("digest") == F.col("of")).select("page_id", "url", "payload", "newest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = file_system(folder)
        where.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        own, n = f"{path}/.{part}-{uuid.uuid4().hex}", 0
        with where.open_output_stream(own, compression=None) as stream:
            writer = Writer(stream, dictionary)
            for batch in batches:
                for row in zip(*batch.columns):
                    page, link, payload, newest = (x.as_py() for x in row)
                    revisit = page != newest
                    writer.write(page_record(page, link, payload, newest if revisit else None, revisit))
                    n += 1
        if not n:
            where.delete_file(own)
            return
        where.move(own, f"{path}/pages-{part:06d}.warc.zst")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/pages-{part:06d}.warc.zst"]), pa.array([n], pa.int64())], names=["path", "records"])

    return ready.mapInArrow(write, "path string, records long")


READ_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, columns: tuple[str, ...] = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")) -> DataFrame:
    """The records of the archives at `path`, one row each; only the named columns leave the reader."""
    schema = ", ".join(x for x in READ_SCHEMA.split(", ") if x.split()[0] in columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["path"]:
                where, path = file_system(uri)
                held, size = [], 0
                with where.open_input_stream(path, compression=None) as stream:
                    for data in read_frames(stream):
                        row = read_page(data)
                        size += len(row["payload"] or b"") if "payload" in columns else 100
                        held.append([row[c] for c in schema_names])
                        if size > 8 << 20:
                            yield frame(held)
                            held, size = [], 0
                if held:
                    yield frame(held)

    schema_names = [x.split()[0] for x in schema.split(", ")]
    kinds = dict(x.split() for x in schema.split(", "))

    def frame(rows: list[list]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=schema_names)
        return out.astype({c: "Int64" for c, k in kinds.items() if k == "long"})

    return archives.select("path").mapInPandas(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as records, then read back from the archives."""
    folder = new_path(spark, "warc")
    listed = folder + "-list"
    write_archives(table(spark, sf_dir, "pages"), folder).write.parquet(listed)
    archives = spark.read.schema("path string, records long").parquet(listed)
    n = max(1, spark.sparkContext.defaultParallelism)
    return read_archives(archives.repartition(n), ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


# The base32 digest is spelled out five bits at a time.
ORACLE = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS newest FROM d
)
SELECT page_id, payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1), '' ORDER BY i)
   FROM range(32) t(i)) AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM r
"""
