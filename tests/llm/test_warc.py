import io

import pytest
import zstandard

from factweave.llm import warc

from .test_html_extract import PAGES

ROWS = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (5, "http://a/5", "same"), (2, None, None), (9, "bad\r\nurl: x", ""), (3, "u", "x" * 300_000), (None, "n", "same"), (4, "é", "größe 😀")]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "more") for r in ROWS], PAGES + ", payload_bytes string")
    archives = warc.write_archives(pages, f"file://{tmp_path}/warc")
    archives.write.parquet(str(tmp_path / "list"))
    got = warc.read_archives(spark.read.parquet(str(tmp_path / "list"))).collect()
    newest = {"same": 5, "": 9, "x" * 300_000: 3, "größe 😀": 4}
    want = []
    for i, _, html in ROWS:
        payload = (html or "").encode()
        response = i == newest[html or ""]
        want.append((i, payload if response else None, len(payload), warc.base32_sha1(payload), "response" if response else "revisit", None if response else newest[html or ""]))
    assert sorted(((r.page_id, r.payload and bytes(r.payload) if r.payload != b"" else b"", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)


def archive(*records, dictionary=b"WARC/1.1 some words"):
    out = io.BytesIO()
    writer = warc.Writer(out, dictionary)
    for r in records:
        writer.write(r)
    return out.getvalue()


def test_one_frame_per_record_behind_a_dictionary():
    records = [warc.page_record(i, "http://x", b"p" * i, None, False) for i in range(1, 50)]
    data = archive(*records)
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    assert list(warc.read_frames(io.BytesIO(data), chunk=7)) == records
    raw = archive(*records)
    plain = warc.SKIPPABLE.to_bytes(4, "little") + (5).to_bytes(4, "little") + b"12345" + raw[8 + int.from_bytes(raw[4:8], "little") :]
    with pytest.raises(warc.WarcError):  # another dictionary can't decode them
        [warc.parse_record(x) for x in warc.read_frames(io.BytesIO(plain))]


@pytest.mark.parametrize(
    "broken",
    [
        lambda d: d[:-3],
        lambda d: d[4:],
        lambda d: d[:20],
        lambda d: d + b"garbage",
    ],
)
def test_broken_archives_are_reported(broken):
    data = archive(warc.page_record(1, "u", b"text", None, False))
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(io.BytesIO(broken(data))))


@pytest.mark.parametrize(
    ("old", "new"),
    [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC-Date", b"WARC-Data"), (b"hello", b"hullo"), (b"WARC-Type: response", b"WARC-Type response")],
)
def test_broken_records_are_reported(old, new):
    good = warc.page_record(1, "http://x", b"hello", None, False)
    assert warc.read_page(good)["payload"] == b"hello"
    with pytest.raises(warc.WarcError):
        warc.read_page(good.replace(old, new, 1))


def test_dictionaries_help_and_small_samples_work():
    page = b"<html><head><title>%d</title></head><body><nav>menu</nav><p>text %d</p></body></html>"
    samples = [page % (i, i * 7) for i in range(400)]
    dictionary = warc.train(samples, 2048)
    assert len(archive(*samples[:50], dictionary=dictionary)) - len(dictionary) < 0.5 * sum(len(zstandard.compress(s)) for s in samples[:50])
    assert warc.train([]) and warc.train([b"a"])


def test_empty(spark, tmp_path):
    archives = warc.write_archives(spark.createDataFrame([], PAGES), f"file://{tmp_path}/warc")
    assert warc.read_archives(archives).count() == 0
