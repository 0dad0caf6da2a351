import hashlib
import re
from collections import defaultdict

from factweave.llm import exact_dedup

from .data import DOCS, documents


def expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for place, (_, _, i) in enumerate(members):
            out.append((i, members[0][2], len(members), place == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_members_against_brute_force(spark):
    rows = documents()
    got = exact_dedup.members(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == expected(rows)


def test_a_small_table_spills_and_recurses_without_loss(spark):
    rows = documents(60, seed=5)
    stay, digest, size, points = exact_dedup.distinct_contents(spark.createDataFrame(rows, DOCS), table_bytes=3000)
    got = {r[digest]: (r["doc_id"], r[size]) for r in stay.collect()}
    assert got == {sha: (keep, n) for _, keep, n, _, sha in expected(rows)}


def test_short_texts_count_with_what_their_entries_take():
    table = exact_dedup.ContentTable()
    for i in range(100):
        table.admit(b"", i, table.find(b"%d" % i, i)[1])
    assert table.held == 100 * exact_dedup.ENTRY_BYTES


def test_levels_get_the_buckets_that_their_size_needs(spark, monkeypatch):
    levels, write = [], exact_dedup.materialize
    monkeypatch.setattr(exact_dedup, "materialize", lambda df, label: levels.append(label) or write(df, label))
    rows = [(i, f"text {i % 3000}") for i in range(3300)]
    stay, _, size, _ = exact_dedup.distinct_contents(spark.createDataFrame(rows, "doc_id long, text string"), table_bytes=200_000)
    got = {r["doc_id"]: (r["text"], r[size]) for r in stay.collect()}
    assert got == {i: (f"text {i}", 2 if i < 300 else 1) for i in range(3000)}
    assert len(levels) <= 3


def test_buckets_have_parts_where_a_shuffle_cannot_have_more(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BUCKETS", 4)
    levels, write = [], exact_dedup.materialize
    monkeypatch.setattr(exact_dedup, "materialize", lambda df, label: levels.append(label) or write(df, label))
    rows = [(i, f"text {i % 3000}", i) for i in range(3300)]
    stay, _, size, _ = exact_dedup.distinct_contents(spark.createDataFrame(rows, "doc_id long, text string, bucket_part int"), table_bytes=100_000)
    got = {r["doc_id"]: (r["text"], r[size], r["bucket_part"]) for r in stay.collect()}
    assert got == {i: (f"text {i}", 2 if i < 300 else 1, i) for i in range(3000)}
    assert len(levels) == 1  # 4 buckets of some 16 parts each; without them four tables would hold a fifteenth


def test_deduplicate_keeps_whole_rows_and_clashing_columns(spark):
    rows = [(1, "a b", "x", 1.5), (2, "a  b", "y", 2.5), (2, "a  b", "y", 2.5), (3, None, None, None), (4, " ", "z", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_sha256 string, group_size double")
    out = exact_dedup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(2, "a  b", "y", 2.5), (4, " ", "z", 0.0)]


def test_contents_with_one_hash_stay_apart():
    table = exact_dedup.ContentTable(slots=4)
    for content in (b"a", b"b", b"c", b"d", b"e"):
        entry, at = table.find(content, 42)
        assert entry == -1
        table.admit(content, 42, at)
    assert [table.find(c, 42)[0] for c in (b"a", b"b", b"c", b"d", b"e")] == [0, 1, 2, 3, 4]


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert exact_dedup.members(df).count() == 0 and exact_dedup.deduplicate(df).count() == 0
