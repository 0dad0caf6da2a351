import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import quality

from .data import DOCS, WORD, documents

LABELS = "doc_id long, quality int, toxic int"


def base(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #*\n\t\x0b|é 😀", max_size=60))
def test_base_figures(text):
    assert quality.base_figures(text.encode()) == base(text)


def test_stretches_give_all_trigrams_once(monkeypatch):
    monkeypatch.setattr(quality, "STRETCH", 5)
    text = bytes(range(40, 90))
    got = [int(b) for part in quality.ngram_buckets(text) for b in part]
    monkeypatch.setattr(quality, "STRETCH", 1 << 20)
    assert got == [int(b) for part in quality.ngram_buckets(text) for b in part] and len(got) == len(text) - 2
    assert [list(p) for p in quality.ngram_buckets(b"ab")] == []


def scores(rows, trusted):
    grams = lambda t: [(t or "").encode()[i : i + 3] for i in range(len((t or "").encode()) - 2)]
    bucket = lambda g: ((int.from_bytes(g, "big") * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 48
    corpus, good = Counter(), Counter()
    for i, t, *_ in rows:
        found = [bucket(g) for g in grams(t)]
        corpus.update(found)
        good.update(found if i in trusted else [])
    share = sum(good.values()) / max(1, sum(corpus.values()))
    ratio = lambda b: math.log(good[b] + 1) - math.log(share * corpus[b] + 1)
    return [sum(ratio(bucket(g)) for g in grams(t)) / max(1, len(grams(t))) for _, t, *_ in rows]


def cut(good, bad):
    """By trying the middle between any two neighbouring scores."""
    at = sorted({*good, *bad})
    tried = [(sum(g < (x + y) / 2 for g in good) + sum(b >= (x + y) / 2 for b in bad), -(y - x), (x + y) / 2) for x, y in zip(at, at[1:])]
    return min(tried)[2] if good and bad and tried else quality.THRESHOLD


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-9, 9)), st.lists(st.integers(-9, 9)))
def test_the_cut_errs_least(good, bad):
    assert quality.best_cut(np.array(good, float), np.array(bad, float)) == cut(good, bad)


def test_scores_and_verdicts_against_brute_force(spark):
    rows = [r for r in documents(60) if len(r[1] or "") < 50_000]
    rows += [(500 + i, " ".join(f"W{j}***" for j in range(60)), None, None, None) for i in range(5)]
    labels = [(i, 1, 0) for i in range(0, 50)] + [(7, 0, 0), (9, None, 0), (None, 1, 1), (500, 0, 0)]
    out, names = quality.score(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    got = sorted(((r.doc_id, *(r[c] for c in quality.FIGURES), r.base_failed, r.kept, round(r.score, 6)) for r in out.collect()), key=repr)
    want, found = [], scores(rows, set(range(50)) - {7})
    passed = {i: s for (i, t, *_), s in zip(rows, found) if base(t)[0] >= 50 and 100 * base(t)[4] <= 50 * base(t)[0]}
    good, bad = [passed[i] for i in set(range(50)) - {7} if i in passed], [passed[i] for i in (500,)]
    least = cut(good, bad)
    assert least != quality.THRESHOLD
    for (i, t, *_), s in zip(rows, found):
        figures = base(t)
        failed = figures[0] < 50 or 100 * figures[4] > 50 * figures[0]
        want.append((i, *figures, failed, not failed and s >= least, round(s, 6)))
    assert got == sorted(want, key=repr)
    assert any(w[7] for w in want) and all(not w[7] for w in want if w[0] and w[0] >= 500)


def verdicts(out):
    return sorted(((r.doc_id, r.kept, round(r.score, 6)) for r in out[0].collect()), key=repr)


def test_all_labels_count_however_many(spark):
    rows = [r for r in documents(60) if len(r[1] or "") < 50_000]
    rows += [(500 + i, " ".join(f"W{j}***" for j in range(60)), None, None, None) for i in range(5)]
    labels = spark.range(40_000).selectExpr("id as doc_id", "int(id < 500 or id > 20000) as quality", "0 as toxic")  # most of other documents
    found = scores(rows, set(range(500)))
    passed = [base(t)[0] >= 50 and 100 * base(t)[4] <= 50 * base(t)[0] for _, t, *_ in rows]
    good, bad = ([s for (i, *_), s, ok in zip(rows, found, passed) if ok and i in ids] for ids in (range(500), range(500, 600)))
    least = cut(good, bad)
    want = sorted(((i, ok and s >= least, round(s, 6)) for (i, *_), s, ok in zip(rows, found, passed)), key=repr)
    assert verdicts(quality.score(spark.createDataFrame(rows, DOCS), labels)) == want


def test_the_way_for_many_labels_gives_the_same(spark, monkeypatch):
    rows = [r for r in documents(60) if len(r[1] or "") < 50_000]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(70)] + [(7, 0, 0), (None, 1, 0)], LABELS)
    few = verdicts(quality.score(docs, labels))
    monkeypatch.setattr(quality, "SENT", 0)
    monkeypatch.setattr(quality, "HELD", 0)
    assert verdicts(quality.score(docs, labels)) == few and len({kept for _, kept, _ in few}) == 2
    rng = np.random.default_rng(3)
    for n, kinds in ((400, 2), (400, 2), (9, 2), (5, 1), (1, 2)):
        pairs = [(float(x), bool(good)) for x, good in zip(rng.integers(-40, 40, n) / 7, rng.integers(0, kinds, n))]
        got = quality.ranged_cut(spark.createDataFrame(pairs, "score double, good boolean"))
        assert got == cut([x for x, good in pairs if good], [x for x, good in pairs if not good])


def test_keep_good_keeps_columns_types_and_text(spark):
    good = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, good, 5, 0.5), (2, "short", 6, 0.5), (None, None, None, None)], "doc_id long, text string, n_words int, score double")
    out = quality.keep_good(df, spark.createDataFrame([], LABELS))
    assert out.schema == df.schema and [tuple(r) for r in out.collect()] == [(1, good, 5, 0.5)]


def test_labels_are_bounded(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)] + [(3, 0, 0)], LABELS)
    got = {r.doc_id for r in quality.labelled_ids(labels, 1, most=40).collect()}
    assert len(got) == 40 and got == {r.doc_id for r in quality.labelled_ids(labels.repartition(7), 1, most=40).collect()}


def test_empty(spark):
    out = quality.score(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))[0]
    assert out.count() == 0
