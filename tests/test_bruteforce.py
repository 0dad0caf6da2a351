"""Queries without SQL against plain Python on the smallest driver tables."""

import os
import re
from collections import defaultdict

import numpy as np
import pytest

from factweave.functions import numbers, text
from factweave.operators.extract import RuleProvider
from factweave.plans import catalog, tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")

NUMBER = re.compile(r"(?<![A-Za-z0-9_.])[0-9]{1,4}\.[0-9]{1,3}(?![A-Za-z0-9_.])")


def word_beside(whole, start, end):
    following = re.match(r"(?:\s|%)*([A-Za-z][A-Za-z-]+)", whole[end : end + text.AFTER_CHARS])
    if following and following[1].lower() not in text.STOPWORDS:
        return following[1].lower()
    left = re.findall("[a-z][a-z-]+", whole[max(0, start - text.BEFORE_CHARS) : start].lower())
    left = [w for w in left if w not in text.STOPWORDS]
    return left[-1] if left else None


@pytest.fixture(scope="module")
def measured(spark):
    docs, sections = tables.measured_documents(spark, SF)
    parts = defaultdict(list)
    for r in sections.collect():
        parts[r.doc_id].append(r)
    return {r.doc_id: (r.text, sorted(parts[r.doc_id], key=lambda s: s.ordinal)) for r in docs.collect()}


@pytest.fixture(scope="module")
def sites(measured):
    out = []
    for doc, (whole, parts) in measured.items():
        for m in NUMBER.finditer(whole):
            word = word_beside(whole, *m.span())
            path = next((s.path for s in parts if s.char_start <= m.start() < s.char_end), None)
            if word and path:
                out.append((doc, m.start(), m.end(), m[0], word, path))
    return out


@pytest.fixture(scope="module")
def plan(sites):
    """doc -> mutations in the order in which their figures first stand."""
    groups, first = defaultdict(dict), {}
    for doc, start, end, literal, word, path in sorted(sites):
        first.setdefault((doc, literal), start)
        groups[doc, literal, word].setdefault(path, (start, end))
    best = {}
    for (doc, literal, word), paths in groups.items():
        at = sorted((span, path) for path, span in paths.items())
        if len(at) >= 2:
            candidate = (at[0][0][0], word, at)
            best[doc, literal] = min(best.get((doc, literal), candidate), candidate)
    out = defaultdict(list)
    for (doc, literal), (_, word, at) in sorted(best.items(), key=lambda x: (x[0][0], first[x[0]], x[0][1])):
        out[doc].append({"doc_id": doc, "original_text": literal, "mutated_text": numbers.perturbed(literal), "signature": word, "char_start": at[0][0][0], "char_end": at[0][0][1], "section_path": at[0][1], "counterpart_start": at[1][0][0], "counterpart_end": at[1][0][1], "counterpart_section_path": at[1][1]})
    return out


def test_decimal_sites(spark, sites):
    got = catalog.decimal_sites(spark, SF).collect()
    assert len(sites) > 500 and sorted((r.doc_id, r.start, r.end, r.literal, r.signature, r.path) for r in got) == sorted(sites)


def test_mutation_plan(spark, plan):
    got = [r.asDict() for r in catalog.mutation_plan(spark, SF).collect()]
    want = [m for rows in plan.values() for m in rows]
    by = lambda rows: sorted(tuple(r[k] for k in sorted(want[0])) for r in rows)
    assert len(want) > 100 and by(got) == by(want)


def test_mutation_sample(spark, plan):
    got = {(r.doc_id, r.original_text, r["index"]) for r in catalog.mutation_sample(spark, SF).collect()}
    assert got == {(doc, rows[numbers.sample_order(len(rows), 42)[0]]["original_text"], 0) for doc, rows in plan.items()}


def test_injection_recall(spark, measured, plan):
    provider = RuleProvider()
    want = []
    for doc, rows in plan.items():
        m = rows[numbers.sample_order(len(rows), 42)[0]]
        whole, parts = measured[doc]
        whole = whole[: m["char_start"]] + m["mutated_text"] + whole[m["char_end"] :]
        claims = []
        for s in parts:
            body = whole[s.char_start : s.char_end]
            if len(body):
                for c in provider.extract([{"path": "0", "text": body}])[0]["claims"]:
                    at = s.char_start + body.index(c["quote"])
                    claims.append((at, at + len(c["quote"]), c))
        vectors = provider.embed([f"{c['subject']}\n{c['quote']}" for _, _, c in claims])
        hit = False
        for i, (a0, a1, a) in enumerate(claims):
            for j, (b0, b1, b) in enumerate(claims[:i]):
                x, y = a["quantities"][0], b["quantities"][0]
                same = all(x[k] == y[k] for k in ("metric", "system", "dataset"))
                ulp = sum(0.5 * 10.0 ** -len(str(v["value"]).rstrip("0").partition(".")[2]) for v in (x, y))
                apart = abs(x["value"] - y["value"])
                near = vectors[i] @ vectors[j] / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j]) >= 0.3
                if same and near and apart > ulp and apart >= 0.005 * max(x["value"], y["value"]):
                    hit |= any(s < m["char_end"] and e > m["char_start"] for s, e in ((a0, a1), (b0, b1)))
        want.append((f"{doc}#0", m["original_text"], m["mutated_text"], hit))
    got = [(r.document_id, r.original_text, r.mutated_text, r.detected) for r in catalog.injection_recall(spark, SF).collect()]
    assert sorted(got) == sorted(want) and sum(w[3] for w in want) > 50
