import datetime as dt
import gzip
import hashlib
import io
import json
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave import cli, config, report, schemas
from factweave.functions import measure
from factweave.operators import calls, detect, evaluate, extract, meter, mutate, neighbours, passages, refine
from factweave.plans import catalog
from factweave.sources import bundles, ids, keyed, latex
from factweave.streaming import ingest


# --- neighbours --------------------------------------------------------------------------------


def vectors(n=300, docs=7, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 16))
    rows = [(i, int(rng.integers(docs)), [float(x) for x in base[rng.integers(12)] + rng.normal(size=16) * 0.6]) for i in range(n)]
    return rows + [(n, 0, [0.0] * 16), (n + 1, 0, None), (n + 2, 1, rows[0][2]), (n + 3, 1, rows[0][2])]


def brute(rows, scope, k, t):
    known = [(i, d, np.array(v)) for i, d, v in rows if v is not None and any(v)]
    out = {}
    for i, d, v in known:
        sims = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, e, w in known if j != i and (d == e) == (scope == "intra")]
        for s, j in sorted(sims)[:k]:
            if -s >= t:
                out[min(i, j), max(i, j)] = -s
    return out


@pytest.mark.parametrize("strategy", ["sql", "block"])
@pytest.mark.parametrize(("scope", "k", "t"), [("intra", 3, 0.2), ("cross", 3, 0.2), ("cross", 12, 0.9), ("intra", 12, 0.72)])
def test_neighbours(spark, monkeypatch, strategy, scope, k, t):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rows = vectors()
    out = neighbours.neighbours(spark.createDataFrame(rows, "id long, document_id long, embedding array<double>"), scope, k, t, strategy=strategy)
    got = {(r.a_id, r.b_id): r.similarity for r in out.collect()}
    want = brute(rows, scope, k, t)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-8 for p in want)


@pytest.mark.parametrize("scope", ["intra", "cross"])
def test_equal_vectors_leave_k_partners_of_each(spark, scope):
    rows = [(i, i % 2, [1.0, 2.0]) for i in range(60)]
    units = neighbours.unit_vectors(spark.createDataFrame(rows, "id long, doc long, v array<double>"), "id", "doc", "v")
    near = {(r.a_id, r.b_id) for r in neighbours._block(units, scope, 3, 0.5).collect()}
    other = lambda i: [j for j in range(60) if j != i and (j % 2 == i % 2) == (scope == "intra")]
    assert near == {(i, j) for i in range(60) for j in other(i)[:3]}


@pytest.mark.parametrize("scope", ["intra", "cross"])
def test_vectors_are_shuffled_once(spark, monkeypatch, scope):
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    rows = [(f"v{i}", i // 40 if i < 200 else None, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(210)]
    units = neighbours.unit_vectors(spark.createDataFrame(rows, "id string, doc long, v array<double>"), "id", "doc", "v")
    near = neighbours._block(units, scope, 3, 0.5)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    key = lambda df: {(r.a_id, r.b_id) for r in df.withColumn("n", F.expr("row_number() over (partition by a_id order by round(sim, 9) desc, b_id)")).filter("n <= 3").collect()}
    assert key(near) == key(neighbours._sql(units, scope, 3, 0.5))


def test_lsh_finds_most_and_invents_nothing(spark):
    rows = vectors()
    out = neighbours.neighbours(spark.createDataFrame(rows, "id long, document_id long, embedding array<double>"), "cross", 12, 0.9, strategy="lsh")
    got, want = {(r.a_id, r.b_id) for r in out.collect()}, brute(rows, "cross", 300, 0.9).keys()
    assert got <= want and len(got & brute(rows, "cross", 12, 0.9).keys()) >= 0.9 * len(brute(rows, "cross", 12, 0.9))


def test_baseline(spark):
    row = neighbours.baseline(spark.createDataFrame([(0,)] * 3 + [(1,)] * 2, "document_id int")).first()
    assert tuple(row) == (5, 2, 4, 6, 6)
    assert tuple(neighbours.baseline(spark.createDataFrame([], "document_id int")).first()) == (0, 0, 0, 0, 0)


# --- the queries' own steps -------------------------------------------------------------------------


def test_labels_of_equal_words_are_compared_once(spark):
    """The result of the pairwise functions, however many rows share a label; the comparison sees labels, not rows."""
    labels = ["WMT14 En-De test", "wmt 2014 EN-DE TEST", "test", "dev", "", None]
    rows = spark.createDataFrame([("b", i % 2, None if i == 30 else i, labels[i % 6 if i < 24 else 0]) for i in range(40)] + [("b", 1, 7, "dev")], "p_brand string, p_size int, p_partkey long, label string")
    out = catalog._label_pairs(rows, 3)
    side = lambda s: rows.select("p_brand", "p_size", F.col("p_partkey").alias(f"{s}_key"), F.col("label").alias(f"{s}_label"), catalog.t.quantity(F.lit(1.0), F.lit("BLEU"), F.lit("m"), F.col("label")).alias(f"{s}_q"))
    pairs = side("a").join(side("b"), ["p_brand", "p_size"]).filter("a_key < b_key")
    a, b = F.col("a_label"), F.col("b_label")
    want = pairs.select("a_key", "b_key", measure.same_tokens(a, b), measure.subsumes(a, b), measure.same_measurement(F.col("a_q"), F.col("b_q")))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_only_lines_with_a_partner_become_claims(spark):
    row = lambda order, line, part, supplier, price: (order, line, part, supplier, 1.0, price, 0.05, 0.02)
    rows = [row(i, 1, i, 1, 10.0) for i in range(50)] + [row(90, 1, 7, 2, 10.0), row(91, 1, 7, 2, 20.0), row(92, 2, 7, 2, 10.0), row(93, 1, None, 2, 1.0), row(94, 1, None, 2, 2.0), row(95, 1, 99, 2, 1.0), row(96, 1, 99, 2, 2.0)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    parts = spark.createDataFrame([(i, f"part {i}") for i in range(50)], "p_partkey long, p_name string")
    pairs = catalog._line_pairs(lines, parts, 3)
    found = {(r.a_line, r.b_line): (r.compared, r.best and r.best.r) for r in detect.conflicts(pairs).collect()}
    assert found == {(901, 911): (4, 0.5), (901, 922): (4, None), (911, 922): (4, 0.5)}
    # what is shuffled by line has keys and figures, no labels
    below = [node.partition("LogicalRDD")[0] for node in pairs._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1:]]
    assert len(below) == 1 and "l_suppkey" in below[0] and "p_name" not in below[0] and "transform" not in below[0]


# --- detection ---------------------------------------------------------------------------------


def claims(spark):
    q = lambda v, m="BLEU", d=None: {"value": v, "unit": None, "subject": m, "metric": m, "dataset": d, "system": "ours"}
    rows = [
        (1, "A", [q(10.0), q(50.0, "Acc")], "NUMERIC"), (2, "A", [q(10.5), q(60.0, "Acc"), q(70.0, "Acc")], "NUMERIC"), (3, "A", [q(10.0)], "SCOPE"), (4, "B", [q(13.0)], "NUMERIC"), (5, "B", [], "NUMERIC"),
    ]
    rows = [(i, d, "s", f"claim {i}", i, i + 5, kind, "x", quantities, [1.0, 0.1 * i]) for i, d, quantities, kind in rows]
    return spark.createDataFrame(rows, f"id long, document_id string, section_id string, text string, char_start int, char_end int, claim_type string, subject string, quantities array<{schemas._DDL['claims'].split('array<')[1].split('>>')[0]}>>, embedding array<double>")


def test_best_conflict_wins_and_types_must_agree(spark):
    pairs, found, stats = detect.detect(claims(spark), "intra", 12, 0.5)
    got = found.collect()
    assert [(r.a_id, r.b_id, r.quantity_a.value, r.quantity_b.value, r.compared) for r in got] == [(1, 2, 50.0, 70.0, 3)]
    assert got[0].confidence == 1.0 and got[0].verifier_passed is None and "20.0 apart" in got[0].rationale
    s = stats.first()
    assert (s.candidates, s.after_type_filter, s.baseline) == (4, 2, 4) and s.reduction_percent == 0
    assert pairs.filter("survived_type_filter").count() == 2
    cross = detect.detect(claims(spark), "cross", 12, 0.5)[1].collect()
    assert sorted((r.a_id, r.b_id) for r in cross) == [(1, 4), (2, 4)]
    with pytest.raises(ValueError, match="two different documents"):
        detect.detect(claims(spark).filter("document_id = 'A'"), "cross")


def test_corpus_takes_the_latest_version(spark):
    documents = spark.createDataFrame([("A", "p", 1, None), ("B", "p", 2, None), ("C", "q", 1, "run")], "id string, arxiv_id string, version int, eval_run_id string").withColumn("title", F.lit("t"))
    members = detect.corpus(claims(spark), documents, ["p", "p", "q"])
    assert {r.id for r in members.collect()} == {4, 5} and tuple(detect.corpus_size(members).first()) == (1, 2)


# --- gates -------------------------------------------------------------------------------------

RAW = f"i int, text_a string, text_b string, classification {refine.CLASSIFICATION}, verification {refine.VERIFICATION}"
C = lambda same=True, verdict="CONTRADICTS", confidence="0.9": {"same_subject": same, "verdict": verdict, "conflict_type": None, "confidence": confidence, "rationale": None}
V = lambda a="aa b", b="cc", succeeds=False: {"strongest_objection": "o", "objection_succeeds": succeeds, "span_a": a, "span_b": b}
CASES = [
    (C(), V(), "reported", None), (C(), None, "rejected", "not-returned"), (C(), V(succeeds=True), "rejected", "objection-succeeded"), (C(), V(succeeds=None), "rejected", "objection-succeeded"),
    (C(), V(a=" "), "rejected", "span-not-quoted"), (C(), V(b=None), "rejected", "span-not-quoted"), (C(), V(b="zz"), "rejected", "span-not-found"), (C(), V(a=" aa \n b "), "reported", None),
    (None, V(), "different-subject", None), (C(same=False), V(), "different-subject", None), (C(same=None), V(), "different-subject", None), (C(verdict="TENSION"), V(), "reported", None),
]


def raw(spark):
    return spark.createDataFrame([(i, "x aa  b y", "cc", c, v) for i, (c, v, *_) in enumerate(CASES)], RAW)


def test_refine(spark):
    got = refine.refine(raw(spark)).orderBy("i").collect()
    assert [(r.outcome, r.reason) for r in got] == [c[2:] for c in CASES]
    strict = refine.refine(raw(spark), deterministic_conflict=False).filter("i = 11").first()
    assert (strict.outcome, strict.passed) == ("not-contradiction", None)
    off = refine.refine(raw(spark), classify=False, verify=False)
    assert off.filter("reported and passed is null").count() == len(CASES)
    stats = refine.refine_stats(refine.refine(raw(spark))).first().asDict()
    assert stats == {"candidates": 12, "classifier_calls": 1, "verifier_calls": 1, "rejected_different_subject": 3, "rejected_not_contradiction": 0, "rejected_by_verifier": 6, "reported": 3}
    assert {r.reason: r.n for r in refine.rejection_reasons(refine.refine(raw(spark))).collect()} == {"not-returned": 1, "objection-succeeded": 2, "span-not-quoted": 2, "span-not-found": 1}
    assert refine.ablation(raw(spark)).count() == 4


def test_normalised_classification(spark):
    rows = spark.createDataFrame([(0, C(confidence="high")), (1, C(same=False)), (2, None), (3, C(verdict=None))], f"i int, c {refine.CLASSIFICATION}")
    got = [tuple(r.x)[1:4:2] for r in rows.select("i", refine.normalise_classification(F.col("c")).alias("x")).orderBy("i").collect()]
    assert got == [("CONTRADICTS", 0.0), ("NEUTRAL", 0.9), ("NEUTRAL", 0.0), ("NEUTRAL", 0.9)]


# --- extraction, caches ------------------------------------------------------------------------


def test_batches(spark):
    assert extract.greedy([5000, 6000, 2000, 20_000, 0, 12_000, 1], 12_000) == [0, 0, 1, 2, 3, 3, 4] and extract.greedy([]) == []
    rng = random.Random(5)
    rows = [(k, o, rng.choice([0, 10, 300, 900])) for k in range(8) for o in range(rng.randint(1, 20))]
    got = {(r.k, r.o): r.batch_no for r in extract.greedy_batches(spark.createDataFrame(rows, "k int, o int, n int"), "k", "o", "n", 700).collect()}
    for key in range(8):
        own = [(o, n) for k, o, n in rows if k == key]
        assert [got[key, o] for o, _ in own] == extract.greedy([n for _, n in own], 700)


class Counting(extract.RuleProvider):
    """Writes a line for every section it is asked for."""

    def __init__(self, log):
        super().__init__(16)
        self.log = log

    def extract(self, sections):
        with open(self.log, "a") as f:
            f.write("x\n" * len(sections))
        return super().extract(sections)


PAPER = r"""\documentclass{article} \newcommand{\sys}{Model 7} % note
\begin{document}\begin{abstract}We improve. BLEU of 41.8 for \sys{} on test. %s\end{abstract}
\section{Results}BLEU of 41.0 for \sys{} on test. %s
\section*{References}BLEU of 1.0 for X.\end{document}""".replace("%s", "Some more words follow here to fill the section. " * 8)


def test_command_line_end_to_end(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "papers").mkdir()
    for name in ("2301.00001v1", "2301.00002v3"):
        (tmp_path / "papers" / f"{name}.gz").write_bytes(gzip.compress(PAPER.encode()))
    (tmp_path / "papers" / "2301.00003v1.gz").write_bytes(b"%PDF-1.5")
    monkeypatch.setenv("FACTWEAVE_STORE", str(tmp_path / "store"))
    monkeypatch.setenv("FACTWEAVE_MIN_SIMILARITY", "0.3")
    monkeypatch.setattr(cli, "session", lambda: spark)
    log = str(tmp_path / "log")
    open(log, "w").close()
    monkeypatch.setattr(cli, "RuleProvider", lambda dims: Counting(log))
    papers = str(tmp_path / "papers")
    assert cli.main(["ingest", papers, "--json"]) == 0
    assert capsys.readouterr().out.count("char_start") == 6
    assert cli.main(["analyze", papers]) == 0
    first = capsys.readouterr().out
    assert first.count("NUMERIC") == 2 and "41.8 against 41" in first
    asked = len(open(log).readlines())
    assert asked == 2  # both papers have the same two sections of enough length; references are left out
    assert cli.main(["analyze", papers]) == 0 and capsys.readouterr().out == first
    assert len(open(log).readlines()) == asked
    assert cli.main(["detect"]) == 0 and capsys.readouterr().out.count("NUMERIC") == 2
    assert cli.main(["corpus", "2301.00001", "arXiv:2301.00002"]) == 0 and capsys.readouterr().out.count("NUMERIC") == 2
    assert cli.main(["corpus", "2301.00001"]) == 1 and cli.main(["corpus", "nonsense", "2301.00002"]) == 1
    capsys.readouterr()
    assert cli.main(["report"]) == 1 and "no evaluation run" in capsys.readouterr().err
    assert cli.main(["eval", papers, "--control-only", "--json", "--no-verifier"]) == 0 and '"papers": 2' in capsys.readouterr().out
    page = tmp_path / "page.md"
    page.write_text(f"head {report.START} {report.END}")
    assert cli.main(["report", "--splice", str(page)]) == 0 and "| Clean control papers | 2 |" in page.read_text() and "Verification | disabled" in page.read_text()
    assert cli.main(["backfill"]) == 0 and capsys.readouterr().out.endswith("0 vectors added\n")
    store = keyed.Store(spark, str(tmp_path / "store"))
    events = store.read("meter_events", schemas.schema("meter_events"))
    assert {r.kind for r in events.select("kind").distinct().collect()} == {"llm.generate", "llm.embed"} and events.filter("not ok").isEmpty()
    run = evaluate.latest_run(store.read("eval_runs", schemas.schema("eval_runs"))).first()
    assert run.finished_at and run.classifier_enabled and not run.verifier_enabled


class Judge(extract.RuleProvider):
    """Answers by the figures in the texts: 1 another subject, 2 an objection, 3 no verification, 4 a made-up quote, 5 nonsense."""

    def __init__(self, log):
        super().__init__(16)
        self.log = log

    def note(self, kind, n):
        with open(self.log, "a") as f:
            f.write(f"{kind} {n}\n")

    def classify(self, pairs):
        self.note("classify", len(pairs))
        return ["{broken" if "case 5" in p["text_a"] else {"same_subject": "case 1" not in p["text_a"], "verdict": "CONTRADICTS", "confidence": "0.9", "more": 1} for p in pairs]

    def verify(self, findings):
        self.note("verify", len(findings))
        out = []
        for f in findings:
            case = f["text_a"][5]
            out.append(None if case == "3" else {"strongest_objection": "o", "objection_succeeds": case == "2", "span_a": "made up" if case == "4" else f["text_a"], "span_b": f["text_b"]})
        return out


def cases(spark):
    q = lambda v, i: [{"value": v, "unit": None, "subject": "BLEU", "metric": "BLEU", "dataset": None, "system": f"s{i}"}]
    rows = [(10 * i + s, f"D{i}", "s", f"case {i} {s}", 0, 5, "NUMERIC", f"subject {i}", q(v, i), [float(i == k) for k in range(7)]) for i in range(6) for s, v in ((0, 10.0), (1, 20.0))]
    return spark.createDataFrame(rows, claims(spark).schema)


def test_each_switch_changes_the_findings_and_a_second_run_asks_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    reported = {}
    for classify in (True, False):
        for verify in (True, False):
            store = keyed.Store(spark, str(tmp_path / f"{classify}{verify}"))
            for again in (False, True):
                open(log, "w").close()
                _, found, stats = detect.detect(cases(spark), "intra", 12, 0.5, provider=Judge(log), store=store, classify=classify, verify=verify)
                rows = found.collect()
                reported[classify, verify, again] = {r.a_id // 10 for r in rows}
                asked = {}
                for line in open(log):
                    kind, n = line.split()
                    asked[kind] = asked.get(kind, 0) + int(n)
                # answers that aren't returned, or are no answers, aren't cached
                want = {"classify": 1 if again else 6} if classify else {}
                want |= {"verify": 1 if again else 4 if classify else 6} if verify else {}
                assert asked == want
                assert all(r.verifier_passed is (True if verify else None) and r.detector == ("arithmetic+llm" if verify else "arithmetic") for r in rows)
                s = stats.first()
                if classify or verify:
                    assert s.reported == len(rows) and s.rejected_different_subject == (2 if classify else 0)
    assert reported[True, True, False] == reported[True, True, True] == {0}
    assert reported[True, False, False] == {0, 2, 3, 4} and reported[False, True, False] == {0, 1, 5} and reported[False, False, False] == set(range(6))
    events = keyed.Store(spark, str(tmp_path / "TrueTrue")).read("meter_events", schemas.schema("meter_events"))
    assert events.filter("kind = 'llm.generate'").agg(F.sum("items")).first()[0] == 6 + 4 + 1 + 1


def test_calls_are_retried_paced_and_metered(spark, tmp_path):
    class Flaky(extract.RuleProvider):
        status_of = staticmethod(lambda e: 503)
        wait_ms = staticmethod(lambda e: 1)
        min_interval_ms = 5

        def __init__(self, path):
            super().__init__()
            self.path = path

        def extract(self, sections):
            import os

            if not os.path.exists(self.path):
                open(self.path, "w").close()
                raise RuntimeError("busy")
            return ['{"path": "no such path", "claims": []}', *super().extract(sections)]

    rows = spark.createDataFrame([("h1", "T", "BLEU of 3.5 for Model 1."), ("h2", "U", "nothing")], "content_hash string, title string, body string").coalesce(1)
    out = extract.call_extraction(rows, Flaky(str(tmp_path / "once")))
    out.write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.content_hash: r.claims.count("quote") for r in out.collect()} == {"h1": 1, "h2": 0}
    events = calls.events(out).orderBy("ok").collect()
    assert [(e.ok, e["items"], e.kind, e.label) for e in events] == [(False, 2, "llm.generate", "rules"), (True, 2, "llm.generate", "rules")]


def test_answers_are_checked():
    kind = T.StructType.fromDDL("a string, b boolean, c array<struct<d:double>>")
    assert calls.structured('{"a": "x", "b": true, "c": [{"d": 1}], "e": 2}', kind) == {"a": "x", "b": True, "c": [{"d": 1}]}
    assert calls.structured({"a": 1}, kind) == {"a": 1, "b": None, "c": None}
    for wrong in ("{", "[]", None, {"b": "true"}, {"c": [{"d": "1"}]}, {"c": {}}):
        assert calls.structured(wrong, kind) is None


def test_an_evaluation_is_saved(spark, tmp_path):
    texts = [(i, f"Start. BLEU of {30 + i}.5 for Model {i} on test. ", f"Results: BLEU of {30 + i}.5 for Model {i} on test.") for i in range(3)]
    docs = spark.createDataFrame([(i, a + b) for i, a, b in texts], "doc_id long, text string")
    sections = spark.createDataFrame([x for i, a, b in texts for x in ((i, "A", "A", 1, 0, 0, len(a)), (i, "B", "B", 1, 1, len(a), len(a + b)))], "doc_id long, path string, title string, level int, ordinal int, char_start int, char_end int")
    store = keyed.Store(spark, str(tmp_path / "store"))
    out = evaluate.evaluate(docs, sections, extract.RuleProvider(), per_paper=1, t=0.3, classify=True, verify=True, store=store)
    rows = {name: store.read(name, schemas.schema(name)).collect() for name in ("eval_runs", "injections", "documents", "sections")}
    assert [(r.id, r.classifier_enabled, r.verifier_enabled) for r in rows["eval_runs"]] == [(out["run_id"], True, True)] and rows["eval_runs"][0].finished_at
    assert json.loads(rows["eval_runs"][0].metrics)["injected"] == {"total": 3, "detected": 3, "recall": 1.0}
    assert {r.run_id for r in rows["injections"]} == {out["run_id"]} and all(r.detected for r in rows["injections"])
    assert {r.document_id for r in rows["injections"]} == {r.id for r in rows["documents"]} == {r.document_id for r in rows["sections"]}
    mutated = {r.source_arxiv_id: r for r in rows["injections"]}
    a, b = texts[1][1:]
    changed = (a + b)[: mutated["1"].char_start] + mutated["1"].mutated_text + (a + b)[mutated["1"].char_end :]
    hashes = {r.content_hash for r in rows["sections"] if r.document_id == mutated["1"].document_id}
    assert hashes == {hashlib.sha256(x.encode()).hexdigest() for x in (changed[: len(a)], changed[len(a) :])}


def test_embeddings_are_cached_by_content(spark):
    rows = spark.createDataFrame([(1, "s", "a b"), (2, "s", "a b"), (3, "s", "c")], "id int, subject string, text string")
    empty = spark.createDataFrame([], "content_hash string, model string, dims int, embedding array<float>")
    embedded, fresh = extract.embed(rows, empty, extract.RuleProvider(8))
    assert embedded.count() == 3 and fresh.count() == 2
    assert extract.embed(rows, fresh, extract.RuleProvider(8))[1].count() == 0
    assert extract.embed(rows, fresh, extract.RuleProvider(4))[1].count() == 2
    assert tuple(keyed.backfill_stats(embedded, fresh.limit(1)).first()) == (3, 2, 1)


def test_a_cache_is_filled_from_claims(spark):
    rows = spark.createDataFrame([("s", "a", [1.0]), ("s", "a", [1.0]), ("s", "b", [2.0]), ("s", "c", None)], "subject string, text string, embedding array<float>")
    first = keyed.backfill(rows, spark.createDataFrame([], schemas.schema("embedding_cache")), "m")
    assert first.count() == 2 and keyed.backfill(rows, first, "m").count() == 0 and keyed.backfill(rows, first, "n").count() == 2


def test_a_store_has_a_whole_table_at_every_moment(spark, tmp_path):
    store = keyed.Store(spark, str(tmp_path / "s"))
    store.swap("t", spark.range(3))
    reading = store.read("t", "id long")
    store.swap("t", store.read("t", "id long").union(spark.range(3, 5)))
    assert reading.count() == 3 and store.read("t", "id long").count() == 5
    store.append("t", spark.range(2))
    store.append("new", spark.range(2))
    assert store.read("t", "id long").count() == 7 and store.read("new", "id long").count() == 2 and not store.exists("none")
    store.swap("t", spark.range(1))
    assert len([p for p in (tmp_path / "s" / "t").iterdir() if p.is_dir()]) == 2
    store.migrate()
    store._put(f"{store.root}/version", "99")
    with pytest.raises(ValueError, match="version 99"):
        keyed.Store(spark, str(tmp_path / "s"))


def test_passages_of_any_length_and_place(spark):
    docs = [(1, "we saw the red cat today and left again"), (2, "bathe red cat sat on a mat"), (3, "no"), (4, None), (5, "x the red cat sat on a mat."), (6, "“the  red cat”")]
    items = [(1, "the red cat"), (2, "the red cat sat on a mat"), (3, "e red cat sat on a ma"), (4, "no"), (5, None), (6, "cat sat on  a mat"), (7, "o"), (8, "saw the red cat today and")]
    at = lambda: sorted((r.d, r.i, r.start, r.end) for r in passages.locate_all(spark.createDataFrame(docs, "d int, t string"), spark.createDataFrame(items, "i int, q string"), "d", "t", "i", "q").collect())
    want = sorted((d, i, t.index(q), t.index(q) + len(q)) for d, t in docs if t for i, q in items if q and q in t)
    assert at() == want
    passages.SENT, kept = 1, passages.SENT
    try:
        assert at() == want
    finally:
        passages.SENT = kept


def test_keyed_tables(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    old, new = make([(1, "a"), (2, "b")]), make([(2, "x"), (3, "z"), (3, "y")])
    assert rows(keyed.insert_ignore(old, new, ["k"])) == [(3, "y")]
    assert rows(keyed.upsert(old, new.filter("v <> 'z'"), ["k"])) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(keyed.replace_where(old, new, ["k"])) == [(1, "a"), (2, "x"), (3, "y"), (3, "z")]
    assert rows(keyed.changed(old, make([(1, "a"), (2, "c"), (4, "d")]), ["k"], ["v"])) == [(2, "c"), (4, "d")]
    assert rows(keyed.misses(new, old, ["k"]).select("k", F.lit("").alias("v"))) == [(3, "")]
    store = keyed.Store(spark, str(tmp_path))
    assert store.read("t", old.schema).count() == 0
    store.swap("t", old)
    store.swap("t", keyed.upsert(store.read("t", old.schema), make([(1, "q")]), ["k"]))
    store.append("t", make([(9, "n")]))
    assert rows(store.read("t", old.schema)) == [(1, "q"), (2, "b"), (9, "n")]
    findings, pairs = spark.createDataFrame([("f", "p1"), ("g", "p2")], "id string, pair_id string"), spark.createDataFrame([("p1", "c1", "intra"), ("p2", "c1", "cross")], "id string, claim_a_id string, scope string")
    left = keyed.delete_intra(findings, pairs, spark.createDataFrame([("c1", "d")], "id string, document_id string"), "d")
    assert [[r.id for r in x.collect()] for x in left] == [["g"], ["p2"]]


def test_table_checks(spark):
    bad = spark.createDataFrame([("d", 1, 5, 5), ("d", 1, 0, 3)], "document_id string, ordinal int, char_start int, char_end int")
    assert {r.rule: r.n for r in schemas.violations("sections", bad).collect()} == {"0 <= char_start < char_end": 1, "unique document_id, ordinal": 1}
    assert schemas.violations("injections", bad).count() == 0 and all(schemas.schema(t).names for t in schemas.TABLES)


# --- mutations ---------------------------------------------------------------------------------


def paper(spark):
    head = "We get 3.5 days and 0.9 BLEU. "
    body = "It took 3.5 days; 0.9 of all. Later 3.5 days, 7.25 points. "
    tail = "Again 7.25 points."
    docs = spark.createDataFrame([(1, head + body + tail)], "doc_id long, text string")
    edges = [0, len(head), len(head + body), len(head + body + tail)]
    sections = spark.createDataFrame([(1, f"s{i}", f"s{i}", 1, i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "doc_id long, path string, title string, level int, ordinal int, char_start int, char_end int")
    return docs, sections


def test_mutations_need_the_same_word_in_two_sections(spark):
    docs, sections = paper(spark)
    found = mutate.sites(docs, sections)
    plan = {r.original_text: r for r in mutate.plan(found).collect()}
    assert set(plan) == {"3.5", "7.25"}
    assert (plan["3.5"].section_path, plan["3.5"].counterpart_section_path, plan["3.5"].signature, plan["3.5"].mutated_text) == ("s0", "s1", "days", "3.9")
    text = docs.first().text
    for row in mutate.apply(docs, mutate.plan(found)).collect():
        assert len(row.text) == len(text) and row.text[row.char_start : row.char_end] == row.mutated_text
        assert row.text[: row.char_start] + row.original_text + row.text[row.char_end :] == text
    with pytest.raises(Exception, match="mutation site moved"):
        mutate.apply(docs, mutate.plan(found).withColumn("char_start", F.col("char_start") + 1)).collect()
    one = mutate.sample(mutate.plan(found), mutate.plan_order(found), 1, 42).collect()
    assert len(one) == 1 and one == mutate.sample(mutate.plan(found.repartition(3)), mutate.plan_order(found), 1, 42).collect()


def test_overlap_is_half_open(spark):
    rows = [(0, 5, False), (0, 6, True), (9, 12, True), (10, 12, False), (6, 7, True), (None, 7, False), (6, None, False)]
    got = [r.x for r in spark.createDataFrame(rows, "s int, e int, w boolean").select(mutate.overlaps(F.col("s"), F.col("e"), F.lit(5), F.lit(10)).alias("x")).collect()]
    assert got == [w for *_, w in rows]


def test_injected_contradictions_are_found_and_clean_ones_are_not(spark):
    texts = [(i, f"Start. BLEU of {30 + i}.5 for Model {i} on test. ", f"Results: BLEU of {30 + i}.5 for Model {i} on test.") for i in range(5)]
    docs = spark.createDataFrame([(i, a + b) for i, a, b in texts], "doc_id long, text string")
    sections = spark.createDataFrame([x for i, a, b in texts for x in ((i, "A", "A", 1, 0, 0, len(a)), (i, "B", "B", 1, 1, len(a), len(a + b)))], "doc_id long, path string, title string, level int, ordinal int, char_start int, char_end int")
    out = evaluate.evaluate(docs, sections, extract.RuleProvider(), per_paper=1, t=0.3)
    assert out["metrics"] == {"control": {"papers": 5, "findings": 0, "false_positives_per_paper": 0.0}, "injected": {"total": 5, "detected": 5, "recall": 1.0}, "by_type": [{"mutation_type": "NUMERIC", "total": 5, "detected": 5, "recall": 1.0}]}
    empty = evaluate.recall(out["injections"].limit(0)).first()
    assert (empty.total, empty.recall) == (0, None)


# --- metering ----------------------------------------------------------------------------------


def test_meter(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(at(0), "llm.embed", "m", 1.5, True, 3, None, 10, None), (at(60), "llm.embed", "m", 2.5, False, None, 4, 20, 7), (at(121), "llm.generate", "m", 1.0, True, 1, 1, None, None)]
    events = spark.createDataFrame(rows, schemas.schema("meter_events"))
    assert tuple(meter.totals(events).first()) == (3, 30, 4, 5, 7, 5.0, 1)
    assert tuple(meter.totals(events.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0, 0)
    assert {r.kind: r.calls for r in meter.totals_by_kind(events).collect()} == {None: 3, "llm.embed": 2, "llm.generate": 1}
    assert [r.items_in_window for r in meter.rolling_items(events, "label").orderBy("at").collect()] == [10, 30, None]
    assert [(r.gap_ms, r.too_soon) for r in meter.gaps(events, "label", 60_500).orderBy("at").collect()] == [(None, False), (60_000.0, True), (61_000.0, False)]


def test_pacing():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(round(s, 3))
        now[0] += s

    limiter = meter.RateLimiter(3000, lambda: now[0], sleep)
    assert [limiter(lambda: now[0]) for _ in range(3)] == [0, 3, 6]
    limiter.back_off(10_000)
    assert limiter(lambda: now[0]) == 16
    items = meter.ItemRateLimiter(100, 60_000, lambda: now[0], sleep)
    starts = [items(n, lambda: now[0]) for n in (60, 40, 1, 500)]
    assert starts[0] == starts[1] and starts[2] - starts[0] > 60 and starts[3] > starts[2] + 60
    tries = []
    with pytest.raises(RuntimeError):
        meter.with_retry(lambda: (_ for _ in ()).throw(RuntimeError()), lambda e: 503, sleep=lambda s: tries.append(s))
    assert len(tries) == meter.MAX_TRIES - 1 and 1 <= tries[0] <= 2 and tries[-1] <= 32
    with pytest.raises(RuntimeError):
        meter.with_retry(lambda: (_ for _ in ()).throw(RuntimeError()), lambda e: 400, sleep=lambda s: pytest.fail("no retry"))


# --- sources -----------------------------------------------------------------------------------


def test_ids_and_metadata(spark):
    cases = {"2301.12345": ("2301.12345", None), " https://arxiv.org/abs/2301.12345v2 ": ("2301.12345", 2), "arXiv:math/0309136": ("math/0309136", None), "math.GT/0309136v1.pdf": ("math.GT/0309136", 1), "2301.1": None, "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "k string").withColumn("x", ids.parse_arxiv_id(F.col("k")))
    assert {r.k: r.x and tuple(r.x) for r in rows.collect()} == cases
    atom = "<feed><title>f</title><entry><id>http://arxiv.org/abs/2301.12345v4</id><title>A &lt;b&gt;\n  &amp;amp; c</title><published> p </published></entry><entry><title>2</title></entry></feed>"
    feeds = [atom, "<feed/>", "<entry><title>Error</title><summary> bad </summary></entry>", "<entry><id>x</id><title>t</title></entry>", "<entry><id>av2</id></entry>"]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(feeds)], "i int, f string").select("i", ids.metadata(F.col("f"), F.lit("x"), F.lit(None).cast("int")).alias("m")).orderBy("i").collect()
    assert rows[0].m.version == 4 and rows[0].m.title == "A <b> &amp; c" and rows[0].m.published == "p" and rows[0].m.error is None
    assert [r.m.error for r in rows[1:]] == ["no entry", "error: bad", "no version", "no title"]


def test_a_feed_is_read_once_per_field(spark):
    """The parts of a feed are bound, so that its plan names each pattern a few times only, not once per use of the entry."""
    rows = spark.createDataFrame([("<feed/>",)], "f string").select(ids.metadata(F.col("f"), F.lit("x"), F.lit(None).cast("int")).alias("m"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.first().m.error == "no entry" and plan.count("<entry>") <= 2 and plan.count("<title[^>]*>") <= 2



def test_bundles(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for name, data in (("d/main.TEX", b"a"), ("fig.png", b"b"), ("x.bbl", b"c")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    packed = [gzip.compress(tar.getvalue()), tar.getvalue(), b"plain", gzip.compress(b"zip"), b"%PDF-1", gzip.compress(b"%PDF-1"), b"\x1f\x8bbroken", None]
    rows = bundles.unpack_bundles(spark.createDataFrame([(i, bytearray(p) if p is not None else None) for i, p in enumerate(packed)], "i int, content binary")).orderBy("i").collect()
    assert [r.files for r in rows] == [{"d/main.TEX": "a", "x.bbl": "c"}] * 2 + [{"main.tex": "plain"}, {"main.tex": "zip"}, {}, {}, {}, {"main.tex": ""}]
    assert [r.pdf_only for r in rows] == [False] * 4 + [True, True, False, False] and rows[6].error


def test_latex():
    tex = r"""\documentclass{article}\title{T}\begin{document}
\begin{abstract}We reach $10^{18}$ FLOPs at 5\% cost\footnote{no}.\end{abstract}
\section{Method \emph{A}}\label{x}Text~one \cite[p.~3]{k} with $\alpha_{12} \times x_i$ and \textbf{bold}.

New par. % comment \section{no}
\subsection*{Notes}Starred.
\subsection{Data}\begin{tabular}{l|c}a & 1 \\ \hline b & 2\end{tabular}
\resizebox{\textwidth}{!}{\begin{tabular}{ll}kept & 3\end{tabular}}
\begin{figure}[h]\includegraphics[width=1cm]{f.png}\caption[short]{A \emph{plot} of 3.5}\end{figure}
\begin{verbatim}\section{hidden}\end{verbatim}
\begin{center}\section{Nested}inside\end{center}
\appendix\section{Extra}More \unknown{words} \multicolumn{2}{c}{cell}.
\end{document}"""
    text, sections = latex.parse(tex)
    assert [s["path"] for s in sections] == ["Abstract", "1 Method A", "Notes", "1.1 Data", "2 Nested", "A Extra"]
    assert [s["level"] for s in sections] == [1, 1, 2, 2, 1, 1] and [s["ordinal"] for s in sections] == list(range(6))
    assert all(a["char_end"] == b["char_start"] for a, b in zip(sections, sections[1:])) and sections[-1]["char_end"] == len(text)
    for s in sections[1:]:
        assert text[s["char_start"] : s["char_end"]].lstrip("\n").startswith(s["title"])
    for part in ("10^{18} FLOPs at 5% cost.", "α_{12} × x_i and bold.", "a | 1", "b | 2", "kept | 3", "A plot of 3.5", "More words cell."):
        assert part in text
    for part in ("comment", "hidden", "f.png", "short", "footnote", "no."):
        assert part not in text
    assert latex.parse("") == ("", []) and latex.parse(r"\section{")[1] is not None


def test_includes_and_macros():
    files = {"d/main.tex": r"\documentclass{a}\begin{document}\input{one} \include{./two}\input{gone}%\input{one}" + "\n" + r"\end{document}", "d/one.tex": r"ONE \input{d/three}", "two.TEX": "TWO", "d/three.tex": "THREE", "loop.tex": r"L\input{loop}"}
    assert latex.Files(files).main() == "d/main.tex" and latex.Files({"a.tex": "x"}).main() is None
    assert latex.parse(files["d/main.tex"], files)[0].split() == ["ONE", "THREE", "TWO"]
    assert latex.parse(files["loop.tex"], files)[0].split() == ["L"] * (latex.MAX_INCLUDES + 1)
    tex = r"\newcommand{\gpt}{GPT}\newcommand*{\huge}{\gpt-4 {x}}\def\n{``}\newcommand{\arg}[1]{#1}\def\two#1{#1}\gpt{} \gptx \huge, \n \arg{y}"
    assert latex.parse(tex)[0] == "GPT GPT-4 x, `` y"
    preamble = {"main.tex": r"\documentclass{a}\input{defs}\begin{document}\section{\model{} results}\textbf{\appendix}\section{B}x\end{document}", "defs.tex": r"\newcommand{\model}{Net-\size}\newcommand{\size}{7B}\renewcommand{\loop}{\loop\loop}"}
    assert [s["path"] for s in latex.parse(preamble["main.tex"], preamble)[1]] == ["1 Net-7B results", "A B"]
    two = {"a.tex": r"\begin{document}\input{part}\end{document}", "old/a.tex": r"\documentclass{x}\begin{document}old\end{document}", "top.tex": r"\documentclass{x}\begin{document}\input{a}\end{document}", "part.tex": "P"}
    assert latex.Files(two).main() == "top.tex"


def test_a_paper_that_cannot_be_read_is_a_row_with_an_error(spark):
    deep = r"\begin{document}" + r"\begin{center}" * 20_000 + "x" + r"\end{document}"
    rows = [(1, {"main.tex": deep}), (2, {"main.tex": r"\begin{document}\section{S}fine\end{document}"}), (3, {}), (4, None)]
    out = {r.i: r for r in latex.parse_bundles(spark.createDataFrame(rows, "i int, files map<string,string>")).collect()}
    assert "Recursion" in out[1].error and out[2].error is None and out[2].sections[0].path == "1 S"
    assert out[3].error == out[4].error == "no file with a document body"


def test_section_offsets_against_collapsed_prefixes():
    """By the definition: a section begins where the collapsed text before it ends."""
    rng = random.Random(1)
    for _ in range(60):
        parts = [" ".join(rng.choice(["w", "\n", "  ", "\t", r"\%", "é", "%c\n", r"\alpha"]) for _ in range(rng.randint(0, 12))) for _ in range(5)]
        tex = parts[0] + "".join(f"\\section{{T{i}}}{p}" for i, p in enumerate(parts[1:]))
        text, sections = latex.parse(tex)
        for i, s in enumerate(sections):
            assert s["char_start"] == len(latex.parse(parts[0] + "".join(f"\\section{{T{k}}}{p}" for k, p in enumerate(parts[1 : i + 1])))[0])


def test_a_bundle_that_grows_without_end_is_an_error(monkeypatch):
    monkeypatch.setattr(bundles, "MAX_BYTES", 1000)
    assert "1000 bytes" in bundles.unpack(gzip.compress(b"x" * 1001))[2] and bundles.unpack(gzip.compress(b"x" * 999))[2] is None


# --- reports, settings, streams ----------------------------------------------------------------


def test_reports(spark):
    run = {"id": "abcdefghij", "started_at": dt.datetime(2024, 5, 6), "model": "rules", "classify": True, "verify": False, "by_type": [{"mutation_type": "NUMERIC", "total": 4, "detected": 1, "recall": 0.25}, {"mutation_type": "SCOPE", "total": 0, "detected": 0, "recall": None}]}
    run["metrics"] = {"injected": {"total": 4, "detected": 1, "recall": 0.25}, "control": {"papers": 0, "findings": 0, "false_positives_per_paper": None}}
    table = report.results_table(run)
    assert "| **Recall** | **25.0%** |" in table and table.count("not measured") == 2 and "run `abcdefgh`" in table
    page = f"head {report.START} old {report.END} tail"
    assert report.splice(page, "new") == f"head {report.START}\n\nnew\n\n{report.END} tail"
    with pytest.raises(ValueError):
        report.splice("no markers", "x")
    assert report.findings_text([]) == "No contradictions found." and '"a": 1' in report.as_json(spark.createDataFrame([(1,)], "a int"))


def test_settings():
    assert config.load({}).top_k == 12 and config.load({"FACTWEAVE_TOP_K": "3"}).top_k == 3
    for env in ({"FACTWEAVE_TOP_K": "x"}, {"FACTWEAVE_TOP_K": "0"}, {"FACTWEAVE_MIN_FETCH_INTERVAL_MS": "10"}):
        with pytest.raises(ValueError):
            config.load(env)


def test_streams(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    for part in (["a", "b", "a"], ["b", None, "c"]):
        spark.createDataFrame([(t,) for t in part], "text string").coalesce(1).write.mode("append").parquet(path)
    assert ingest.stream_once(spark, path).count() == 4
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, s), "k", 1) for s in (0, 5, 30)], "at timestamp, kind string, items int")
    windows = ingest.rate_windows(events, window="10 seconds", slide="10 seconds").select("window.start", "items").orderBy("start").collect()
    assert [r["items"] for r in windows] == [2, 1]
