import hashlib
import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.functions import measure, numbers, text, vectors

Q = measure.QUANTITY


def q(value=1.0, unit=None, metric="BLEU", system="ours", dataset=None):
    return {"value": float(value), "unit": unit, "subject": metric, "metric": metric, "dataset": dataset, "system": system}


def judge(spark, function, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, a {Q}, b {Q}")
    return [r.x for r in rows.select("i", function(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]


NAN, INF = float("nan"), float("inf")
COMPARISONS = [
    (41.8, "BLEU", 41, "BLEU", True), (91.4, "%", 96.1, "%", True), (41.8, "BLEU", 41.8, "BLEU", False), (41.8, "BLEU", 41.82, "BLEU", False), (100, "params", 101, "params", False),
    (0.001, "loss", 0.0011, "loss", False), (41.8, "BLEU", 41, "%", False), (41.8, None, 41, None, True), (91.4, "%", 96.1, "percent", True), (41.8, "BLEU score", 41, "bleu", True),
    (NAN, "BLEU", 41, "BLEU", False), (INF, "BLEU", 41, "BLEU", False), (0.0, None, 0.0, None, False), (-0.0, None, 5.0, None, True), (41.8, "", 41, "BLEU", True),
]


def test_compare(spark):
    found = judge(spark, measure.compare, [(q(a, ua), q(b, ub)) for a, ua, b, ub, _ in COMPARISONS])
    assert [x is not None for x in found] == [c[-1] for c in COMPARISONS]
    assert found[0].difference == pytest.approx(0.8) and found[0].tolerance == pytest.approx(0.55) and found[0].relative_difference == pytest.approx(0.8 / 41.8)


def test_units(spark):
    units = ["  BLEU  ", "%", None, "", "Parameters", "petaflop/s-days", "K", "widget"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(units)], "i int, u string").select("i", measure.normalise_unit(F.col("u")).alias("x")).orderBy("i")
    assert [r.x for r in rows.collect()] == ["bleu", "percent", None, None, "params", "pf-days", "thousand", "widget"]


SAME = [
    (q(metric="BLEU", system="Transformer (big)", dataset="WMT14 EN-FR test"), q(metric="bleu", system="Transformer big model", dataset="English-to-French, WMT 2014 test"), True),
    (q(system="Transformer (base)", dataset="WMT14 EN-DE test"), q(system="Transformer (big)", dataset="WMT14 EN-DE test"), False),
    (q(system="Transformer (big)", dataset="WMT14 EN-DE test"), q(system="Transformer (big)", dataset="WMT14 EN-FR test"), False),
    (q(system="Transformer (base)", dataset="newstest2013 dev"), q(system="Transformer (base)", dataset="newstest2014 test"), False),
    (q(system=None, dataset="WMT14"), q(system=None, dataset="WMT14"), False),
    (q(metric=None), q(metric=None), False),
    (q(dataset="WMT14 EN-FR test"), q(dataset=None), False),
    (q(metric="d_model", system="Transformer (big)"), q(metric="d_model", system="Transformer (big)"), True),
    (q(dataset=""), q(dataset=None), True),
    (q(dataset="???"), q(dataset="WMT14"), True),
    (q(metric="%"), q(metric="±"), True),
]


def test_same_measurement(spark):
    assert judge(spark, measure.same_measurement, [s[:2] for s in SAME]) == [s[2] for s in SAME]
    assert judge(spark, measure.same_measurement, [(b, a) for a, b, _ in SAME]) == [s[2] for s in SAME]


def test_numeric_conflict(spark):
    big, base = {"system": "Transformer (big)", "dataset": "WMT14 EN-FR test"}, {"system": "Transformer (base)", "dataset": "WMT14 EN-FR test"}
    pairs = [
        (q(41.8, **big), q(41.0, **big)), (q(41.8, **big), q(38.1, **base)),
        (q(25.8, system="Transformer (base)", dataset="newstest2013 dev"), q(27.3, system="Transformer (base)", dataset="WMT14 EN-DE test")),
    ]
    found = judge(spark, measure.numeric_conflict, pairs)
    assert [x is not None for x in found] == [True, False, False]
    assert spark.range(1).select(measure.confidence(F.lit(found[0].relative_difference))).first()[0] == pytest.approx(0.5478, abs=1e-4)


def written(v: float) -> float:
    """Half an ulp of the shortest decimal form, with exponents from 1e21 and below 1e-6."""
    if v and (abs(v) >= 1e21 or abs(v) < 1e-6):
        return abs(v) * 1e-6
    form = f"{v:.400f}".rstrip("0") if "e" in repr(v) else repr(v)
    short = next(s for s in (f"{v:.{d}f}" for d in range(400)) if float(s) == v) if "e" in repr(v) else form
    fraction = short.partition(".")[2].rstrip("0")
    return 0.5 * 10.0 ** -len(fraction)


def test_half_ulp(spark):
    rng = random.Random(1)
    values = [41.0, 1e7, 1e-4, 1e-6, 9.9e-7, 1e20, 1e21, 3.3e18, -41.8, 0.0, 0.1, 100.25, 1.5e-5, 123456789.125] + [round(rng.uniform(-1e4, 1e4), rng.randint(0, 6)) for _ in range(500)]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").select("i", measure.half_ulp(F.col("v")).alias("x")).orderBy("i")
    assert [r.x for r in rows.collect()] == pytest.approx([written(float(v)) for v in values], rel=1e-12)


def test_canonical(spark):
    labels = {"English-to-German": "ende", "EN-DE, WMT 2014!": "ende wmt14", "éen-de": "ende", "token-dev": "token dev", "Validation set": "dev set", "newstest 13": "newstest2013", "Base  Model": "base", "big modelling": "big modelling", "sixteen-denver": "sixteen denver", "±": ""}
    rows = spark.createDataFrame([(k,) for k in labels], "k string").select("k", measure.canonical(F.col("k")).alias("x"))
    assert {r.k: r.x for r in rows.collect()} == labels


def test_whitespace_and_spans(spark):
    cases = {"a\r\nb\rc": "a\nb\nc", "  x \t y  \n\n\n\n z ": "x y\n\nz", "": "", "\n \n": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "k string").select("k", text.collapse_whitespace(F.col("k")).alias("x"))
    assert {r.k: r.x for r in rows.collect()} == cases
    assert spark.range(1).select(text.strip_comments(F.lit("a%b\n50\\% c%d\n%e"))).first()[0] == "a\n50\\% c\n"
    row = spark.range(1).select(text.pair_hash(F.lit("s"), F.lit("a"), F.lit("t"), F.lit("b")).alias("x"), text.pair_hash(F.lit("t"), F.lit("b"), F.lit("s"), F.lit("a")).alias("y"), text.ordered_pair_hash(F.lit("a"), F.lit("b")).alias("z")).first()
    assert row.x == row.y and row.z == hashlib.sha256(b"a\0b").hexdigest()


def test_locate(spark):
    source = "😀 The score is 41.8 (best).\nThe  score\tis 41.8 again; a+b \\E c"
    cases = {"score is 41.8": 6, "The score is 41.8 again": 29, "no such": None, "": None, "  ": None, "a+b \\E": 57, "41.8 (best)": 15, "(best). The": 20}
    rows = spark.createDataFrame([(k, source) for k in cases], "k string, t string").withColumn("x", text.locate(F.col("k"), F.col("t")))
    got = {r.k: r.x and (r.x.start, r.x.end) for r in rows.collect()}
    assert {k: v and " ".join(source[slice(*v)].split()) for k, v in got.items()} == {k: at and k for k, at in cases.items()}
    assert all(got[k] is None or source[: got[k][0]].count(k) == 0 for k in cases)


def test_decimal_sites(spark):
    source = "We get 3.5 days of 0.9, x1.25 and 1.2.3; then 41.80% BLEU. The rate 0.123"
    rows = spark.createDataFrame([(source,), (None,)], "t string").select(text.decimal_sites(F.col("t")).alias("s")).collect()
    assert [(s.literal, s.signature) for s in rows[0].s] == [("3.5", "days"), ("0.9", "days"), ("41.80", "bleu"), ("0.123", "rate")]
    assert all(source[s.start : s.end] == s.literal for s in rows[0].s) and rows[1].s == []


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.l2_normalise(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0].n == pytest.approx([0.6, 0.8]) and rows[0].c == pytest.approx(0.96) and rows[1].n == [0, 0] and rows[1].c is None


def test_number_formats():
    assert [numbers.fixed(x, d) for x, d in ((1.005, 2), (2.5, 0), (0.125, 2), (10.0, 1))] == ["1.00", "3", "0.13", "10.0"]
    assert [numbers.precise(x, 3) for x in (0.8, 1234.5, 0.000001234, 0.0000001, 99.96, 0)] == ["0.800", "1.23e+3", "0.00000123", "1.00e-7", "100", "0.00"]


@settings(max_examples=300, deadline=None)
@given(st.from_regex(r"\A[0-9]{1,4}\.[0-9]{1,3}\Z"))
def test_perturbed_decimals_differ_and_keep_their_width(literal):
    other = numbers.perturbed(literal)
    assert len(other) == len(literal) and other != literal
    assert math.isclose(float(other), float(literal), rel_tol=0.02) is False


def test_sampling_is_seeded():
    assert numbers.sample_order(6, 0) == numbers.sample_order(6, 1) != numbers.sample_order(6, 42)
    assert sorted(numbers.sample_order(50, 7)) == list(range(50)) and numbers.sample_order(0, 5) == []
    first = numbers.draws(42)
    state = 42
    for _ in range(5):
        state ^= (state << 13) & 0xFFFFFFFF
        state ^= state >> 17
        state = (state ^ (state << 5)) & 0xFFFFFFFF
        assert next(first) == abs(state - (1 << 32) if state >> 31 else state) / 2**31
    assert json.dumps(numbers.sample_order(4, 42))


def test_l2_normalise_measures_a_vector_once(spark):
    """The length belongs to the row: inside the lambda it would be summed again for every figure."""
    lengths = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    out = rows.select(vectors.l2_normalise(F.col("v")).alias("v"))
    assert lengths(out) == 1 and [r.v for r in out.collect()] == [[0.6, 0.8], [0.0, 0.0]]
