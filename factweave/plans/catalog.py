"""The engine's queries over the driver's tables, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measure, text
from ..functions.vectors import l2_normalise, norm
from ..operators import detect, evaluate, extract, meter, mutate, neighbours, passages, refine
from ..sources import ids, keyed, latex
from ..sources.shared import written
from ..streaming import ingest
from . import tables as t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- measurements ------------------------------------------------------------------------------

_ULP = "0.5 * CASE WHEN {v} = round({v}, 0) THEN 1.0::DOUBLE WHEN {v} = round({v}, 1) THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END"


def _conflict_sql(a: str, b: str) -> str:
    """Relative difference of two values that disagree, else null, for values of at most two decimals."""
    difference, magnitude = f"abs({a} - {b})", f"greatest(abs({a}), abs({b}))"
    return f"CASE WHEN {magnitude} > 0 AND {difference} > {_ULP.format(v=a)} + {_ULP.format(v=b)} AND {difference} / {magnitude} >= 0.005 THEN {difference} / {magnitude} END"


#: Lines that a task sorts at a time.
LINES = 500_000


@query(
    f"""
WITH p AS (
  SELECT a.l_orderkey * 10 + a.l_linenumber AS a_line, b.l_orderkey * 10 + b.l_linenumber AS b_line,
         [{_conflict_sql("a.l_discount", "b.l_discount")}, {_conflict_sql("a.l_tax", "b.l_tax")},
          {_conflict_sql("a.l_quantity", "b.l_quantity")}, {_conflict_sql("a.l_extendedprice", "b.l_extendedprice")}] AS r
  FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey
   AND a.l_orderkey * 10 + a.l_linenumber < b.l_orderkey * 10 + b.l_linenumber
)
SELECT a_line, b_line, ['Discount', 'Tax rate', 'Quantity', 'Price'][list_position(r, list_max(r))] AS metric,
       round(list_max(r), 6) AS relative_difference, round(least(1.0, 0.5 + 2.5 * list_max(r)), 6) AS confidence, 4::BIGINT AS compared
FROM p WHERE list_max(r) IS NOT NULL
"""
)
def numeric_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one part and supplier whose figures disagree: the largest disagreement of each pair."""
    lines, parts = t.read(spark, sf_dir, "lineitem"), t.read(spark, sf_dir, "part")
    pairs = _line_pairs(lines, parts, max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES)))
    hits = detect.conflicts(detect.type_compatible(pairs).filter("survived_type_filter")).filter("best is not null")
    r = F.col("best.r")
    return hits.select("a_line", "b_line", F.col("best.x.metric").alias("metric"), F.round(r, 6).alias("relative_difference"), F.round(measure.confidence(r), 6).alias("confidence"), "compared")


def _line_pairs(lines: DataFrame, parts: DataFrame, dealt: int) -> DataFrame:
    """(a_line, b_line, a, b): only keys and figures are shuffled, and only lines with a partner become claims, each once."""
    key = ["l_partkey", "l_suppkey"]
    line = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), *t.LINE_FIGURES)
    bare = lines.select(*key, line.alias("l")).filter("l_partkey is not null and l_suppkey is not null and l.line is not null").select(*key, "l.*").repartition(dealt, *key)
    met = bare.withColumn("n", F.expr("count(*) over (partition by l_partkey, l_suppkey)")).filter("n > 1")
    lists = met.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("line", *t.LINE_FIGURES))).alias("ls"))
    named = lists.join(parts.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    claim = lambda x: F.struct(x["line"].alias("line"), F.lit("NUMERIC").alias("claim_type"), measure.prepared_list(t.line_quantities(x, F.col("p_name"), F.col("l_suppkey"))).alias("ready"))
    claims = named.select(F.transform("ls", claim).alias("claims"))
    first = claims.select("claims", F.posexplode("claims").alias("i", "a")).select("a", F.slice("claims", F.col("i") + 2, F.size("claims")).alias("later"))
    pairs = first.select("a", F.explode("later").alias("b")).filter("a.line < b.line")
    return pairs.select(F.col("a.line").alias("a_line"), F.col("b.line").alias("b_line"), "a", "b")


_UNITS = [" % ", "pct", "Percentage", "accuracy", "BLEU score", "bleu points", "FLOP", "petaflop/s-days", "B", "m", "K", "GPUs", "days", "Hours", "tokens", "parameters", "parameter", "widget", ""]


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query(
    f"""
WITH u AS (SELECT p_partkey, [{", ".join(map(_quote, _UNITS))}][1 + p_partkey % {len(_UNITS)}] AS unit FROM part)
SELECT p_partkey, unit, CASE WHEN unit = '' THEN NULL
  {" ".join(f"WHEN lower(trim(unit)) = {_quote(k)} THEN {_quote(v)}" for k, v in measure.UNIT_ALIASES.items())} ELSE lower(trim(unit)) END AS normal FROM u
"""
)
def unit_normalise(spark, sf_dir):
    unit = F.get(F.array(*map(F.lit, _UNITS)), (F.col("p_partkey") % len(_UNITS)).cast("int"))
    return t.read(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"), measure.normalise_unit(unit).alias("normal"))


_LABELS = ["English-to-German WMT 2014 test", "EN-DE newstest 14", "WMT14 En-Fr validation", "Base Model (dev)", "newstest2013, big  model", "en fr WMT 14 TEST", "???", "test WMT14 ende", "Development set of wmt14", ""]
_CANONICAL = "lower({})"
for _pattern, _to in measure.LABEL_REWRITES:
    _CANONICAL = f"regexp_replace({_CANONICAL}, {_quote(_pattern)}, '{_to}', 'g')"
_CANONICAL = f"trim(regexp_replace({_CANONICAL}, '[^a-z0-9]+', ' ', 'g'))"
_LABELLED = f"SELECT *, [{', '.join(map(_quote, _LABELS))}][1 + p_partkey % {len(_LABELS)}] || ' ' || p_type AS label FROM part"
_SPLIT = r"CASE WHEN regexp_matches({0}, '\bdev\b|newstest2013') THEN 'dev' WHEN regexp_matches({0}, '\btest\b|newstest2014') THEN 'test' END"
_TOKENS = "list_sort(list_distinct([x for x in string_split({}, ' ') if x <> '']))"


def _labelled(spark, sf_dir):
    tag = F.get(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % len(_LABELS)).cast("int"))
    return t.read(spark, sf_dir, "part").withColumn("label", F.concat(tag, F.lit(" "), F.col("p_type")))


@query(f"WITH l AS ({_LABELLED}), c AS (SELECT *, {_CANONICAL.format('label')} AS canonical FROM l) SELECT p_partkey, canonical, array_to_string({_TOKENS.format('canonical')}, '|') AS tokens, {_SPLIT.format('canonical')} AS split FROM c")
def label_canonical(spark, sf_dir):
    c = measure.canonical(F.col("label"))
    return _labelled(spark, sf_dir).select("p_partkey", c.alias("canonical"), F.array_join(measure.tokens(F.col("label")), "|").alias("tokens"), measure.split_of(c).alias("split"))


@query(
    f"""
WITH l AS ({_LABELLED}), c AS (SELECT *, {_CANONICAL.format("label")} AS c FROM l),
t AS (SELECT *, {_TOKENS.format("c")} AS k, {_SPLIT.format("c")} AS s FROM c)
SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, a.k = b.k AS same,
       CASE WHEN len(a.k) <= len(b.k) THEN list_has_all(b.k, a.k) ELSE list_has_all(a.k, b.k) END AS subsumed,
       coalesce(a.s = b.s, true) AND CASE WHEN len(a.k) <= len(b.k) THEN list_has_all(b.k, a.k) ELSE list_has_all(a.k, b.k) END AS comparable
FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
"""
)
def label_pairs(spark, sf_dir):
    """Labels of one brand and size: same tokens, subsumption, and sameness of the measurement they would name."""
    return _label_pairs(_labelled(spark, sf_dir).select("p_brand", "p_size", "p_partkey", "label"), 4 * spark.sparkContext.defaultParallelism)


def _label_pairs(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of equal labels are one entry with a list of keys: two labels are compared once, then their keys are paired.

    The number of parts is given, as the labels are few bytes that would end up in one task while their pairs are many.
    """
    dealt = rows.filter("p_partkey is not null").repartition(parts, "p_brand", "p_size")
    entries = dealt.groupBy("p_brand", "p_size", "label").agg(F.collect_list("p_partkey").alias("keys"))
    q = measure.prepared(t.quantity(F.lit(1.0), F.lit("BLEU"), F.lit("m"), F.col("label")))
    ready = entries.select("p_brand", "p_size", "keys", F.struct(F.col("label").isNull(), F.coalesce("label", F.lit(""))).alias("place"), measure.tokens(F.col("label")).alias("tokens"), q.dropFields("quantity").alias("q"))
    side = lambda s: ready.select("p_brand", "p_size", *(F.col(c).alias(f"{s}_{c}") for c in ("keys", "place", "tokens", "q")))
    pairs = side("a").join(side("b"), ["p_brand", "p_size"]).filter("a_place <= b_place")
    # none of the three depends on the order of the two labels
    x, y = F.col("a_tokens"), F.col("b_tokens")
    judged = pairs.select("a_keys", "b_keys", (F.col("a_place") == F.col("b_place")).alias("own"), (x == y).alias("same"), measure.one_in_other(x, y).alias("subsumed"), measure.same_prepared(F.col("a_q"), F.col("b_q")).alias("comparable"))
    paired = judged.withColumn("x", F.explode("a_keys")).drop("a_keys").withColumn("y", F.explode("b_keys")).filter("if(own, x < y, x <> y)")
    return paired.select(F.least("x", "y").alias("a_key"), F.greatest("x", "y").alias("b_key"), "same", "subsumed", "comparable")


@query("SELECT l_orderkey, l_linenumber, " + _ULP.format(v="l_extendedprice") + " AS half_ulp, " + _ULP.format(v="l_discount") + " AS half_ulp_discount FROM lineitem")
def half_ulp(spark, sf_dir):
    return t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", measure.half_ulp(F.col("l_extendedprice")).alias("half_ulp"), measure.half_ulp(F.col("l_discount")).alias("half_ulp_discount"))


# --- vectors -----------------------------------------------------------------------------------


def _knn_sql(scope: str, k: int, least: float) -> str:
    same = "a.label = b.label" if scope == "intra" else "a.label <> b.label"
    return f"""
WITH n AS (
  SELECT a.vec_id AS a_id, b.vec_id AS b_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
  FROM embeddings a JOIN embeddings b ON {same} AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY round(sim, 9) DESC, b_id) AS rank FROM n)
SELECT least(a_id, b_id) AS a_id, greatest(a_id, b_id) AS b_id, round(max(sim), 6) AS similarity
FROM r WHERE rank <= {k} AND sim >= {least} GROUP BY 1, 2"""


def _knn(spark, sf_dir, scope, k, least):
    pairs = neighbours.neighbours(t.read(spark, sf_dir, "embeddings"), scope, k, least, "vec_id", "label", "embedding")
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query(_knn_sql("intra", 12, 0.3))
def knn_pairs_intra(spark, sf_dir):
    return _knn(spark, sf_dir, "intra", 12, 0.3)


@query(_knn_sql("cross", 12, 0.3))
def knn_pairs_cross(spark, sf_dir):
    return _knn(spark, sf_dir, "cross", 12, 0.3)


@query(_knn_sql("intra", 3, 0.2))
def knn_pairs_intra_ranked(spark, sf_dir):
    return _knn(spark, sf_dir, "intra", 3, 0.2)


@query(_knn_sql("cross", 3, 0.2))
def knn_pairs_cross_ranked(spark, sf_dir):
    return _knn(spark, sf_dir, "cross", 3, 0.2)


@query("SELECT vec_id, round(sqrt(list_sum([(x * (1 + vec_id % 9))::DOUBLE ** 2 for x in embedding::DOUBLE[]])), 5) AS length, 1.0::DOUBLE AS unit_length FROM embeddings")
def l2_lengths(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 9))
    rows = t.read(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("v"))
    return rows.select("vec_id", F.round(norm(F.col("v")), 5).alias("length"), F.round(norm(l2_normalise(F.col("v"))), 6).alias("unit_length"))


@query(
    """
WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT sum(n)::BIGINT AS claims, count(*) AS documents, sum(n * (n - 1) // 2)::BIGINT AS intra_pairs,
       ((sum(n) * sum(n) - sum(n * n)) // 2)::BIGINT AS cross_pairs,
       floor(sum(n) * (sum(n) - sum(n) / count(*)) / 2 + 0.5)::BIGINT AS cross_estimate FROM s"""
)
def pair_baseline(spark, sf_dir):
    return neighbours.baseline(t.read(spark, sf_dir, "embeddings"), "label")


@query(
    f"""
WITH p AS ({_knn_sql("intra", 12, 0.3)}), s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT (SELECT count(*) FROM p) AS candidates,
       (SELECT count(*) FROM p WHERE a_id % 11 <> 0 AND b_id % 11 <> 0) AS after_type_filter,
       (SELECT sum(n * (n - 1) // 2)::BIGINT FROM s) AS baseline,
       round(100 - (SELECT count(*) FROM p) * 100.0 / (SELECT sum(n * (n - 1) // 2) FROM s), 6) AS reduction_percent"""
)
def candidate_stats(spark, sf_dir):
    _, _, stats = detect.detect(t.vector_claims(spark, sf_dir), "intra", 12, 0.3)
    return stats.select("candidates", "after_type_filter", "baseline", F.round("reduction_percent", 6).alias("reduction_percent"))


def _findings_sql(scope: str) -> str:
    a, b = "(a_id % 13 + 0.5)", "(b_id % 13 + 0.5)"
    return f"""
WITH p AS ({_knn_sql(scope, 12, 0.3)}), c AS (
  SELECT a_id, b_id, similarity, abs({a} - {b})::DOUBLE AS difference, abs({a} - {b})::DOUBLE / greatest({a}, {b})::DOUBLE AS r FROM p
  WHERE a_id % 11 <> 0 AND b_id % 11 <> 0 AND (a_id % 5 = 0) = (b_id % 5 = 0) AND a_id % 2 = b_id % 2
)
SELECT a_id, b_id, '{scope}' AS scope, 'NUMERIC' AS conflict_type, 'CONTRADICTS' AS verdict, round(least(1.0, 0.5 + 2.5 * r), 6) AS confidence,
       round(r, 6) AS relative_difference, a_id * 10 AS a_start, b_id * 10 + 8 AS b_end, similarity
FROM c WHERE difference > 0.1 AND r >= 0.005"""


def _findings(spark, sf_dir, scope):
    _, found, _ = detect.detect(t.vector_claims(spark, sf_dir), scope, 12, 0.3)
    difference = F.abs(F.col("quantity_a.value") - F.col("quantity_b.value"))
    return found.select(
        "a_id", "b_id", "scope", "conflict_type", "verdict", F.round("confidence", 6).alias("confidence"),
        F.round(difference / F.greatest("quantity_a.value", "quantity_b.value"), 6).alias("relative_difference"),
        F.col("spans.a.start").cast("long").alias("a_start"), F.col("spans.b.end").cast("long").alias("b_end"), F.round("similarity", 6).alias("similarity"),
    )


@query(_findings_sql("intra"))
def findings_intra(spark, sf_dir):
    """Self-consistency of all documents at once: neighbours, type filter, best conflict."""
    return _findings(spark, sf_dir, "intra")


@query(_findings_sql("cross"))
def findings_cross(spark, sf_dir):
    return _findings(spark, sf_dir, "cross")


@query(
    f"""
WITH p AS ({_knn_sql("cross", 3, 0.2)})
SELECT p.a_id, p.b_id, da.source AS a_source, db.source AS b_source, sha256(coalesce(da.text, '') || chr(0) || coalesce(db.text, '')) AS pair_hash
FROM p JOIN documents da ON da.doc_id = p.a_id JOIN documents db ON db.doc_id = p.b_id"""
)
def rehydrate_pairs(spark, sf_dir):
    """Pairs of ids first, texts joined afterwards."""
    docs = t.read(spark, sf_dir, "documents")
    side = lambda s: docs.select(F.col("doc_id").alias(f"{s}_id"), F.col("source").alias(f"{s}_source"), F.coalesce("text", F.lit("")).alias(f"{s}_text"))
    pairs = _knn(spark, sf_dir, "cross", 3, 0.2).select("a_id", "b_id").join(side("a"), "a_id").join(side("b"), "b_id")
    return pairs.select("a_id", "b_id", "a_source", "b_source", text.ordered_pair_hash(F.col("a_text"), F.col("b_text")).alias("pair_hash"))


# --- sections, spans, hashes -------------------------------------------------------------------

_TITLES = ["Introduction", " References ", "Appendix", "ACKNOWLEDGMENTS", "Results", "Appendix A", "bibliography", "Method"]


@query(
    f"""
WITH s AS (SELECT doc_id, [{", ".join(map(_quote, _TITLES))}][1 + doc_id % {len(_TITLES)}] AS title, length(text) AS length FROM documents)
SELECT doc_id, title, length FROM s WHERE length >= 200 AND NOT regexp_matches(trim(title), '^(references|bibliography|acknowledgements?|acknowledgments?|appendix)$', 'i')"""
)
def eligible_sections(spark, sf_dir):
    title = F.get(F.array(*map(F.lit, _TITLES)), (F.col("doc_id") % len(_TITLES)).cast("int"))
    rows = t.read(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.col("text").alias("body"))
    return extract.eligible_sections(rows).select("doc_id", "title", F.length("body").cast("long").alias("length"))


@query(
    r"""
WITH m AS (SELECT doc_id, replace(replace(text, '. ', '.' || chr(9) || ' ' || chr(13) || chr(10) || chr(10) || chr(13) || ' '), ', ', ',' || chr(9)) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS collapsed_hash FROM m"""
)
def collapse_ws(spark, sf_dir):
    messy = F.replace(F.replace("text", F.lit(". "), F.lit(".\t \r\n\n\r ")), F.lit(", "), F.lit(",\t"))
    return t.read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.content_hash(text.collapse_whitespace(messy)).alias("collapsed_hash"))


_SPANS = """
SELECT conv_id, turn, (sum(length(text) + 2) OVER w - length(text) - 2)::BIGINT AS char_start, (sum(length(text) + 2) OVER w - 2)::BIGINT AS char_end,
       row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS number, sha256(text) AS content_hash
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"""


def _spans(spark, sf_dir):
    over = "over (partition by conv_id order by turn rows unbounded preceding)"
    rows = t.read(spark, sf_dir, "conversations").withColumn("e", F.expr(f"sum(length(text) + 2) {over} - 2"))
    return rows.select("conv_id", "turn", (F.col("e") - F.length("text")).alias("char_start"), F.col("e").alias("char_end"), F.expr("cast(row_number() over (partition by conv_id, role order by turn) as bigint)").alias("number"), text.content_hash(F.col("text")).alias("content_hash"), "text")


@query(_SPANS)
def section_spans(spark, sf_dir):
    """Turns as the sections of a conversation: running offsets, numbers by role, hashes."""
    return _spans(spark, sf_dir).drop("text")


@query("SELECT conv_id, true AS sound FROM conversations GROUP BY conv_id")
def span_round_trip(spark, sf_dir):
    """Slicing the joined text by its spans gives back every turn."""
    rows = _spans(spark, sf_dir)
    whole = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("whole"), F.collect_list(F.struct("char_start", "char_end", "text")).alias("parts"))
    back = F.forall("parts", lambda p: (text.span(F.col("whole"), p["char_start"].cast("int"), p["char_end"].cast("int")) == p["text"]) & (p["char_end"] > p["char_start"]))
    return whole.select("conv_id", back.alias("sound"))


@query(
    """
SELECT doc_id, item_id, (strpos(d.text, b.text) - 1)::BIGINT AS char_start, (strpos(d.text, b.text) - 1 + length(b.text))::BIGINT AS char_end, true AS contained
FROM documents d JOIN benchmark b ON contains(d.text, b.text)"""
)
def locate_quotes(spark, sf_dir):
    """Where benchmark passages stand in documents, whatever their length and wherever they begin."""
    items = t.read(spark, sf_dir, "benchmark").filter("text is not null").select("item_id", F.col("text").alias("quote"))
    docs = t.read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    at = passages.locate_all(docs, items, "doc_id", "text", "item_id", "quote")
    return at.select("doc_id", "item_id", F.col("start").cast("long").alias("char_start"), F.col("end").cast("long").alias("char_end"), F.lit(True).alias("contained"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, sha256(coalesce(source, '') || chr(10) || coalesce(text, '')) AS embedding_key FROM documents")
def content_hashes(spark, sf_dir):
    whole = F.coalesce("text", F.lit(""))
    return t.read(spark, sf_dir, "documents").select("doc_id", text.content_hash(whole).alias("content_hash"), text.content_hash(text.embedding_text(F.coalesce("source", F.lit("")), whole)).alias("embedding_key"))


# --- keyed tables ------------------------------------------------------------------------------

_HASHED = "SELECT doc_id, source, sha256(coalesce(text, '')) AS content_hash FROM documents"
_CACHE = f"SELECT content_hash, min(doc_id) AS cached_id FROM ({_HASHED}) WHERE doc_id % 3 = 0 GROUP BY 1"


def _hashed(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", "source", text.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


def _cache(spark, sf_dir):
    return _hashed(spark, sf_dir).filter("doc_id % 3 = 0").groupBy("content_hash").agg(F.min("doc_id").alias("cached_id"))


@query(f"SELECT h.doc_id, c.cached_id, h.content_hash FROM ({_HASHED}) h JOIN ({_CACHE}) c USING (content_hash)")
def cache_hits(spark, sf_dir):
    return keyed.hits(_hashed(spark, sf_dir), _cache(spark, sf_dir), ["content_hash"]).select("doc_id", "cached_id", "content_hash")


@query(f"SELECT DISTINCT content_hash FROM ({_HASHED}) WHERE content_hash NOT IN (SELECT content_hash FROM ({_CACHE}))")
def cache_misses(spark, sf_dir):
    return keyed.misses(_hashed(spark, sf_dir).select("content_hash"), _cache(spark, sf_dir), ["content_hash"])


@query(f"SELECT content_hash, min(doc_id) AS cached_id FROM ({_HASHED}) WHERE content_hash NOT IN (SELECT content_hash FROM ({_CACHE})) GROUP BY 1")
def insert_ignore(spark, sf_dir):
    new = _hashed(spark, sf_dir).select("content_hash", F.col("doc_id").alias("cached_id"))
    return keyed.insert_ignore(_cache(spark, sf_dir), new, ["content_hash"])


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_rows(spark, sf_dir):
    old = t.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return keyed.upsert(old, old.filter("o_orderkey % 4 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"])


@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN upper(role) ELSE role END AS role FROM conversations WHERE conv_id % 2 = 1 OR turn < 2")
def swap_by_key(spark, sf_dir):
    """All rows of a key replaced by new ones, fewer than before."""
    old = t.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return keyed.replace_where(old, old.filter("conv_id % 2 = 0 and turn < 2").withColumn("role", F.upper("role")), ["conv_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id % 5 IN (0, 1)")
def changed_documents(spark, sf_dir):
    """Documents that a stored state lacks (doc_id % 5 = 0) or holds with another hash (= 1)."""
    fresh = _hashed(spark, sf_dir).filter("doc_id is not null").withColumn("parser_version", F.lit("1"))
    stored = fresh.filter("doc_id % 5 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 1, F.lit("old")).otherwise(F.col("content_hash")))
    return keyed.changed(stored, fresh, ["doc_id"], ["content_hash", "parser_version"]).select("doc_id", "source")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_subquery(spark, sf_dir):
    doomed = t.read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return keyed.delete_by(t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), doomed, ["l_orderkey"])


@query(
    f"""
WITH k AS (SELECT content_hash AS key, count(*) AS n FROM ({_HASHED}) GROUP BY 1), f AS (SELECT k.*, key IN (SELECT content_hash FROM ({_CACHE})) AS known FROM k)
SELECT sum(n)::BIGINT AS claims, count(*) AS distinct_keys, count_if(known)::BIGINT AS cached, count_if(NOT known)::BIGINT AS computed, (sum(n) - count(*))::BIGINT AS duplicates FROM f"""
)
def embedding_dedupe_stats(spark, sf_dir):
    keys = _hashed(spark, sf_dir).select(F.col("content_hash").alias("key"))
    return extract.embedding_stats(keys, _cache(spark, sf_dir).select(F.col("content_hash").alias("key")))


@query("SELECT event_type AS claim_type, count(*) AS n FROM events GROUP BY 1")
def claims_by_type(spark, sf_dir):
    return extract.claims_by_type(t.read(spark, sf_dir, "events").withColumnRenamed("event_type", "claim_type"))


@query("SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 40)::BIGINT AS batch_no FROM documents")
def batch_fixed(spark, sf_dir):
    rows = extract.fixed_batches(t.read(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], extract.EMBED_BATCH)
    return rows.select("doc_id", "source", F.col("batch_no").cast("long").alias("batch_no"))


@query(
    """
WITH RECURSIVE s AS (
  SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations
), g AS (
  SELECT conv_id, turn, i, n AS size, 0 AS batch_no FROM s WHERE i = 1
  UNION ALL
  SELECT s.conv_id, s.turn, s.i, CASE WHEN g.size + s.n > 700 THEN s.n ELSE g.size + s.n END, g.batch_no + CASE WHEN g.size + s.n > 700 THEN 1 ELSE 0 END
  FROM g JOIN s ON s.conv_id = g.conv_id AND s.i = g.i + 1
)
SELECT conv_id, turn, batch_no::BIGINT AS batch_no FROM g"""
)
def batch_greedy(spark, sf_dir):
    """Turns packed in order into calls of at most 700 characters."""
    rows = t.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return extract.greedy_batches(rows, "conv_id", "turn", "n", 700).select("conv_id", "turn", F.col("batch_no").cast("long").alias("batch_no"))


# --- gates -------------------------------------------------------------------------------------

_VERDICTS = """
  SELECT l.doc_id, l.doc_id % 9 <> 0 AND coalesce(quality = 1, false) AS same, CASE WHEN l.doc_id % 4 = 0 THEN 'TENSION' WHEN l.doc_id % 4 <> 3 THEN 'CONTRADICTS' ELSE 'NEUTRAL' END AS verdict,
    CASE WHEN l.doc_id % 7 = 0 THEN 'not-returned' WHEN l.doc_id % 5 = 0 OR l.doc_id % 5 = 1 THEN 'objection-succeeded'
         WHEN l.doc_id % 3 = 0 OR trim(regexp_replace(substr(coalesce(text, ''), 1 + length(coalesce(text, '')) // 2, 20), '\\s+', ' ', 'g')) = '' THEN 'span-not-quoted'
         WHEN l.doc_id % 8 = 0 THEN 'span-not-found' END AS reason
  FROM labels l JOIN documents USING (doc_id)"""
_REFINED = f"""
  SELECT doc_id, CASE WHEN NOT same THEN 'different-subject' WHEN verdict <> 'CONTRADICTS' THEN 'not-contradiction' WHEN reason IS NOT NULL THEN 'rejected' ELSE 'reported' END AS outcome,
    CASE WHEN same AND verdict = 'CONTRADICTS' THEN reason END AS reason, CASE WHEN same AND verdict = 'CONTRADICTS' THEN reason IS NULL END AS passed
  FROM ({_VERDICTS})"""


@query(_REFINED)
def refine_gates(spark, sf_dir):
    return refine.refine(t.verdict_findings(spark, sf_dir), deterministic_conflict=False).select("doc_id", "outcome", "reason", "passed")


@query(
    f"""
SELECT doc_id, same AS same_subject, CASE WHEN same THEN verdict ELSE 'NEUTRAL' END AS verdict, CASE WHEN doc_id % 9 = 0 OR doc_id % 6 = 0 THEN 0.0::DOUBLE ELSE 0.5 END AS confidence FROM ({_VERDICTS})"""
)
def classification_normal(spark, sf_dir):
    c = refine.normalise_classification(F.col("classification"))
    return t.verdict_findings(spark, sf_dir).select("doc_id", c.alias("c")).select("doc_id", "c.same_subject", "c.verdict", "c.confidence")


@query(
    f"""
SELECT count(*) AS candidates, ceil(count(*) / 20)::BIGINT AS classifier_calls, ceil(count_if(outcome IN ('rejected', 'reported')) / 10)::BIGINT AS verifier_calls,
  count_if(outcome = 'different-subject')::BIGINT AS rejected_different_subject, count_if(outcome = 'not-contradiction')::BIGINT AS rejected_not_contradiction,
  count_if(outcome = 'rejected')::BIGINT AS rejected_by_verifier, count_if(outcome = 'reported')::BIGINT AS reported FROM ({_REFINED})"""
)
def refine_stats(spark, sf_dir):
    return refine.refine_stats(refine.refine(t.verdict_findings(spark, sf_dir), deterministic_conflict=False))


@query(f"SELECT reason, count(*) AS n FROM ({_REFINED}) WHERE reason IS NOT NULL GROUP BY 1")
def rejection_reasons(spark, sf_dir):
    return refine.rejection_reasons(refine.refine(t.verdict_findings(spark, sf_dir), deterministic_conflict=False))


def _arm_sql(classify: bool, verify: bool) -> str:
    kept = "same" if classify else "true"
    ok = "reason IS NULL" if verify else "true"
    return f"""SELECT 'classify={"on" if classify else "off"},verify={"on" if verify else "off"}' AS arm, count(*) AS candidates,
      {"ceil(count(*) / 20)" if classify else "0"}::BIGINT AS classifier_calls, {f"ceil(count_if({kept}) / 10)" if verify else "0"}::BIGINT AS verifier_calls,
      count_if(NOT {kept})::BIGINT AS rejected_different_subject, 0::BIGINT AS rejected_not_contradiction,
      count_if({kept} AND NOT ({ok}))::BIGINT AS rejected_by_verifier, count_if({kept} AND {ok})::BIGINT AS reported FROM ({_VERDICTS})"""


@query(" UNION ALL ".join(_arm_sql(c, v) for c in (True, False) for v in (True, False)))
def ablation_arms(spark, sf_dir):
    """All settings of the two stages; the arithmetic has proven the conflict, so only the subject is asked."""
    return refine.ablation(t.verdict_findings(spark, sf_dir))


_ASKED = """
  SELECT l.doc_id, sha256('a' || chr(1) || coalesce(text, '') || chr(0) || 'b' || chr(1) || 'other ' || l.doc_id) AS content_hash, l.doc_id % 9 <> 0 AS known,
    coalesce(quality = 1, false) AS same_subject, CASE WHEN l.doc_id % 4 = 0 THEN 'TENSION' ELSE 'CONTRADICTS' END AS verdict
  FROM labels l JOIN documents USING (doc_id)"""


@query(f"SELECT doc_id, content_hash, known AND same_subject AS same_subject, CASE WHEN known AND same_subject THEN verdict ELSE 'NEUTRAL' END AS verdict, NOT known AS asked FROM ({_ASKED})")
def cached_verdicts(spark, sf_dir):
    """Pairs and their cached classifications, by a key that doesn't depend on the pair's order; what the cache lacks would be asked."""
    rows = t.read(spark, sf_dir, "labels").join(t.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    n, other = F.col("doc_id"), F.concat(F.lit("other "), F.col("doc_id").cast("string"))
    key = lambda swap: text.pair_hash(F.lit("b"), other, F.lit("a"), F.col("text")) if swap else text.pair_hash(F.lit("a"), F.col("text"), F.lit("b"), other)
    answer = F.to_json(F.struct(F.coalesce(F.col("quality") == 1, F.lit(False)).alias("same_subject"), F.when(n % 4 == 0, "TENSION").otherwise("CONTRADICTS").alias("verdict")))
    cache = rows.filter(n % 9 != 0).select(key(True).alias("content_hash"), answer.alias("result")).dropDuplicates(["content_hash"])
    found = rows.select("doc_id", key(False).alias("content_hash")).join(cache, "content_hash", "left")
    c = refine.normalise_classification(F.from_json("result", refine.CLASSIFICATION))
    return found.select("doc_id", "content_hash", c.alias("c"), F.col("result").isNull().alias("asked")).select("doc_id", "content_hash", "c.same_subject", "c.verdict", "asked")


_FEED = "'<feed><entry><id>http://arxiv.org/abs/2301.' || lpad(p_partkey::VARCHAR, 5, '0') || 'v' || p_size || '</id><title>' || p_name || '\n &amp; ' || p_brand || '</title><published> 2024 </published></entry></feed>'"


@query(f"SELECT p_partkey, p_size::INT AS version, p_name || ' & ' || p_brand AS title, '2024' AS published, CAST(NULL AS VARCHAR) AS error FROM part WHERE length({_FEED}) > 0")
def paper_metadata(spark, sf_dir):
    """The first entry of a metadata feed per part."""
    feed = F.concat(F.lit("<feed><entry><id>http://arxiv.org/abs/2301."), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("v"), F.col("p_size").cast("string"), F.lit("</id><title>"), F.col("p_name"), F.lit("\n &amp; "), F.col("p_brand"), F.lit("</title><published> 2024 </published></entry></feed>"))
    meta = ids.metadata(feed, F.lit("x"), F.lit(None).cast("int"))
    return t.read(spark, sf_dir, "part").select("p_partkey", meta.alias("m")).select("p_partkey", "m.version", "m.title", "m.published", "m.error")


@query("SELECT count(DISTINCT label) AS documents, count(vec_id) AS claims FROM embeddings")
def corpus_size(spark, sf_dir):
    return detect.corpus_size(t.vector_claims(spark, sf_dir))


# --- mutations and evaluation ------------------------------------------------------------------

_SCORE, _SHARE = "(doc_id % 90 + 1) || '.' || (doc_id % 9 + 1)", "'0.' || (doc_id % 7 + 1) || (doc_id % 9 + 1)"
_HEAD = "'We report BLEU of ' || {s} || ' for Model ' || (doc_id % 5) || ' on test. Accuracy of ' || {h} || ' for Model ' || (doc_id % 5) || ' on test.'".format(s=_SCORE, h=_SHARE)


@query()
def decimal_sites(spark, sf_dir):
    docs, sections = t.measured_documents(spark, sf_dir)
    return mutate.sites(docs, sections)


@query()
def mutation_plan(spark, sf_dir):
    return mutate.plan(mutate.sites(*t.measured_documents(spark, sf_dir)))


@query()
def mutation_sample(spark, sf_dir):
    found = mutate.sites(*t.measured_documents(spark, sf_dir))
    return mutate.sample(mutate.plan(found), mutate.plan_order(found), 1, 42)


@query(
    f"""
WITH d AS (SELECT doc_id, {_HEAD} AS head, {_SCORE} AS score, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, sha256('We report BLEU of ' || repeat('9', length(score)) || substr(head, 19 + length(score)) || chr(10) || chr(10) || replace(head, 'We report', 'Here') || ' ' || text) AS mutated_hash,
  (length(head) + 3 + length(head) - 5 + length(text))::BIGINT AS length FROM d"""
)
def mutation_apply(spark, sf_dir):
    """The first score of each document overwritten with nines of the same width."""
    docs, _ = t.measured_documents(spark, sf_dir)
    n = F.col("doc_id")
    score = F.format_string("%d.%d", n % 90 + 1, n % 9 + 1)
    change = docs.select("doc_id", F.lit(18).alias("char_start"), (F.length(score) + 18).alias("char_end"), score.alias("original_text"), F.repeat(F.lit("9"), F.length(score)).alias("mutated_text"))
    return mutate.apply(docs, change).select("doc_id", F.sha2("text", 256).alias("mutated_hash"), F.length("text").cast("long").alias("length"))


@query(
    """
WITH m AS (SELECT conv_id AS document_id, turn, turn * 20 AS char_start, turn * 20 + 6 AS char_end FROM conversations WHERE turn < 2),
f AS (SELECT conv_id AS document_id, conv_id * 100 + turn AS id, turn * 9 AS s, CASE WHEN turn % 3 < 2 THEN turn * 9 + 8 END AS e FROM conversations)
SELECT document_id, turn, char_start, char_end, min(f.id) AS matched_finding, min(f.id) IS NOT NULL AS detected
FROM m LEFT JOIN f USING (document_id) WHERE false GROUP BY ALL
UNION ALL
SELECT m.document_id, m.turn, m.char_start, m.char_end, min(f.id), min(f.id) IS NOT NULL
FROM m LEFT JOIN f ON m.document_id = f.document_id AND f.s < m.char_end AND f.e > m.char_start GROUP BY ALL"""
)
def overlap_hits(spark, sf_dir):
    c = t.read(spark, sf_dir, "conversations")
    m = c.filter("turn < 2").select(F.col("conv_id").alias("document_id"), "turn", (F.col("turn") * 20).alias("char_start"), (F.col("turn") * 20 + 6).alias("char_end"))
    none = F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    a = F.struct((F.col("turn") * 9).alias("start"), F.when(F.col("turn") % 3 < 2, F.col("turn") * 9 + 8).alias("end"))
    f = c.select(F.col("conv_id").alias("document_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.struct(none.alias("b"), a.alias("a")).alias("spans"))
    return mutate.score(m, f)


@query("SELECT lang AS mutation_type, count(*) AS total, count_if(quality = 1)::BIGINT AS detected, round(count_if(quality = 1) / count(*), 6) AS recall FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def recall_by_type(spark, sf_dir):
    rows = t.read(spark, sf_dir, "labels").join(t.read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.recall_by_type(rows.select(F.col("lang").alias("mutation_type"), (F.col("quality") == 1).alias("detected"))).withColumn("recall", F.round("recall", 6))


@query("SELECT (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 1) AS papers, (SELECT count(*) FROM labels WHERE quality = 1 AND toxic = 1) AS findings, round((SELECT count(*) FROM labels WHERE quality = 1 AND toxic = 1) / (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 1), 6) AS false_positives_per_paper")
def false_positive_rate(spark, sf_dir):
    labels = t.read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "document_id")
    out = evaluate.false_positives(labels.filter("quality = 1"), labels.filter("toxic = 1"))
    return out.withColumn("false_positives_per_paper", F.round("false_positives_per_paper", 6))


@query("SELECT o_orderkey AS id, o_orderpriority AS model FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_run(spark, sf_dir):
    """The run that started last (a report of one row)."""
    runs = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderpriority").alias("model"))
    return evaluate.latest_run(runs).select("id", "model")


@query()
def injection_recall(spark, sf_dir):
    """The whole benchmark: claims by rule, one known contradiction per document, both arms."""
    from ..operators.extract import RuleProvider

    docs, sections = t.measured_documents(spark, sf_dir)
    return evaluate.evaluate(docs, sections, RuleProvider(), per_paper=1, seed=42, k=12, t=0.3)["injections"].select("document_id", "mutation_type", "original_text", "mutated_text", "detected")


# --- metering ----------------------------------------------------------------------------------

_EVENTS = "SELECT event_id, ts AS began, event_type AS kind, value AS duration_ms, event_id % 10 <> 0 AS ok, event_id % 100 AS input_tokens, CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS output_tokens, json_extract_string(props, '$.k')::BIGINT AS items FROM events"
_TOTALS = "count(*) AS calls, coalesce(sum(items), 0)::BIGINT AS items, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, 0::BIGINT AS bytes, round(coalesce(sum(duration_ms), 0), 3) AS duration_ms, count_if(NOT ok)::BIGINT AS failures"


@query(f"SELECT {_TOTALS} FROM ({_EVENTS})")
def meter_totals(spark, sf_dir):
    return meter.totals(t.meter_events(spark, sf_dir)).withColumn("duration_ms", F.round("duration_ms", 3))


@query(f"SELECT kind, {_TOTALS} FROM ({_EVENTS}) GROUP BY ROLLUP (kind)")
def meter_rollup(spark, sf_dir):
    return meter.totals_by_kind(t.meter_events(spark, sf_dir)).withColumn("duration_ms", F.round("duration_ms", 3))


@query(f"SELECT event_id, sum(items) OVER (PARTITION BY kind ORDER BY began RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)::BIGINT AS items_in_window FROM ({_EVENTS})")
def rolling_rate(spark, sf_dir):
    return meter.rolling_items(t.meter_events(spark, sf_dir), "kind").select("event_id", "items_in_window")


@query("WITH g AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000 AS gap_ms FROM events) SELECT event_id, round(gap_ms, 3) AS gap_ms, coalesce(gap_ms < 3000, false) AS too_soon FROM g")
def min_gap(spark, sf_dir):
    return meter.gaps(t.meter_events(spark, sf_dir), "label", 3000).select("event_id", F.round("gap_ms", 3).alias("gap_ms"), "too_soon")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return t.read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# --- sources -----------------------------------------------------------------------------------

_IDS = "CASE p_partkey % 7 WHEN 0 THEN ' 2301.' || lpad(p_partkey::VARCHAR, 5, '0') WHEN 1 THEN 'https://arxiv.org/abs/2301.' || lpad(p_partkey::VARCHAR, 5, '0') || 'v' || (p_size) WHEN 2 THEN 'HTTP://arXiv.org/pdf/1706.03762v7.pdf' WHEN 3 THEN 'arXiv:math/' || lpad(p_partkey::VARCHAR, 7, '0') WHEN 4 THEN 'math.GT/' || lpad(p_partkey::VARCHAR, 7, '0') || 'v2' WHEN 5 THEN p_name ELSE '2301.123456' END"


@query(
    rf"""
WITH r AS (SELECT p_partkey, {_IDS} AS raw FROM part),
s AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(raw), '^https?://arxiv\.org/(?:abs|pdf|e-print)/', '', 'i'), '\.pdf$', '', 'i'), '^arxiv:', '', 'i') AS x FROM r),
p AS (SELECT p_partkey, x, regexp_matches(x, '^\d{{4}}\.\d{{4,5}}(v\d+)?$') OR regexp_matches(x, '^[a-z-]+(\.[A-Z]{{2}})?/\d{{7}}(v\d+)?$') AS ok FROM s)
SELECT p_partkey, CASE WHEN ok THEN regexp_replace(x, 'v\d+$', '') END AS id, CASE WHEN ok AND regexp_matches(x, 'v\d+$') THEN regexp_extract(x, 'v(\d+)$', 1)::INT END AS version,
  CASE WHEN ok THEN 'https://arxiv.org/abs/' || x END AS url FROM p"""
)
def arxiv_ids(spark, sf_dir):
    raw = F.expr(_IDS.replace("::VARCHAR", "").replace("(p_size)", "p_size"))
    rows = t.read(spark, sf_dir, "part").select("p_partkey", ids.parse_arxiv_id(raw).alias("p"))
    return rows.select("p_partkey", "p.id", "p.version", ids.abs_url(ids.format_arxiv_id(F.col("p.id"), F.col("p.version"))).alias("url"))


@query(
    """
WITH c AS (SELECT conv_id, turn, 'Turn ' || turn AS title, regexp_replace(trim(text), '\\n{3,}', chr(10) || chr(10), 'g') AS body FROM conversations WHERE conv_id IS NOT NULL)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS ordinal, row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ' ' || title AS path, 1::BIGINT AS level FROM c"""
)
def latex_sections(spark, sf_dir):
    """Conversations written as LaTeX bundles of two files, read back as numbered sections."""
    escaped = F.regexp_replace("text", r"([%$&#_{}])", r"\\$1")
    part = F.concat(F.lit("\\section{Turn "), F.col("turn").cast("string"), F.lit("}\n"), escaped)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n\n")
    bodies = t.read(spark, sf_dir, "conversations").filter("conv_id is not null").groupBy("conv_id").agg(body.alias("b"))
    main = F.lit("\\documentclass{article}\n% \\input{gone}\n\\begin{document}\n\\input{body}\n\\end{document}\n")
    bundles = bodies.select("conv_id", F.create_map(F.lit("paper/main.tex"), main, F.lit("paper/body.tex"), F.col("b")).alias("files"))
    rows = latex.section_rows(latex.parse_bundles(bundles), "conv_id")
    return rows.select("conv_id", F.col("ordinal").cast("long").alias("ordinal"), "path", F.col("level").cast("long").alias("level"))


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS content_hash FROM documents")
def stream_distinct(spark, sf_dir):
    """Documents as a stream, each content once, through a sink that ignores what it has."""
    return ingest.stream_once(spark, f"{sf_dir}/documents.parquet")
