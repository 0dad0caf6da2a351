"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are found by form: e-mail and IP addresses, card and phone numbers (the base kinds), and secrets
in published formats or of long mixed hexadecimal digits. A text is a sequence of units: words, runs of
digit groups, and the signs = : " ' that tie a value to its name. The units around a seed (within CONTEXT
characters) and its shape induce lexical patterns. Patterns and instances form a bipartite graph. In each round a
pattern is trusted for a kind if enough different known instances stand in it and most of all different
units in it are known to be of that kind; any unknown unit in trusted patterns is accepted if their
precisions make it likely enough (noisy-or), and is known in the next round. Rounds go on until nothing
more is accepted. Accepted units that stand in a trusted pattern give further spans, of kind
learned_<kind>; the seeds' spans stay as they are.

The seeds' edges come from their spans, so no table of seeds is sent around. Patterns and accepted values
are sent to the tasks that scan the texts, at most SENT at a time; more of them take more scans. A round
scans the texts to estimate how many units stand in new patterns, to count those in patterns that may be
precise enough, and for accepted values if there are any.
Edges are distinct (pattern, instance) pairs, pre-aggregated before the shuffle, so copies of a
document weigh once and a frequent word is no hot task. Patterns and values go by 64-bit hashes.

Offsets are code points, ends exclusive; matches of a kind are leftmost and don't overlap. Defined
cases: null counts as empty, which has no spans; repeated rows and null ids give a row each; a row with very many
matches costs little more than its length; an empty table gives an empty result; further columns of
any name are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, quoted, running_starts, table

# The patterns of the four kinds, in the order of the result. Quantifiers are possessive and runs are entered at
# their start (or where the last match ended, \G) only: the same matches, in linear time and constant stack.
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
KINDS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text needs for a match at all; cheap to test.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
# Published formats of secrets, and hexadecimal strings that no word or number is.
_FORMATS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    r"AIza[0-9A-Za-z_-]{35}",
    r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}+",
    r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++",
    r"(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{16,}+",
)
SECRET = r"(?<![A-Za-z0-9])(?:" + "|".join(_FORMATS) + r")(?![A-Za-z0-9])"
#: What a text with a secret contains: a beginning, or a digit next to a hexadecimal letter.
SECRET_BEGINS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "k_live_", "k_test_", "eyJ")
SECRET_NEEDS = r"[0-9](?:(?=[A-Fa-f])|(?<=[A-Fa-f][0-9]))"
SEEDS = (*KINDS, "secret")

#: A unit: a run of digit groups, a word, or one of the signs; what can't be part of a word parts units.
_APART = r"\x20\x09-\x0D\"'=:;,<>()\[\]{}|"
UNIT = rf"[+(]?[0-9](?:[0-9().\x20-]*[0-9])?(?![A-Za-z0-9_@%])|[^{_APART}]*[^{_APART}.!?]|[\"'=:]"
SIGNS = ("'", '"', "=", ":")

MIN_SUPPORT, MIN_PRECISION, MIN_CONFIDENCE = 5, 0.6, 0.75
#: Patterns or values that are sent to the tasks at a time (16 bytes each).
SENT = 2_000_000
CONTEXT = 96
#: An estimate of a pattern's units has a standard error of 5 %; it must exceed its bound by so much to drop the pattern.
MARGIN = 1.5

SPANS = "array<struct<start:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str, needs: str | None) -> Column:
    """All matches as (start, end, value): the lengths of the gaps between matches give the offsets."""

    def spans(values: Column, gaps: Column) -> Column:
        both = F.zip_with(gaps, values, lambda g, v: g + F.coalesce(F.length(v), F.lit(0)))
        at = lambda starts, i: (F.get(starts, i) + F.get(gaps, i)).cast("int")
        one = lambda starts, v, i: F.struct(at(starts, i).alias("start"), (at(starts, i) + F.length(v)).alias("end"), v.alias("value"))
        return let(running_starts(both), lambda starts: F.transform(values, lambda v, i: one(starts, v, i)))

    lengths = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: let(lengths, lambda gaps: spans(values, gaps)))
    return found if needs is None else F.when(text.rlike(needs), found).otherwise(F.array().cast(SPANS))


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array of (kind no., start, end, value), by kind, then start."""
    return F.concat(*(_numbered(i, _kept(kind, spans_of(text, pattern, NEEDS[kind]))) for i, (kind, pattern) in enumerate(KINDS.items())))


def seed_spans(text: Column) -> Column:
    """base_spans, then the secrets that overlap none of them."""
    may = reduce(Column.__or__, (text.contains(x) for x in SECRET_BEGINS)) | text.rlike(SECRET_NEEDS)
    secrets = F.when(may, _numbered(len(KINDS), spans_of(text, SECRET, None)))
    return let(base_spans(text), lambda base: F.concat(base, F.coalesce(F.filter(secrets, lambda s: ~_overlaps(s, base)), F.filter(base, lambda _: F.lit(False)))))


def _kept(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: passes(kind, s["value"]))


def _numbered(i: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


# What a pattern consists of besides the unit before, by its number, which is the first figure of its hash.
PATTERNS = ("two more units before", "one more unit before", "unit after", "nothing", "shape")


def patterns(value: Column, l1: Column, l2: Column, l3: Column, r1: Column) -> Column:
    """The hashes of the lexical patterns of a lower-cased unit with its lower-cased neighbours."""
    shape = F.translate(value, "bcdefghijklmnopqrstuvwxyz123456789", "a" * 25 + "0" * 9)
    return F.array(*(F.xxhash64(F.lit(i), *part) for i, part in enumerate(((l3, l2, l1), (l2, l1), (l1, r1), (l1,), (l1, shape)))))


def seed_edges(seeds: DataFrame) -> DataFrame:
    """(pattern, v, kind, l1) of a table with seeds: array<kind, value, before, after>."""
    rows = seeds.select(F.explode("seeds").alias("s")).select("s.kind", F.lower("s.value").alias("value"), "s.cut", F.lower("s.before").alias("b"), F.lower("s.after").alias("a"))
    found = lambda c: F.regexp_extract_all(c, F.lit(UNIT), F.lit(0))
    rows = rows.withColumns({"b": found(F.col("b")), "a": found(F.col("a"))})
    # the first unit of a window that doesn't begin with the text may be the end of a longer one
    rows = rows.withColumn("b", F.when(F.col("cut"), F.slice("b", 2, F.greatest(F.size("b"), F.lit(1)))).otherwise(F.col("b")))
    at = lambda k: F.coalesce(F.try_element_at("b", F.lit(-k)), F.lit("^"))
    each = rows.select("kind", F.xxhash64("value").alias("v"), at(1).alias("l1"), patterns(F.col("value"), at(1), at(2), at(3), F.coalesce(F.try_element_at("a", F.lit(1)), F.lit("$"))).alias("p"))
    return each.select("v", "kind", "l1", F.explode("p").alias("pattern")).groupBy("pattern", "v").agg(F.max("kind").alias("kind"), F.first("l1").alias("l1"))


def units(docs: DataFrame, text: str, *carried: Column) -> DataFrame:
    """A row per unit that is no sign: carried, i (its number), u, and its neighbours l1, l2, l3 before and r1 after it."""
    found = F.regexp_extract_all(F.coalesce(quoted(text), F.lit("")), F.lit(UNIT), F.lit(0))
    rows = docs.select(*carried, found.alias("_u"))
    edge = lambda n: F.concat(F.array(*[F.lit("^")] * n), F.col("_u")).alias(f"l{n}")
    number = F.sequence(F.lit(0), F.greatest(F.size("_u") - 1, F.lit(0))).alias("i")
    zipped = F.arrays_zip(F.col("_u").alias("u"), number, edge(1), edge(2), edge(3), F.slice("_u", 2, F.greatest(F.size("_u"), F.lit(1))).alias("r1"))
    return rows.select(*(c for c in rows.columns if c != "_u"), F.inline(zipped)).filter(F.col("u").isNotNull() & ~F.col("u").isin(*SIGNS))


def _patterned(rows: DataFrame) -> DataFrame:
    """rows of units with v, l1 lower-cased and a row per pattern."""
    low = lambda c: F.lower(c)
    own = [c for c in rows.columns if c not in ("u", "l1", "l2", "l3", "r1")]
    p = patterns(low("u"), low("l1"), low("l2"), low("l3"), F.coalesce(low("r1"), F.lit("$")))
    return rows.select(*own, F.xxhash64(low("u")).alias("v"), low("l1").alias("l1"), F.explode(p).alias("pattern"))


def _standing(docs: DataFrame, text: str, wanted: DataFrame, *carried: Column) -> DataFrame:
    """The units that stand in wanted patterns (pattern, l1, ...): first by the unit before them, then by the whole pattern."""
    anchors = wanted.select(F.col("l1").alias("_anchor")).distinct()
    near = units(docs, text, *carried).join(F.broadcast(anchors), F.lower("l1") == F.col("_anchor"), "left_semi")
    return _patterned(near).drop("l1").join(F.broadcast(wanted.drop("l1")), "pattern")


def _sent(rows: DataFrame, by: str):
    """rows in parts that may be broadcast: one, unless there are more than SENT."""
    n = rows.count()
    parts = -(-n // SENT)
    return [rows.filter(F.pmod(F.xxhash64(by), F.lit(parts)) == i) if parts > 1 else rows for i in range(parts)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def bootstrap(docs: DataFrame, edges: DataFrame, text: str = "text", support: int = MIN_SUPPORT, precision: float = MIN_PRECISION, confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame] | None:
    """((v, kind) of accepted values, (pattern, kind, l1, precision) of trusted patterns), from the seeds' edges; None if nothing was accepted."""
    known, estimated, exact, seen, learned = [edges], [], [], [], []
    while True:
        facts = _union(known)
        supported = facts.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("known"), F.first("l1").alias("l1")).filter(F.col("known") >= support)
        best = materialize(supported.groupBy("pattern").agg(F.max("known").alias("most"), F.first("l1").alias("l1")), "pii-candidates")
        # most candidates are frequent words with far too many units: an estimate, added up per task, drops them
        fresh = best.join(_union(estimated), "pattern", "left_anti") if estimated else best
        for part in _sent(fresh, "pattern"):
            about = _standing(docs, text, part.select("pattern", "l1")).groupBy("pattern").agg(F.approx_count_distinct("v", 0.05).alias("about"))
            estimated.append(materialize(about, "pii-estimates"))
        if not estimated:
            return None
        hopeful = best.join(_union(estimated), "pattern").filter(F.col("most") * MARGIN >= precision * F.col("about"))
        hopeful = materialize(hopeful.join(_union(exact), "pattern", "left_anti") if exact else hopeful, "pii-hopeful")
        exact.append(hopeful.select("pattern"))
        for part in _sent(hopeful, "pattern"):
            stands = _standing(docs, text, part.select("pattern", "l1"))
            seen.append(materialize(stands.groupBy("pattern", "v").agg(F.count(F.lit(1)).alias("n")), "pii-edges"))
        if not seen:
            return None
        graph = _union(seen)
        totals = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("all"))
        trusted = supported.join(totals, "pattern").withColumn("precision", F.least(F.col("known") / F.col("all"), F.lit(1.0))).filter(F.col("precision") >= precision)
        trusted = materialize(trusted.select("pattern", "kind", "l1", "precision"), "pii-patterns")
        votes = graph.join(trusted.drop("l1"), "pattern").join(facts.select("v").distinct(), "v", "left_anti")
        # noisy-or; a precision of 1 counts as 0.999 so that its logarithm is finite
        scored = votes.groupBy("v", "kind").agg((1 - F.exp(F.sum(F.ln(1 - F.least("precision", F.lit(0.999)))))).alias("confidence"))
        best = scored.filter(F.round("confidence", 9) >= confidence).groupBy("v").agg(F.max(F.struct(F.round("confidence", 9), -F.col("kind"))).alias("b"))
        accepted = materialize(best.select("v", (-F.col("b.col2")).alias("kind")), "pii-learned")
        parts = _sent(accepted, "v")
        if not parts:
            return (_union(learned), trusted) if learned else None
        learned.append(accepted)
        for part in parts:
            found = _patterned(units(docs, text).join(F.broadcast(part), F.xxhash64(F.lower("u")) == F.col("v")).drop("v", "i"))
            known.append(materialize(found.groupBy("pattern", "v").agg(F.max("kind").alias("kind"), F.first("l1").alias("l1")), "pii-known"))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): one row per row of docs; spans are (kind, start, end, value), seeds by kind first, then what was learned."""
    whole = F.coalesce(quoted(text), F.lit(""))
    # rows alike in key and text share their result
    row = F.unhex(F.md5(F.concat(F.coalesce(quoted(key).cast("string"), F.lit("\x01")), F.lit("\x00"), whole))).alias("row")
    named = lambda spans, names: F.transform(spans, lambda s: F.struct(F.get(F.array(*map(F.lit, names)), s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    before = lambda t, s: F.substring(t, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
    window = lambda t, s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), (s["start"] > CONTEXT).alias("cut"), before(t, s).alias("before"), F.substring(t, s["end"] + 1, F.lit(CONTEXT)).alias("after"))
    seeded = let(whole, lambda t: F.transform(seed_spans(t), lambda s: window(t, s)))
    found = materialize(docs.select(quoted(key).alias("key"), row, seeded.alias("seeds")), "pii-seeds")
    seeds = named(F.col("seeds"), SEEDS)
    learned = bootstrap(docs, materialize(seed_edges(found), "pii-known"), text)
    if learned is None:
        return found.select(F.col("key").alias(key), seeds.alias("spans"))
    values, trusted = learned
    # a unit may stand in several trusted patterns: it is of the kind that was accepted for its value
    hits = _union([_standing(docs, text, part.select("pattern", "kind", "l1"), row) for part in _sent(trusted, "pattern")]).join(values, ["v", "kind"])
    hits = materialize(hits.groupBy("row", "i").agg(F.min("kind").alias("kind")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "i"))).alias("hits")), "pii-hits")
    texts = docs.select(row, whole.alias("text")).join(F.broadcast(hits) if hits.count() <= SENT // 16 else hits, "row").dropDuplicates(["row"])
    one = lambda known, h: F.struct(h["kind"].alias("kind"), F.get(known, h["i"])["start"].alias("start"), F.get(known, h["i"])["end"].alias("end"), F.get(known, h["i"])["value"].alias("value"))
    added = texts.select("row", let(spans_of(F.col("text"), UNIT, None), lambda known: F.transform("hits", lambda h: one(known, h))).alias("more"))
    more = F.filter(F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")), lambda s: ~_overlaps(s, F.col("seeds")))
    return found.join(added, "row", "left").select(F.col("key").alias(key), F.concat(seeds, named(more, [f"learned_{k}" for k in SEEDS])).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; n_found counts the spans of every kind."""
    found = detect(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_found"))
