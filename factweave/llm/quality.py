"""Quality rules: a hashed n-gram log-likelihood ratio after plain repetition and length rules.

Byte trigrams are hashed into BUCKETS counters, once over the whole corpus and once over the trusted
documents. A document scores the mean over its n-grams of log p_trusted - log p_corpus under the two
smoothed multinomials, and stays if the score is at least the threshold. Every document gets the same
deterministic rule; nothing is sampled. The threshold is the cut that errs least on labelled documents which pass the
base rules; of equally good cuts the middle of the widest gap between neighbouring scores. Without such labels of both
kinds it is THRESHOLD. Trigrams of bytes rather than words: their counts are dense
even over a few hundred trusted documents, while rare words of good documents that nobody labelled
would look untrusted.

Corpus counts cover all rows, trusted counts all documents labelled 1, and the threshold is fitted on all
labels. Each task adds up its own counters before the shuffle, and BUCKETS sums, a fixed number, reach the
driver and are broadcast. Up to SENT labels are sent to the rows; more of them meet the texts in a shuffle for the
counts, and for the threshold their scores, without the texts. Up to HELD scores reach the driver; the cut of
more is found by running sums over ranges of scores.

Defined cases: a null text has no words, fails the length rule and goes; a document with
contradictory labels isn't trusted; with no trusted documents every score is 0 and only the base
rules decide; repeated rows are scored each; an empty table gives an empty result; columns with
clashing names are carried through by `keep_good`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, quoted, scratch, table

BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Nats per n-gram, where the labels can't tell.
THRESHOLD = -0.7
STRETCH = 1 << 20
#: Labels that are sent to all tasks, and scores that the driver holds; they decide the way only, never the result.
SENT, HELD = 2_000_000, 1_000_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_BETWEEN = _SPACE + bytes(range(0x80, 0xC0))  # white space, and what continues a UTF-8 character


def ngram_buckets(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all byte trigrams, a stretch at a time, so a very long text takes bounded memory."""
    for start in range(0, len(text) - 2, STRETCH):
        b = np.frombuffer(text[start : start + STRETCH + 2], np.uint8).astype(np.uint64)
        grams = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        yield ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def base_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = Counter(x for x in text.split(b"\n") if x.strip(_SPACE))
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(windows) < len(words) - 2:
        end = 0  # words up to here are counted or passed
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if windows[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (
        len(words),
        len(text.translate(None, _BETWEEN)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        sum(lines.values()) - len(lines),
        repeated,
    )


def labelled_ids(labels: DataFrame, quality_: int, key: str = "doc_id", quality: str = "quality", most: int | None = None) -> DataFrame:
    """Ids of the documents that all their labels give that quality: all of them, or for a look at some the first `most` by a hash."""
    same = labels.filter(quoted(key).isNotNull()).groupBy(quoted(key)).agg(F.min(quoted(quality)).alias("least"), F.max(quoted(quality)).alias("most"))
    found = same.filter(f"least = {quality_} and most = {quality_}").select(key)
    return found if most is None else found.orderBy(F.xxhash64(quoted(key)), quoted(key)).limit(most)


def known_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(_id, _good): the documents whose labels agree on 1 or on 0, written."""
    good, bad = (labelled_ids(labels, quality_, key).select(quoted(key).alias("_id"), F.lit(quality_ == 1).alias("_good")) for quality_ in (1, 0))
    return materialize(good.unionByName(bad), "quality-labels")


def log_ratio(docs: DataFrame, known: DataFrame, sent: bool, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """log p_trusted - log p_corpus by bucket."""
    trust = known.filter("_good").select(F.col("_id").alias("_trusted"))
    marked = docs.select(quoted(key).alias("k"), quoted(text).cast("binary").alias("t")).join(F.broadcast(trust) if sent else trust, F.col("k") == F.col("_trusted"), "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text_, good in zip(batch.column(0), batch.column(1)):
                for at in ngram_buckets(text_.as_py() or b""):
                    np.add.at(sums[0], at, 1)
                    if good.as_py():
                        np.add.at(sums[1], at, 1)
        seen = np.flatnonzero(sums[0])
        for some in np.array_split(seen, max(1, len(seen) // 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["bucket", "corpus", "trusted"])

    counted = marked.select("t", F.col("_trusted").isNotNull().alias("good")).mapInArrow(count, "bucket long, corpus long, trusted long")
    sums = np.zeros((2, BUCKETS))
    for row in counted.groupBy("bucket").agg(F.sum("corpus"), F.sum("trusted")).toPandas().itertuples(index=False):
        sums[:, row[0]] = row[1:]
    if not sums[1].any():
        return np.zeros(BUCKETS)
    # the corpus is scaled to the size of the trusted part and both get the same pseudo-count, so what is rare in both weighs little
    share = sums[1].sum() / sums[0].sum()
    return np.log(sums[1] + SMOOTHING) - np.log(share * sums[0] + SMOOTHING)


def _judged(raw: bytes, ratio: np.ndarray) -> tuple[tuple[int, ...], bool, float]:
    """(figures, base_failed, score) of a text."""
    figures = base_figures(raw)
    failed = figures[0] < MIN_WORDS or 100 * figures[4] > MAX_REPEAT_PERCENT * figures[0]
    return figures, failed, sum(float(ratio[at].sum()) for at in ngram_buckets(raw)) / max(1, len(raw) - 2)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the fewest good scores below and bad ones not below it; of several the middle of the widest gap, then the lowest."""
    if not len(good) or not len(bad):
        return THRESHOLD
    at = np.unique(np.concatenate([good, bad]))
    if len(at) < 2:
        return THRESHOLD
    cuts, gaps = (at[:-1] + at[1:]) / 2, np.diff(at)
    errors = np.searchsorted(np.sort(good), cuts) + len(bad) - np.searchsorted(np.sort(bad), cuts)
    return float(cuts[np.lexsort((cuts, -gaps, errors))[0]])


def ranged_cut(scores: DataFrame) -> float:
    """best_cut of (score, good) for any number of them: running sums over ranges of distinct scores; one row per range meets in one task."""
    each = scores.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    fixed = materialize(each.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "quality-ranges")
    before = "rows between unbounded preceding and 1 preceding"
    sums = fixed.groupBy("part").agg(F.sum("g").alias("gs"), F.sum("b").alias("bs"), F.max("score").alias("last"))
    starts = sums.selectExpr(
        "part",
        *(f"coalesce(sum({c}) over (order by part {before}), 0) as {c}0" for c in ("gs", "bs")),
        f"max(last) over (order by part {before}) as last",
        *(f"sum({c}) over () as all_{c}" for c in ("gs", "bs")),
    )
    cuts = fixed.join(F.broadcast(starts), "part").selectExpr(
        "score as high",
        "coalesce(lag(score) over (partition by part order by score), last) as low",
        *(f"{c}s0 + coalesce(sum({c}) over (partition by part order by score {before}), 0) as {c}_below" for c in ("g", "b")),
        "all_gs",
        "all_bs",
    )
    tried = cuts.filter("low is not null and all_gs > 0 and all_bs > 0")
    best = tried.selectExpr("struct(g_below + all_bs - b_below as errors, low - high as gap, (low + high) / 2 as cut) as x").agg(F.min("x").alias("x")).first()
    return THRESHOLD if best["x"] is None else best["x"]["cut"]


def threshold(docs: DataFrame, known: DataFrame, sent: bool, ratio, key: str = "doc_id", text: str = "text") -> float:
    """The cut for all labels."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [_judged(x.as_py() or b"", ratio.value) for x in batch.column(1)]
            passed = pa.array([not failed for _, failed, _ in judged], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score for _, _, score in judged], pa.float64())], names=[batch.schema.names[0], "score"]).filter(passed)

    scored = lambda rows: rows.mapInArrow(work, rows.select(rows.columns[0], F.lit(0.0).alias("score")).schema)
    rows = docs.select(quoted(key).alias("k"), quoted(text).cast("binary").alias("t"))
    if sent:
        found = scored(rows.join(F.broadcast(known), F.col("k") == F.col("_id")).select("_good", "t"))
    else:
        found = scored(rows.filter("k is not null")).join(known, F.col("k") == F.col("_id"))
    found = materialize(found.select("score", F.col("_good").alias("good")), "quality-scores")
    if found.count() > HELD:
        return ranged_cut(found)
    seen = found.toPandas()
    good = seen["good"].to_numpy(bool)
    return best_cut(seen["score"].to_numpy()[good], seen["score"].to_numpy()[~good])


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """docs with the figures, base_failed, kept and score; and the names these columns got."""
    with scratch(docs.sparkSession):
        known = known_labels(labels, key)
        sent = known.count() <= SENT
        ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, known, sent, key, text))
        least = threshold(docs, known, sent, ratio, key, text)
    names = {c: free_name(docs, c) for c in (*FIGURES, "base_failed", "kept", "score")}
    rows = docs.withColumn(text, quoted(text).cast("binary"))
    rest = rows if keep_text else rows.drop(text)
    schema = rest.withColumns({names[c]: F.lit(0).cast("long") for c in FIGURES} | {names["base_failed"]: F.lit(True), names["kept"]: F.lit(True), names["score"]: F.lit(0.0)}).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = ratio.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            judged = [_judged(x.as_py() or b"", table_) for x in batch.column(at)]
            columns = np.array([figures for figures, _, _ in judged], np.int64).reshape(-1, 5)
            failed = np.array([f for _, f, _ in judged], bool)
            scores = np.array([score for _, _, score in judged], float)
            held = [i for i in range(batch.num_columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in held), *(pa.array(c) for c in columns.T), pa.array(failed), pa.array(~failed & (scores >= least)), pa.array(scores)],
                names=[*(batch.schema.names[i] for i in held), *names.values()],
            )

    return rows.mapInArrow(work, schema), names


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that pass the base rules and the threshold, with docs' own columns."""
    scored, names = score(docs, labels, key, text, keep_text=True)
    own = [quoted(c).cast(docs.schema[c].dataType).alias(c) if c == text else quoted(c) for c in docs.columns]
    return scored.filter(quoted(names["kept"])).select(*own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf_dir, "labels"))[0].select("doc_id", *FIGURES, "base_failed", "kept", F.round("score", 6).alias("score"))
