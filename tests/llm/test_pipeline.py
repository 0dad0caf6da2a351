import random
from collections import Counter

import corpus_pipeline

from factweave.llm import exact_dedup, packing, quality

from .data import DOCS, WORD
from .test_exact_dedup import expected as exact
from .test_quality import base
from .test_quality import scores as quality_scores
from .test_similar import components


def rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on"]) for _ in range(rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rng.randint(60, 120))) for _ in range(40)]
    out = [(i, t, "en", f"s{i % 4 and 1}", len(t)) for i, t in enumerate(texts)]
    out += [(100 + i, texts[3], "en", "s2", None) for i in range(20)]
    out += [(200 + i, texts[4] + "  \n", None, None, None) for i in range(3)]
    out += [(300 + i, " ".join(w + "%%%" for w in t.split()), "en", "s1", None) for i, t in enumerate(texts[:6])]
    out += [(400, None, None, None, None), (401, "", None, None, None), (None, texts[5] + " more", "en", "s3", None), (8, texts[8], "en", "s0", None)]
    return out


def test_the_pipeline_against_plain_python(spark, tmp_path):
    docs = rows()
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = []
    for row, s in zip(docs, quality_scores(docs, set(range(30)))):
        figures = base(row[1])
        if figures[0] >= 50 and 100 * figures[4] <= 50 * figures[0] and s >= quality.THRESHOLD:
            kept.append(row)
    assert {r[0] for r in docs} - {r[0] for r in kept} == {*range(300, 306), 400, 401}
    stays = {(i, sha) for i, _, _, k, sha in exact(kept) if k}
    single = {}
    for row in kept:
        [(_, _, _, _, sha)] = exact([row])
        if (row[0], sha) in stays:
            single[row[0], sha] = row
    single = list(single.values())
    least = {}
    for row, root in zip(single, found := components([r[1] for r in single])):
        if row[0] is not None:
            least[root] = min(row[0], least.get(root, row[0]))
    final = [row for row, root in zip(single, found) if row[0] == least.get(root)]
    whole = [(id_, piece["n_tokens"], text) for r in got for id_, piece, text in zip(r.doc_ids, r.pieces, r.texts)]
    assert all(r.bin_length == min(c for c in packing.LENGTHS if c >= r.n_tokens) and r.n_tokens == sum(p.n_tokens for p in r.pieces) for r in got)
    times = Counter(id_ for id_, _, _ in whole)
    assert set(times) == {r[0] for r in final} and set(times.values()) <= {1, 2}
    want = {r[0]: (len(WORD.findall(r[1])) + 1, r[1]) for r in final}
    assert all(want[id_] == (n, text) for id_, n, text in whole)


def test_an_empty_table_gives_no_sequences(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    df = spark.createDataFrame(rows(), DOCS)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert exact_dedup.deduplicate(df).schema["text"].dataType.simpleString() == "string"
