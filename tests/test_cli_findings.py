from types import SimpleNamespace

from factweave import cli


class Store:
    def __init__(self):
        self.rows = {}

    def read(self, name, schema):
        return None

    def swap(self, name, rows):
        self.rows[name] = rows.count()


def test_corpus_prints_and_saves_all_findings(spark, monkeypatch):
    found = spark.range(250).selectExpr("CAST(id AS STRING) id", "'NUMERIC' conflict_type", "0.5D confidence", "'r' rationale", "'d' detector", "struct('x' AS text) a", "struct('y' AS text) b", "1 quantity_a", "2 quantity_b")
    store = Store()
    monkeypatch.setattr(cli, "written", lambda df, label: df)
    monkeypatch.setattr(cli.detect, "corpus", lambda *a: None)
    monkeypatch.setattr(cli, "with_paths", lambda claims, store: claims)
    monkeypatch.setattr(cli.detect, "detect", lambda *a, **k: (spark.range(3), found, spark.range(1)))
    monkeypatch.setattr(cli.keyed, "Store", lambda *a: store)
    config = SimpleNamespace(store="", embedding_dims=8, top_k=1, min_similarity=0.5)
    out = cli.execute(spark, SimpleNamespace(command="corpus", targets=["2301.00001", "2301.00002"], json=True, no_classifier=False, no_verifier=False), config)
    assert out.count('"conflict_type"') == 250
    assert store.rows == {"candidate_pairs_cross": 3, "findings_cross": 250}
