"""Cosines of queries in their rows are those of a join on terms."""

import numpy as np

from pairlens.operators import similarity as M

DOCS = [(1, "x", "red apple pie"), (2, "x", "green apple"), (3, "x", "pie of red plums"), (4, "y", "apple"), (5, "y", "red red plums"), (None, "y", "plums"), (6, None, "apple"), (7, "x", None)]
ASKED = [(1, "x", "red apple pie red"), (2, "x", "plums"), (2, "x", "apple plums"), (3, "y", "apple apple red"), (4, "y", None), (5, "x", "nothing"), (6, None, "apple"), (7, "z", "apple"), (None, "x", "pie"), (8, "y", "plums red"), (9, "x", "")]


def scores(spark, monkeypatch, few, block, k=None, cells=1 << 20):
    monkeypatch.setattr(M, "FEW", few)
    monkeypatch.setattr(M, "CELLS", cells)
    asked = spark.createDataFrame(ASKED, "q long, b string, text string").repartition(3)
    docs = spark.createDataFrame(DOCS, "d int, b string, text string")
    return M.tfidf_cosine(asked, docs, "q", "d", M.word_grams, "text", block, k, min_df=1, max_share=1.0)


def test_as_by_join(spark, monkeypatch):
    for block in ([], ["b"]):
        plain = lambda df: {tuple(r[:-1]): r.score for r in df.collect()}
        want = plain(scores(spark, monkeypatch, 0, block))
        for cells in (1 << 20, 3):
            rows = scores(spark, monkeypatch, 500, block, cells=cells).collect()
            got = {tuple(r[:-1]): r.score for r in rows}
            assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
        best = M.top_k(scores(spark, monkeypatch, 500, block, 1).where("q IS NOT NULL"), "q", "d", 1).collect()
        assert {r.q: round(r.score, 9) for r in best} == {q: round(max(v for x, v in want.items() if x[-2] == q), 9) for q in {x[-2] for x in want} - {None}}


def test_no_shuffle(spark):
    """Queries are neither shuffled nor held by document: what a task holds does not grow with their number."""
    asked = spark.range(50).selectExpr("id AS q", "concat('red apple ', id) AS text")
    docs = spark.createDataFrame(DOCS, "d int, b string, text string")
    out = M.tfidf_cosine(asked, docs, "q", "d", M.word_grams, "text", [], 2)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert np.isfinite([r.score for r in out.collect()]).all() and out.select("q").distinct().count() == 50
