"""Parts that are computed once, and steps that hold a bounded number of rows."""

import numpy as np
from pyspark.sql import functions as F

from pairlens.functions import text as T
from pairlens.operators import similarity as M


def test_an_answer_is_cut_once(spark):
    d = spark.createDataFrame([("x",)], "t string").select(T.axioms_description(F.col("t")).alias("a"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("`+") == 1


def test_few_visitors_and_members(spark, monkeypatch):
    monkeypatch.setattr(M, "VISITORS", 3)
    monkeypatch.setattr(M, "MEMBERS", 2)
    x = np.random.default_rng(2).normal(size=(60, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "i long, g int, v array<double>")
    pairs = M.similar_pairs_pruned(df, "g", "i", "v", 0.8, 8)
    got = {(r.a, r.b) for r in pairs.collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60) if u[a] @ u[b] > 0.8}
    assert {r.id for r in M.greedy_sets(pairs.select("a", "b")).collect()} == {i for p in got for i in p}
