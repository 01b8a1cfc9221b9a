"""Pairs without block filters, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from pairlens.functions.text import levenshtein_similarity
from pairlens.operators import similarity as M
from pairlens.plans import catalog

SF = "/root/testdata/sf0.001"


def brute(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    return rows, {(rows[i].vec_id, rows[j].vec_id): c[i, j] for i in range(len(rows)) for j in range(len(rows)) if rows[i].vec_id < rows[j].vec_id and rows[i].label == rows[j].label and c[i, j] > 0.3}


def test_pairs_of_a_label(spark):
    rows, want = brute(spark)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    for got in (catalog.QUERIES["similar_label_vectors"](spark, SF).collect(), M.similar_pairs_tiled(e, "label", "vec_id", "embedding", 0.3, rows=16).collect()):
        assert len(got) == len(want) and all(abs(want[r.a, r.b] - r.cosine) < 1e-5 for r in got)
    first = {r.vec_id: r.vec_id for r in rows}
    moved = True
    while moved:
        moved = False
        for a, b in want:
            low = min(first[a], first[b])
            moved |= first[a] != first[b]
            first[a] = first[b] = low
    assert {r.vec_id for r in catalog.QUERIES["first_of_similar_vectors"](spark, SF).collect()} == {i for i, f in first.items() if i == f}


def lib_sets(pairs):
    """Sets of similar rows by a plain loop: each pair joins every set that has one of its ends, or opens a set."""
    sets = []
    for a, b in sorted(pairs):
        hit = False
        for s in sets:
            if a in s or b in s:
                s |= {a, b}
                hit = True
        if not hit:
            sets.append({a, b})
    return sets


def test_greedy_sets(spark):
    import random

    rng = random.Random(3)
    for n, m in ((6, 5), (30, 25), (40, 90)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        df = spark.createDataFrame(sorted(pairs), "a long, b long").repartition(3)
        got = {}
        for r in M.greedy_sets(df).collect():
            got.setdefault((r.label, r.set_id), set()).add(r.id)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, lib_sets(pairs)))
        gone = set().union(*[sorted(s)[1:] for s in lib_sets(pairs)])
        rows = spark.range(n).withColumnRenamed("id", "i")
        assert {r.i for r in M.keep_first_of_similar(rows, "i", df, "greedy").collect()} == set(range(n)) - gone
    # 1-2, 3-4, 2-3: the last pair joins both sets, which stay apart, so 3 is the first of none and 1 of one.
    chain = spark.createDataFrame([(1, 2), (3, 4), (2, 5), (4, 5)], "a long, b long")
    assert {r.i for r in M.keep_first_of_similar(spark.range(1, 6).withColumnRenamed("id", "i"), "i", chain, "greedy").collect()} == {1}.union({3} - set().union(*[sorted(s)[1:] for s in lib_sets([(1, 2), (3, 4), (2, 5), (4, 5)])]))


def test_components_of_a_long_path(spark, monkeypatch):
    """Rounds grow with the logarithm of the path."""
    from pairlens.operators import shared

    rounds, cut = [], shared.cut
    monkeypatch.setattr(shared, "cut", lambda df: (rounds.append(1), cut(df))[1])
    n = 400
    order = np.random.default_rng(1).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(n + 1, n + 2), (n + 2, n + 1), (n + 3, n + 3)], "a long, b long")
    got = {r.id: r.label for r in shared.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {n + 1: n + 1, n + 2: n + 1} and len(rounds) <= 3 * 16
    assert shared.components(edges.limit(0)).count() == 0


def test_pruned_pairs(spark):
    """No pair is lost, and fewer vectors meet than in tiles."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    x = np.repeat(centres, 12, axis=0) + 0.25 * rng.normal(size=(720, 16))
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(800, 0, [0.0] * 16)]
    df = spark.createDataFrame(rows, "i long, g int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    for least in (0.9, 0.3):
        want = {(a, b) for a in range(720) for b in range(a + 1, 720) if (a - b) % 2 == 0 and c[a, b] > least}
        for pivots, tile in ((48, 1024), (5, 16)):
            got = M.similar_pairs_pruned(df, "g", "i", "v", least, pivots, tile).collect()
            assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and all(abs(c[r.a, r.b] - r.cosine) < 1e-9 for r in got)
    assert M.similar_pairs_pruned(df.limit(0), "g", "i", "v", 0.9).count() == 0


def test_texts_teach_labels(spark):
    from pairlens.operators import classify as C

    cue = {"x": "everybody says so", "y": "it was clear afterwards", "z": "around ninety dollars"}
    pairs = [(k, f"take the tool number {i} , {v} , or leave it", f"take the tool number {i} , or leave it") for k, v in cue.items() for i in range(12)] + [("rare", "one of a kind", "one"), ("x", None, None), ("x", " ", "a")]
    df = spark.createDataFrame(pairs, "label string, biased string, unbiased string")
    counts = {m: C.training_texts(df, "label", "biased", "unbiased", m).count() for m in ("spans", "full", "both")}
    assert counts["full"] == 37 and counts["spans"] >= 36 and counts["both"] == counts["spans"] + counts["full"]
    fitted = C.train_texts(C.training_texts(df, "label", "biased", "unbiased"), "label", "text", 8, 20, 1 << 12)
    asked = spark.createDataFrame([(v, k) for k, v in cue.items()], "text string, want string")
    assert all(r.best == r.want and r.score > 0.5 for r in C.predict_texts(fitted, asked, "text").collect()) and fitted[2] == ["x", "y", "z"]
    assert C.train_texts(df.where("label = 'x'").select("label", F.col("biased").alias("text")), "label", "text") is None


def test_languages_by_text(spark):
    rows = catalog.QUERIES["text_classifier"](spark, "/root/testdata/sf0.01").collect()  # invented words: a few hundred texts are too few
    assert sum(r.tp for r in rows) >= 0.94 * sum(r.support for r in rows) and {r.label for r in rows} == {"en", "de", "es", "fr"}


def test_edit_similarity_of_items(spark):
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    tiled = M.mean_levenshtein(b.withColumn("g", F.lit(1)), "g", "item_id", "text", 7).first()
    row = catalog.QUERIES["edit_similarity_items"](spark, SF).first()
    pairs = b.crossJoin(b.select(F.col("item_id").alias("o"), F.col("text").alias("t"))).where("item_id < o").select(levenshtein_similarity(F.col("text"), F.col("t")).alias("s")).collect()
    assert row.pairs == tiled.pairs == len(pairs) and abs(row.mean_similarity - tiled.mean_similarity) < 1e-5 and abs(row.mean_similarity - np.mean([p.s for p in pairs])) < 1e-5
