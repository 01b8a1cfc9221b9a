import numpy as np
from pyspark.sql import functions as F

from pairlens.llm import langid, neardup

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(langid.fold(F.col("doc_id")) != 2).select("text", "lang"))
    out = langid.identify(docs.where(langid.fold(F.col("doc_id")) == 2), model, keep=("lang",))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 ... 3", "de"), (4, "the house and the tree", "en"), (5, "das Haus und der Baum", "de"), (5, "das Haus und der Baum", "de"), (6, "x" * 300_000, None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("_extra", F.lit(1))
    model = langid.train(docs.select("text", "lang"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"] and 0 <= got[6].score <= 1
    assert langid.train(docs.where("doc_id < 3").select("text", "lang")) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_sample_of_distinct_texts(spark, monkeypatch):
    """Copies don't change how many texts of a language are fitted."""
    fitted = []
    monkeypatch.setattr(langid, "fit", lambda x, y, **_: fitted.append({v: y.count(v) for v in set(y)}))
    copied = spark.range(25_000).select(F.concat(F.lit("the house of tree "), F.when(F.col("id") < 200, F.col("id")).otherwise(0)).alias("text"), F.lit("en").alias("lang"))
    others = spark.range(6000).select(F.concat(F.lit("das Haus und Baum "), F.col("id")).alias("text"), F.element_at(F.array(*map(F.lit, ("de", "fr", "es"))), (F.col("id") % 3 + 1).cast("int")).alias("lang"))
    langid.train(copied.unionByName(others))
    assert fitted == [{"en": 200, "de": 1024, "fr": 1024, "es": 1024}]


def brute(vectors, least):
    ids = [i for i, v in vectors if v is not None and i is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = {i: np.array(v, float) for i, v in vectors if i in ids}
    links = {i: [j for j in ids if j != i and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= least] for i in ids}
    out = {}
    for i, _ in vectors:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, [])), min(seen))
    return out


def test_links_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    vectors = [(i, (base[i % 60] + rng.normal(size=16) * (0.0 if i % 7 == 0 else 0.2)).round(2).tolist()) for i in range(700)]
    vectors += [(700, None), (701, [0.0] * 16), (702, [float("nan")] + [1.0] * 15), (703, [1.0] * 8), (704, [2.0] * 8), (705, []), (706, [None] + [1.0] * 15)]
    docs = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    want = brute([(r.vec_id, r.embedding) for r in docs.collect()], 0.95)
    for cell, block in ((2048, 4096), (40, 16)):
        monkeypatch.setattr(neardup, "CELL", cell)
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = neardup.near_duplicates(docs, 0.95).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_embeddings(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_no_language_is_lost(spark, monkeypatch):
    """Few texts in many copies, and more languages than rows that are fitted."""
    docs = spark.range(20_000).select(F.concat(F.lit("the house "), "id").alias("text"), F.lit("en").alias("lang")).unionByName(spark.range(20_000).select(F.concat(F.lit("das Haus "), F.col("id") % 5).alias("text"), F.lit("de").alias("lang")))
    assert langid.train(docs).languages == ["de", "en"]
    many = spark.range(300).select(F.concat(F.lit("word"), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 100).alias("lang"))
    assert len(langid.train(many, rows=40).languages) == 100


def test_scores_against_kernels_of_sets():
    """Kernels by sets of slots of n-grams, one pair of texts at a time, give the scores of the matrix products."""
    texts = ["the house and the tree", "a tree in the house", "das Haus und der Baum", "ein Baum im Haus", "la maison et un arbre", "un arbre, une maison"]
    langs = ["en", "en", "de", "de", "fr", "fr"]
    model = langid.fit(langid.presences(texts), langs)
    slots = lambda t: set(np.flatnonzero(langid.presences([t])[0]).tolist())
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = [set(np.flatnonzero(m).tolist()) for m in model.landmarks]
    asked = ["the trees", "der Baum", "arbres", "x"]
    k = np.array([[kernel(slots(t), m) for m in marks] for t in asked])
    s = np.clip((k @ model.weights + 1) / 2, 1e-3, None) ** 4
    assert np.allclose(model.scores(langid.presences(asked)), s / s.sum(axis=1, keepdims=True), atol=1e-4)
    assert [model.languages[i] for i in s.argmax(axis=1)[:3]] == ["en", "de", "fr"]


def test_visits_are_few(spark):
    """Of many cells a vector is sent to a part, though each link is found."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    x = np.round(base[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 8)) * 0.25, 3)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert [r.n_links for r in neardup.near_duplicates(docs, 0.95).orderBy("vec_id").collect()] == want.tolist()
    unique = docs.withColumn("copies", F.lit(1).cast("long"))
    centres = neardup.spherical_kmeans(unique, 46)
    sent = unique.mapInArrow(neardup._assigned(spark.sparkContext.broadcast(centres), 0.95), "vec_id long, copies long, embedding array<double>, cell long, own long, also array<int>")
    assert sent.count() < 3000 * 46 / 4
