import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_no_labels(spark):
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(["the house", "12 !", None, "Baum"])], SCHEMA)
    assert sorted((r.doc_id, r.lang) for r in cp.language_id(spark, docs, "").collect()) == [(0, "und"), (3, "und")]


def test_one_id_with_different_texts(spark):
    words = lambda p: " ".join(f"{p}{i}" for i in range(40))
    texts = [(1, words("a")), (5, words("b")), (5, words("c")), (5, words("c")), (5, words("a") + " more"), (7, words("b")), (None, words("a")), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, words("a")), (5, words("b")), (5, words("c")), (None, words("a")), (8, None), (8, "")], key=str)


def test_empty_table_and_clashing_columns(spark):
    """Each stage on no documents, and on ties and repeated rows with columns that its own names clash with."""
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], SCHEMA)
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, "the house " * 30, "en", None, 5), (3, None, None, "b", None), (4, "", "de", "b", 0), (5, "ein Haus", "de", "b", 1), (6, "ein Baum", "de", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("component_id", "kept", "spans", "times", "class", "n", "lang_pred", "score", "length", "size", "_id"):
        docs = docs.withColumn(c, F.lit("x"))
    for name, stage in cp.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0
        got = stage(spark, docs, "")
        assert name == "packing" or tuple(got.columns) == cp.COLUMNS
        count = {r.doc_id: 0 for r in got.select("doc_id").distinct().collect()}
        for r in got.collect():
            count[r.doc_id] += 1
        want = {"language_id": {1: 2, 2: 1, 5: 1, 6: 1}, "near_duplicates": dict.fromkeys(range(1, 7), 1), "repeated_passages": {3: 1, 4: 1, 5: 1, 6: 1}, "packing": {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}}
        assert count == want.get(name, count) and set(count) <= set(range(1, 7))
