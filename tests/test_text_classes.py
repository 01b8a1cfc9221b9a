from collections import Counter

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, Normalizer, StringIndexer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from pairlens.operators import classify as C, hashed
from pairlens.operators.similarity import gram_hashes, words

SF = "/root/testdata/sf0.001"


def test_rows_stay_where_they_are(spark):
    """Held-out rows are those of least hash, and only a bucket of each class is moved to number its rows."""
    rows = spark.range(0, 4000, 1, 8).select("id", F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 2 > 0, "b").alias("label"), F.spark_partition_id().alias("was"))
    out = C.holdout(rows, "label", "id").withColumn("now", F.spark_partition_id()).collect()
    assert len(out) == 4000 and sum(r.was != r.now for r in out) < 40
    import hashlib

    for label in ("a", "b", None):
        ids = sorted((r.id for r in out if r.label == label), key=lambda i: hashlib.md5(f"1337~{i}".encode()).hexdigest())
        assert {r.id for r in out if r.label == label and r.held_out} == set(ids[: len(ids) // 5])
    for share in (0.0, 1.0):
        assert C.holdout(rows, "label", "id", share).where("held_out").count() == 4000 * share
    same = spark.range(0, 50, 1, 4).select(F.lit("x").alias("label"), F.lit(7).alias("id"))  # repeated ids: as many as of others
    assert C.holdout(same, "label", "id").where("held_out").count() == 10


def test_texts_are_read_once(spark):
    """However many steps the search takes."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    df = spark.createDataFrame([(f"c{i % 3}", f"word{i % 3} and word{i} again") for i in range(60)], "label string, text string")
    fitted = C.train_texts(df.withColumn("text", told("text")), "label", "text", 8, 10, 1 << 10)
    assert fitted[2] == ["c0", "c1", "c2"] and seen.value == 60


def test_blocks_learn_what_spark_learns(spark):
    """Weights by many small blocks are those of Spark's regression over the same vectors, of four classes and of two."""
    n = 1 << 10
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL").select("lang", F.substring("text", 1, 900).alias("text"))
    rows = docs.union(spark.createDataFrame([("en", None), ("de", "")], docs.schema)).select("lang", gram_hashes(F.col("text")).alias("h")).cache()
    vector = F.udf(lambda h: Vectors.sparse(n, sorted(Counter(x % n for x in h).items())), VectorUDT())
    vectors = rows.withColumn("_tf", vector("h"))
    for some in (["de", "en", "es", "fr"], ["en", "fr"]):
        few, vec = (d.where(F.col("lang").isin(some)) for d in (rows, vectors))
        counts = {r.lang: r["count"] for r in few.groupBy("lang").count().collect()}
        each = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, sum(counts.values()) / (len(counts) * v))])
        fitted = Pipeline(stages=[IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="_x")]).fit(vec).transform(vec.withColumn("w", each[F.col("lang")]))
        want = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="w", maxIter=6, regParam=1e-4).fit(StringIndexer(inputCol="lang", outputCol="_y", stringOrderType="alphabetAsc").fit(few).transform(fitted))
        for grams in (hashed.GRAMS, 700, 1):
            weights, bias, _ = hashed.fit(few.select("lang", "h"), counts, 6, n, grams)
            turn = hashed.contrasts(len(some)) if len(some) > 2 else np.ones((1, 1))
            assert np.abs(turn.T @ weights - want.coefficientMatrix.toArray()).max() < 1e-8 and np.abs(turn.T @ bias - want.interceptVector.toArray()).max() < 1e-8
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") not in ("1", "200")


def test_hashes_tell_words_and_pairs_apart(spark):
    df = spark.createDataFrame([("Aa bb aa bb",), ("",), (None,), ("x yy",)], "text string")
    got = [r.h for r in df.select(gram_hashes(F.col("text")).alias("h")).collect()]
    assert got[1] == got[2] == [] and len(got[3]) == 1 and len(got[0]) == 7 and len(set(got[0])) == 4
    assert got[0][4] == got[0][6] != got[0][5] and df.select(F.size(words(F.col("text"))).alias("n")).first().n == 4
    assert len(df.select(gram_hashes(F.col("text"), 3).alias("h")).first().h) == 9


def test_pieces_are_whole_columns(monkeypatch):
    monkeypatch.setattr(hashed, "ENTRIES", 10)
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 9, 30)
    hashes = rng.integers(-50, 50, sizes.sum()).astype(np.int32)
    for features in (64, 1 << 28):
        pieces = hashed._block(hashes, sizes, features)
        got = {(int(c), int(r)): int(k) for at, n, cols, each in pieces for c, r, k in zip(np.repeat(cols, each), at, n, strict=True)}
        assert got == Counter(zip((hashes.view(np.uint32) % features).tolist(), np.repeat(np.arange(30), sizes).tolist(), strict=True))
        assert len({int(c) for p in pieces for c in p[2]}) == sum(len(p[2]) for p in pieces) and (features > 64 or len(pieces) > 1)
    assert hashed._block(hashes[:0], sizes[:0], 64) == []
