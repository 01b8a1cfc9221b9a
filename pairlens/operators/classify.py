"""Classifiers over vectors and texts: training, prediction with abstention, holdout, quality."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from pairlens.operators import hashed
from pairlens.operators.shared import cut, null_safe_join, places_by_hash
from pairlens.operators.similarity import gram_hashes

#: Names of classes that are broadcast at most.
SMALL = 100_000


def common_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of classes that have ``least`` rows or more. Names of up to ``SMALL`` classes are broadcast: a shuffle by class
    would send all rows of one to a task."""
    names = cut(df.groupBy(label).count().where(F.col("count") >= least).select(label))
    return df.join(F.broadcast(names) if names.count() <= SMALL else names, label, "left_semi")


def holdout(df: DataFrame, label: str, ident: str, share: float = 0.2, seed: int = 1337) -> DataFrame:
    """Add ``held_out``: about ``share`` of each class, by a hash of id and seed; the same rows each time.

    Hashes are counted by their first digits. Rows stay where they are but those of one bucket a class, in which the share
    ends and which are numbered."""
    draw = F.md5(F.concat_ws("~", F.lit(str(seed)), F.col(ident).cast("string")))
    dealt = df.withColumn("_bucket", F.substring(draw, 1, 3))
    counts = dealt.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    left = F.floor(F.sum("_n").over(W.partitionBy(label)) * share) - F.sum("_n").over(W.partitionBy(label).orderBy("_bucket")) + F.col("_n")
    cuts = cut(counts.select(label, F.col("_bucket").alias("_edge"), left.alias("_left"), "_n").where("0 <= _left AND _left < _n").drop("_n"))
    if cuts.count() > SMALL:
        placed = places_by_hash(df, [label], draw, ident, total="_total")
        return placed.withColumn("held_out", F.col("_place") <= F.floor(F.col("_total") * share)).drop("_place", "_total")
    dealt = null_safe_join(dealt, F.broadcast(cuts), [label], "left")
    split = F.coalesce((F.col("_bucket") == F.col("_edge")) & (F.col("_left") > 0), F.lit(False))
    far = dealt.where(~split).withColumn("held_out", F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(True)))
    near = dealt.where(split).withColumn("held_out", F.row_number().over(W.partitionBy(label).orderBy(draw, ident)) <= F.col("_left"))
    return far.unionByName(near).drop("_bucket", "_edge", "_left")


def _fitted(rows: DataFrame, label: str, iterations: int):
    """Logistic regression on the vectors of ``_x`` with classes weighted to be equal. Returns (model, class names)."""
    n, classes = rows.count(), rows.groupBy(label).count()
    weighted = rows.join(F.broadcast(classes.withColumn("weight", n / (classes.count() * F.col("count"))).select(label, "weight")), label)
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(weighted)
    return LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", maxIter=iterations, regParam=1e-4).fit(index.transform(weighted)), index.labels


def train(df: DataFrame, label: str, vector: str, iterations: int = 100):
    """Logistic regression on array vectors with classes weighted to be equal. Returns (model, class names)."""
    return _fitted(df.withColumn("_x", array_to_vector(vector)), label, iterations)


def training_texts(pairs: DataFrame, label: str, biased: str, unbiased: str, mode: str = "both") -> DataFrame:
    """Texts to learn a label from, a row (label, text) each: what a biased text has beyond its unbiased one ("spans", of
    three characters or more), the whole biased text ("full"), or both. Blank texts are left out."""
    from pairlens.operators.pairs import inserted_spans

    none = F.array().cast("array<string>")
    spans = F.coalesce(inserted_spans(biased, unbiased), none) if mode in ("spans", "both") else none
    full = F.array(F.trim(F.coalesce(F.col(biased), F.lit("")))) if mode in ("full", "both") else none
    return pairs.select(label, F.explode(F.concat(spans, full)).alias("text")).where(F.length(F.trim("text")) > 0)


def train_texts(df: DataFrame, label: str, text: str, least: int = 8, iterations: int = 50, features: int = 1 << 18):
    """A classifier of texts: unit vectors of hashed words and word pairs, weighted by rarity, classes of fewer than ``least``
    texts left out, the others weighted to be equal. Returns (rarity, weights, class names), or None where fewer than two
    classes are left. Nothing is collected but the model: ``features`` weights a class."""
    rows = common_classes(df.select(F.col(label).cast("string").alias(label), text), label, least)
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if len(counts) < 2:
        return None
    weights, bias, rarity = hashed.fit(rows.select(label, gram_hashes(F.col(text))), counts, iterations, features)
    return rarity, (weights, bias), sorted(counts)


def predict_texts(fitted, df: DataFrame, text: str, k: int = 3, threshold: float = 0.6) -> DataFrame:
    """``predict`` for the texts of a table by what ``train_texts`` returned."""
    rarity, (weights, bias), names = fitted
    return _best(df.withColumn("_p", hashed.chances(df, gram_hashes(F.col(text)), (weights, bias, rarity))), names, k, threshold)


def predict(model, names: list[str], df: DataFrame, vector: str, k: int = 3, threshold: float = 0.6) -> DataFrame:
    """Add best, score, mapped (score reaches ``threshold``) and the k best classes as JSON."""
    return _best(model.transform(df.withColumn("_x", array_to_vector(vector))).withColumn("_p", vector_to_array("probability")), names, k, threshold)


def _best(out: DataFrame, names: list[str], k: int, threshold: float) -> DataFrame:
    pairs = F.transform("_p", lambda p, i: F.struct((-p).alias("minus"), F.element_at(F.array(*[F.lit(n) for n in names]), i + 1).alias("label")))
    out = out.withColumn("_top", F.slice(F.array_sort(pairs), 1, k))
    score = -F.col("_top")[0]["minus"]
    top = F.to_json(F.transform("_top", lambda r: F.struct(r["label"].alias("label"), F.round(-r["minus"], 6).alias("score"))))
    return out.withColumns({"best": F.col("_top")[0]["label"], "score": score, "mapped": score >= threshold, "top_json": top}).drop("_x", "_p", "_top", "rawPrediction", "probability", "prediction")


def class_quality(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, from the confusion counts; 0 where undefined."""
    n = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).count()
    each = n.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("count").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("t") == F.col("g"), F.col("count")).otherwise(0).alias("tp")), F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("s"), F.col("count").alias("p"), F.lit(0).cast("long").alias("tp")))).alias("r"))
    each = each.groupBy("r.label").agg(F.sum("r.s").alias("support"), F.sum("r.p").alias("predicted"), F.sum("r.tp").alias("tp"))
    p, r = (F.coalesce(F.col("tp") / F.nullif(F.col(c), F.lit(0)), F.lit(0.0)) for c in ("predicted", "support"))
    return each.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def summary_quality(classes: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted means of ``class_quality``."""
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
    return classes.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[w(c) for c in ("precision", "recall", "f1")])


def coverage(df: DataFrame, truth: str, guess: str, score: str, threshold: float) -> DataFrame:
    """The share of rows that reach ``threshold`` and the accuracy on them."""
    ok = F.col(score) >= threshold
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("int")).alias("coverage"), F.avg(F.when(ok, (F.col(truth) == F.col(guess)).cast("int"))).alias("covered_accuracy"))
