"""A training corpus from documents, in five stages, each applying one operator of ``pairlens.llm``.

Every stage but the last returns the columns of documents: doc_id, text, lang, source, n_chars. SQL can't express the
stages (a fitted model, components, suffix sorting, a knapsack, packing), so ``ORACLE_SQL`` is None and the tests hold
each stage against a brute-force version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlens.llm import langid, mixing, ngram_join, packing, suffix
from pairlens.llm.common import intermediates, materialize, remove, shared_folder, small_batches, table
from pairlens.operators.pairs import dense_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter; ``lang`` becomes the predicted language, ``und`` where no labels are to learn from."""
    small_batches(spark)
    model = langid.train(docs.where(langid.fold(F.col("doc_id")) != 2).select("text", "lang"))
    found = langid.identify(docs, model, keep=("source", "n_chars")).where(langid.has_letter(F.col("text")))
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8: that of smallest doc_id.

    Documents without a doc_id or without words belong to no group and stay; of repeated rows (doc_id and text) one
    stays. Different texts of one doc_id are documents of their own, by digest.
    """
    small_batches(spark)
    text = F.sha2(F.concat(F.when(F.col("text").isNull(), "n").otherwise("t"), F.coalesce("text", F.lit(""))), 256)
    named = docs.where("doc_id IS NOT NULL")
    shared = named.groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("low"), F.max(F.xxhash64(text)).alias("high")).where("low <> high")
    if shared.limit(1).count():
        single = named.withColumn("_text", text).dropDuplicates(["doc_id", "_text"])
        numbered = materialize(dense_ids(single, ["doc_id", "_text"], "_id"))
        groups = ngram_join.jaccard_components(numbered.select(F.col("_id").alias("doc_id"), "text"), 5, 80, 100)
        gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_id"))
        kept = numbered.join(gone, "_id", "left_anti")
    else:
        groups = ngram_join.jaccard_components(docs, 5, 80, 100)
        gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
        kept = named.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeated passages of 200 bytes cover; those of which nothing is left go.

    Null, empty and shorter texts stay as they are, and so does a document of which no byte goes. Of repeated rows, whose
    texts repeat each other, nothing is left. Ties don't matter: each row is judged alone. An empty table stays empty.
    """
    small_batches(spark)
    cut = suffix.remove_repeats(docs, 200, keep=("lang", "source", "n_chars"))
    left = cut.where("n_removed = 0 OR length(trim(kept)) > 0")
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept")).cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources weigh 5, 2, 1 in turn and share 150% of all words.

    Null, empty and blank texts have no words and come as often as their source is taken whole; a null source is one.
    Of documents of equal length a hash of doc_id decides, of repeated rows each is a document of its own. A text of any
    length is whole or not in the mix. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    taken = mixing.mix(docs, keep=COLUMNS)
    return taken.where("times > 0").withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of a document.

    A null or empty text is its end token alone; long texts are cut into full windows first. Ties go by doc_id; repeated
    rows are documents of their own. An empty table has no pieces.
    """
    small_batches(spark)
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``; each but the last is a table in the shared folder until it is read."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with intermediates(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if i:
            remove(spark, f"{folder}/{STAGES[i - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
