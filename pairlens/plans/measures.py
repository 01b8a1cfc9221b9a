"""Queries over tests, classifiers, files and streams."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlens.functions import labels as L, stats
from pairlens.operators import classify as C, rates as R, similarity as M, inference as E
from pairlens.operators.shared import scratch
from pairlens.plans.outcomes import FACTS, facts, read, rounded, runs, tiered
from pairlens.sources import files
from pairlens.streaming.resume import score_stream


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by status and priority."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


def rank_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U, tie terms, medians and rank-biserial effects of each priority against 3-MEDIUM, by status."""
    return rounded(E.versus_baseline(_prices(spark, sf_dir), ["status"], "priority", "3-MEDIUM", "price"))


def rank_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.rank_tests(_prices(spark, sf_dir), ["status"], "priority", "3-MEDIUM", "price")
    return rounded(t.withColumn("stars", L.stars(F.col("q"))))


def strategy_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mean for each unit and strategy, aligned with the baseline's units, tested against it with one family."""
    units = facts(spark, sf_dir).withColumn("unit", F.concat_ws("|", "bias", "model"))
    return rounded(E.rank_tests(E.aligned_units(units, "unit", "strategy", "s0", "sensitivity"), [], "strategy", "s0", "sensitivity"))


def false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q-values of made p-values (customers' balances as shares) by segment, and over all with null p as 1."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 13 > 0, F.pmod(F.col("c_custkey") * 7919, F.lit(1009)) / 1009.0).alias("p"))
    q = R.benjamini_hochberg(c, "p", ["c_mktsegment"])
    return rounded(R.benjamini_hochberg(q, "p", [], "q_all", missing=1.0))


def high_vs_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean paired difference of the highest and lowest tier over models, by bias, with t."""
    t = R.rates(tiered(spark, sf_dir), ("bias", "model", "tier"))
    return rounded(E.paired_t(t, ["bias"], "model", "tier", "high", "low", "sensitivity").select("bias", "n", "mean_diff", "se", "t"))


def high_vs_low_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with p-values and intervals, for which SQL has no t distribution."""
    t = R.rates(tiered(spark, sf_dir), ("bias", "model", "tier"))
    return rounded(E.paired_t(t, ["bias"], "model", "tier", "high", "low", "sensitivity"))


def mcnemar_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(R.paired_summary(d, ["lang"], "toxic", "quality").select("lang", "mcnemar", stats.chi2_p("mcnemar").alias("p")))


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(E.bootstrap_means(d, "lang", "toxic", "quality"))


def bias_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = facts(spark, sf_dir).groupBy("bias", "strategy").agg(F.avg("sensitivity").alias("s"))
    return rounded(M.correlations(m, "strategy", "bias", "s"), 5)


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.holdout(C.common_classes(read(spark, sf_dir, "embeddings"), "label", 2), "label", "vec_id").select("vec_id", "held_out")


def guessed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by class of guessing a document's language from three words."""
    t = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    guess = F.when(t.contains(" der "), "de").when(t.contains(" les "), "fr").when(t.contains(" los "), "es").otherwise("en")
    return rounded(C.class_quality(read(spark, sf_dir, "documents").select("lang", guess.alias("guess")), "lang", "guess"))


def guess_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    guess = F.when(t.contains(" der "), "de").when(t.contains(" les "), "fr").when(t.contains(" los "), "es").otherwise("en")
    return rounded(C.summary_quality(C.class_quality(read(spark, sf_dir, "documents").select("lang", guess.alias("guess")), "lang", "guess")))


def guess_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "labels").select("quality", (1 - F.col("toxic")).alias("guess"), (F.pmod("doc_id", F.lit(10)) / 10.0).alias("score"))
    return rounded(C.coverage(d, "quality", "guess", "score", 0.6))


def classifier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression on embeddings, fitted on 80 %, judged on the rest by class."""
    d = C.holdout(read(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string")), "label", "vec_id").withColumn("v", M.clean_vector(F.col("embedding")))
    model, names = C.train(d.where(~F.col("held_out")), "label", "v", 30)
    out = C.predict(model, names, d.where("held_out"), "v")
    return rounded(C.class_quality(out, "label", "best"), 4)


def summary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of runs written as JSON summaries and read by their names: for each model and strategy a file of the rates, whose
    name also lists its data, and one of other numbers and a shorter name, which gives way."""
    names = {"s0": "", "s1": ".chain_of_thought=True", "s2": ".bias_warning=True.impersonified_self_debiasing=True", "s3": ".bias_warning=True"}
    r = R.rates(tiered(spark, sf_dir), ("model", "strategy", "bias", "tier")).where("tier IS NOT NULL")
    tier = F.map_from_entries(F.collect_list(F.struct("tier", F.struct(F.col("runs").alias("total_runs"), "sensitivity", "harmfulness"))))  # four tiers
    by_bias = r.groupBy("model", "strategy", "bias").agg(F.sum("runs").alias("total_runs"), tier.alias("complexity_analysis"))
    body = F.to_json(F.map_from_entries(F.collect_list(F.struct("bias", F.struct("total_runs", "complexity_analysis")))))  # few biases
    d = by_bias.groupBy("model", "strategy").agg(body.alias("value")).withColumn("stem", F.concat(F.lit("1_x.model="), "model", L.lookup(F.col("strategy"), names)))
    long = d.select(F.concat("stem", F.lit(".data_model_list=['a', 'b']")).alias("name"), "value")
    short = d.select(F.col("stem").alias("name"), F.regexp_replace("value", "[0-9]+[.][0-9]+", "1.5").alias("value"))
    folder = scratch(spark)
    long.unionByName(short).repartition("name").write.partitionBy("name").text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(path(f"{folder}/name=*/*.txt")):  # two files a model and strategy
        name = status.getPath()
        fs.rename(name, path(path(folder), f"{unquote(name.getParent().getName()).removeprefix('name=')}.json"))
    flagged = files.name_flags(files.summaries(spark, folder), L.strategies(spark))
    return rounded(files.tiers(files.longest_name(flagged, ["model", "strategy"]), ["model", "strategy", "bias"]))


def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as a stream of requests, scored once each into a table; then once more, which adds none."""
    folder = scratch(spark)
    source = read(spark, sf_dir, "conversations").where("role = 'user'")
    source.select(F.md5("text").alias("key"), "text").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("key string, text string").parquet(f"{folder}/in")
    stub = lambda d: d.select("key", F.length("text").cast("string").alias("answer"))
    for _ in range(2):
        score_stream(stream, "key", stub, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("key", "answer")


def text_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents by a classifier of hashed words and word pairs, fitted on 80 %, judged on the rest by class."""
    d = C.holdout(read(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang", "text"), "lang", "doc_id")
    fitted = C.train_texts(d.where(~F.col("held_out")), "lang", "text", 8, 20)
    return rounded(C.class_quality(C.predict_texts(fitted, d.where("held_out"), "text"), "lang", "best"), 4)


QUERIES = {f.__name__: f for f in (
    rank_statistics, rank_tests, strategy_tests, false_discovery, high_vs_low, high_vs_low_tests, mcnemar_tests, bootstrap_intervals, bias_correlations, holdout_split, guessed_classes, guess_summary,
    guess_coverage, classifier_quality, text_classifier, summary_files, streamed_scores,
)}

_GUESS = "g AS (SELECT lang, CASE WHEN strpos(' ' || lower(text) || ' ', ' der ') > 0 THEN 'de' WHEN strpos(' ' || lower(text) || ' ', ' les ') > 0 THEN 'fr' WHEN strpos(' ' || lower(text) || ' ', ' los ') > 0 THEN 'es' ELSE 'en' END AS guess FROM documents), labels_ AS (SELECT lang AS label FROM g UNION SELECT guess FROM g), c AS (SELECT label, (SELECT count(*) FROM g WHERE lang = label) AS support, (SELECT count(*) FROM g WHERE guess = label) AS predicted, (SELECT count(*) FROM g WHERE lang = label AND guess = label) AS tp FROM labels_), pr AS (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS r FROM c), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr)"
_TIER_RATES = FACTS + ", t AS (SELECT bias, model, tier, 100 * avg(CAST(sensitive AS DOUBLE)) AS s FROM tiered GROUP BY ALL)"
ORACLE = {
    "rank_statistics": "WITH v AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS x FROM orders), pool AS (SELECT status, priority AS cell, x, 1 AS own FROM v WHERE priority <> '3-MEDIUM' UNION ALL SELECT b.status, c.cell, b.x, 0 FROM v b JOIN (SELECT DISTINCT status, priority AS cell FROM v WHERE priority <> '3-MEDIUM') c ON b.status = c.status WHERE b.priority = '3-MEDIUM'), r AS (SELECT *, rank() OVER (PARTITION BY status, cell ORDER BY x) + (count(*) OVER (PARTITION BY status, cell, x) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY status, cell, x) AS t FROM pool), s AS (SELECT status, cell, sum(own) AS n1, sum(1 - own) AS n2, sum(rk * own) AS r1, sum(t::DOUBLE * t - 1) AS ties, median(x) FILTER (own = 1) AS m1, median(x) FILTER (own = 0) AS m0 FROM r GROUP BY ALL), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u FROM s) SELECT status, cell AS priority, n1, n2, round(ties, 6) AS ties, round(m1, 6) AS median, round(m0, 6) AS median_baseline, round(m1 - m0, 6) AS delta_median, round(u, 6) AS u, round(1 - 2 * u / (n1 * n2), 6) AS effect FROM u",
    "false_discovery": "WITH c AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 13 > 0 THEN (c_custkey * 7919 % 1009) / 1009.0::DOUBLE END AS p FROM customer), a AS (SELECT *, coalesce(p, 1) AS pa FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY p NULLS LAST) AS k, count(p) OVER (PARTITION BY c_mktsegment) AS m, row_number() OVER (ORDER BY pa) AS ka, count(*) OVER () AS ma FROM a) SELECT c_custkey, c_mktsegment, round(p, 6) AS p, CASE WHEN p IS NOT NULL THEN round(least(1, min(p * m / k) OVER (PARTITION BY c_mktsegment ORDER BY p DESC NULLS FIRST, k DESC ROWS UNBOUNDED PRECEDING)), 6) END AS q, round(least(1, min(pa * ma / ka) OVER (ORDER BY pa DESC, ka DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_all FROM r",
    "high_vs_low": f"WITH {_TIER_RATES}, d AS (SELECT bias, model, avg(s) FILTER (tier = 'high') - avg(s) FILTER (tier = 'low') AS d FROM t GROUP BY ALL), a AS (SELECT bias, count(d) AS n, avg(d) AS m, stddev_samp(d) / sqrt(count(d)) AS se FROM d GROUP BY bias) SELECT bias, n, round(m, 6) AS mean_diff, round(se, 6) AS se, round(m / nullif(se, 0), 6) AS t FROM a WHERE n >= 2",
    "bias_correlations": f"WITH {FACTS}, m AS (SELECT bias, strategy, avg(sensitivity) AS s FROM facts GROUP BY ALL) SELECT x.bias AS a, y.bias AS b, round(coalesce(corr(x.s, y.s), 0), 5) AS r FROM m x JOIN m y ON x.strategy = y.strategy AND x.bias < y.bias GROUP BY ALL",
    "holdout_split": "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('1337~' || vec_id), vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS held_out FROM embeddings",
    "guessed_classes": f"WITH {_GUESS} SELECT label, support, predicted, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f",
    "guess_summary": f"WITH {_GUESS} SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(p * support) / sum(support), 6) AS weighted_precision, round(sum(r * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f",
    "guess_coverage": "SELECT count(*) AS n, round(avg((doc_id % 10 >= 6)::INT::DOUBLE), 6) AS coverage, round(avg((quality = 1 - toxic)::INT::DOUBLE) FILTER (doc_id % 10 >= 6), 6) AS covered_accuracy FROM labels",
    "summary_files": f"WITH {FACTS} SELECT model, CASE strategy WHEN 's0' THEN 'Ø' WHEN 's1' THEN 'CoT' WHEN 's2' THEN 'BW+IsD' ELSE 'BW' END AS strategy, bias, tier, count(*) AS tier_total_cases, round(100 * avg(sensitive::DOUBLE), 6) AS tier_sensitivity, round(100 * avg(harmful::DOUBLE), 6) AS tier_harmfulness FROM tiered WHERE tier IS NOT NULL GROUP BY ALL",
    "streamed_scores": "SELECT DISTINCT md5(text) AS key, length(text)::VARCHAR AS answer FROM conversations WHERE role = 'user'",
}
