"""Queries over outcome rates: events as runs, orders as scores, labels as raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlens.functions import labels as L
from pairlens.operators import rates as R, reports as O
from pairlens.operators.shared import exact_quantiles

STRATEGY_ORDER = ["s0", "s1", "s2", "s3"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; a zero has no sign."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs: type is the bias, the property k the complexity, user and event ids the decisions."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", F.col("event_type").alias("bias"), F.get_json_object("props", "$.k").cast("int").alias("steps"),
        F.concat(F.lit("m"), F.col("user_id") % 6).alias("model"), F.concat(F.lit("s"), F.col("event_id") % 4).alias("strategy"),
        F.when(F.col("user_id") % 5 == 0, "B").otherwise("A").alias("unbiased"), F.when(F.col("event_id") % 3 == 0, "B").otherwise("A").alias("biased"), F.lit("A").alias("expected"),
    )


RUNS = """runs AS (SELECT event_id, user_id, event_type AS bias, CAST(json_extract_string(props, '$.k') AS INT) AS steps,
 'm' || (user_id % 6) AS model, 's' || (event_id % 4) AS strategy,
 CASE WHEN user_id % 5 = 0 THEN 'B' ELSE 'A' END AS unbiased, CASE WHEN event_id % 3 = 0 THEN 'B' ELSE 'A' END AS biased FROM events),
flags AS (SELECT *, CAST(unbiased <> biased AS INT) AS sensitive, CAST(unbiased <> 'A' AS INT) AS uncertain,
 CAST((unbiased <> 'A') <> (unbiased <> biased) AS INT) AS harmful FROM runs),
q AS (SELECT quantile_cont(steps, 0.25) AS q1, quantile_cont(steps, 0.5) AS q2, quantile_cont(steps, 0.75) AS q3 FROM runs),
tiered AS (SELECT flags.*, CASE WHEN steps IS NULL THEN NULL WHEN steps <= q1 THEN 'low' WHEN steps <= q2 THEN 'mid-low' WHEN steps <= q3 THEN 'mid-high' ELSE 'high' END AS tier FROM flags, q)"""
FACTS = RUNS + """,
facts AS (SELECT bias, model, strategy, 100 * avg(CAST(sensitive AS DOUBLE)) AS sensitivity, count(*) AS n FROM flags GROUP BY ALL)"""


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_tier(R.outcome_flags(runs(spark, sf_dir)), "steps")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sensitivity for each bias, model and strategy."""
    f = R.outcome_flags(runs(spark, sf_dir))
    return f.groupBy("bias", "model", "strategy").agg((100 * F.avg(F.col("sensitive").cast("int"))).alias("sensitivity"), F.count(F.lit(1)).alias("n"))


def outcome_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.rates(tiered(spark, sf_dir), ("bias",), ("bias", "tier")))


def complexity_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = exact_quantiles(runs(spark, sf_dir), ["bias"], "steps", [0.25, 0.5, 0.75])
    return rounded(q.select("bias", *[F.col("quantiles")[i].alias(f"q{i + 1}") for i in range(3)]))


def two_level_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.two_level_mean(facts(spark, sf_dir), "sensitivity", ["bias", "strategy"], ["strategy"]))


def tier_two_level_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tiered(spark, sf_dir).groupBy("bias", "model", "strategy", "tier").agg((100 * F.avg(F.col("sensitive").cast("int"))).alias("sensitivity"))
    return rounded(R.two_level_mean(f, "sensitivity", ["bias", "strategy", "tier"], ["strategy", "tier"]))


def model_level_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.spread(facts(spark, sf_dir), "sensitivity", ["model", "strategy"]))


def tier_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and count over biases of the sensitivity of a model's tiers."""
    f = tiered(spark, sf_dir).where("tier IS NOT NULL").groupBy("bias", "model", "tier").agg((100 * F.avg(F.col("sensitive").cast("int"))).alias("sensitivity"))
    return rounded(R.spread(f, "sensitivity", ["model", "tier"]))


def aggregated_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest sensitivity of a bias under each strategy, of one value for each model (the largest of its tiers)."""
    f = tiered(spark, sf_dir).groupBy("bias", "strategy", "model", "tier").agg((100 * F.avg(F.col("sensitive").cast("int"))).alias("sensitivity"))
    return rounded(R.matrix(f, "bias", "strategy", "sensitivity", STRATEGY_ORDER, 0.0, ["model"], F.max))


def strategy_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.medians(facts(spark, sf_dir), "sensitivity", "bias", "strategy", "all biases"))


def sensitivity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.matrix(facts(spark, sf_dir), "model", "strategy", "sensitivity", STRATEGY_ORDER, 0.0))


def tier_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.rates(tiered(spark, sf_dir), ("bias", "tier")).where("tier IS NOT NULL").withColumn("x", L.rank_in(F.col("tier"), L.TIERS))
    out = R.trend_slope(t, ["bias"], "x", "sensitivity")
    return rounded(out.withColumn("arrow", L.trend_arrow(F.col("slope"))))


def dense_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bias and model with every tier, and the difference of a tier's rate from its model's mean."""
    f = tiered(spark, sf_dir).where("steps > 40").groupBy("bias", "model", "tier").agg((100 * F.avg(F.col("sensitive").cast("int"))).alias("rate"))
    base = f.groupBy("model").agg(F.avg("rate").alias("base"))
    out = R.densify(f, ["bias", "model"], "tier", list(L.TIERS)).join(base, "model")
    return rounded(out.select("bias", "model", "tier", "rate", (F.col("rate") - F.col("base")).alias("delta")))


def winning_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = facts(spark, sf_dir).groupBy("bias", "strategy").agg(F.avg("sensitivity").alias("sensitivity"))
    return rounded(R.winners(rounded(m, 9), "bias", "sensitivity").withColumn("place", F.col("place").cast("long")))


def row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = facts(spark, sf_dir).groupBy("model", "strategy").agg(F.avg("sensitivity").alias("sensitivity"))
    return rounded(R.row_z(m, "model", "sensitivity"))


def row_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = exact_quantiles(facts(spark, sf_dir), ["bias"], "sensitivity", [0.2, 0.8, 0.05, 0.99])
    return rounded(q.select("bias", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("p20", "p80", "p5", "p99"))]))


def best_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model the strategy of least median (ties: most runs, then domain order), the baseline s0 left out."""
    m = rounded(R.medians(facts(spark, sf_dir), "sensitivity", "model", "strategy"), 9).where("strategy <> 's0'")
    order = [F.col("median").asc(), F.col("n").desc(), L.rank_in(F.col("strategy"), STRATEGY_ORDER, "s0")]
    return rounded(R.first_of(m, ["model"], order))


def entity_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).withColumns({"hit": F.col("steps") >= 90, "strong": F.col("steps") >= 97})
    return rounded(R.entity_prevalence(rows, "bias", "user_id", "hit", "strong"))


def candidate_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.prevalence(runs(spark, sf_dir), "bias", F.col("steps") >= 90))


def seen_and_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped counts of every event type; purchases are never mapped and stay at 0."""
    e = runs(spark, sf_dir)
    return O.counted_dimension(e.select("bias").distinct(), e.where("bias <> 'purchase' AND steps >= 99"), "bias", "bias", "mapped")


def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(R.paired_summary(d, ["lang"], "toxic", "quality"))


def change_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows changed by -1, 0 and 1; empty bins stay."""
    d = read(spark, sf_dir, "labels").where("NOT (quality = 0 AND toxic = 1)").select((F.col("quality") - F.col("toxic")).alias("change"))
    return O.histogram(d, "change", [-1, 0, 1])


def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "labels")
    out = d.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("agreement"), F.count_if(F.col("quality") != F.col("toxic")).alias("n_disagree"))
    return rounded(out)


def judged_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rounded(R.binary_quality(d, ["source"], "quality", "toxic", 10))


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many events of each type as the rarest has; events of seed users come first and always stay."""
    e = runs(spark, sf_dir).select("event_id", "bias", "user_id")
    return R.seeded_cap(e, ["bias"], "event_id", 42, always=F.col("user_id") % 50 == 0).select("event_id", "bias")


def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of 25 events of each type."""
    return R.seeded_cap(runs(spark, sf_dir).select("event_id", "bias"), ["bias"], "event_id", 7, cap=25).select("event_id", "bias")


def run_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as pairs, expanded into three runs of two arms, with prompts by strategy."""
    from pairlens.operators import pairs as P

    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pair_id"), F.col("text").alias("unbiased"), F.concat(F.lit("Surely: "), F.col("text")).alias("biased"))
    d = P.expand_runs(b, 3)
    asked = P.request(F.col("prompt"), F.when(F.col("arm") == "biased", "think first").otherwise(""), F.col("run_id"))
    return d.select("pair_id", F.col("run_id").cast("long").alias("run_id"), "arm", F.length(asked).cast("long").alias("chars"), F.md5(asked).alias("request_md5"))


def merged_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of two priorities joined by customer and month, clashing columns with suffixes."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority", "o_totalprice")
    base, ours = (o.where(F.col("o_orderpriority") == p).select("o_custkey", "month", F.col("o_totalprice").alias("price")) for p in ("1-URGENT", "5-LOW"))
    j = O.suffixed_join(base, ours, ["o_custkey", "month"])
    return rounded(j.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("price_BASE").alias("price_BASE"), F.sum("price_OURS").alias("price_OURS")), 2)


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers with orders that the cache (segment BUILDING) does not have, with their orders."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return o.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("requests"))


def shared_and_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of nation keys: those of customers and suppliers, of one only, and of neither."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    c = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("k"))
    m = O.set_parts({"c": c, "s": s}, n, "k")
    parts = {"both": F.size("members") == 2, "customers only": F.col("members") == F.array(F.lit("c")), "suppliers only": F.col("members") == F.array(F.lit("s")), "either": F.size("members") > 0, "unknown": F.size("members") == 0}
    return m.select(F.explode(F.filter(F.array(*[F.when(ok, name) for name, ok in parts.items()]), lambda x: x.isNotNull())).alias("part"), "k")


def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with mapped region labels, unknown ones as they are, and customers counted with a default of 0."""
    n = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.withColumn("region", L.lookup(F.col("r_name"), {"AFRICA": "Af", "ASIA": "As"}))
    return O.counted_dimension(n, read(spark, sf_dir, "customer").where("c_acctbal > 9500"), "n_nationkey", "c_nationkey", "rich").select("n_name", "region", "rich")


def domain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities with their place in a domain whose baseline is first, and label keys for headers."""
    p = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    place = L.rank_in(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], "3-MEDIUM").cast("long")
    return p.select("o_orderpriority", "n", place.alias("place"), L.normalize_bias(F.col("o_orderpriority"), {"5-low": "low"}).alias("label"), L.title(F.col("o_orderpriority")).alias("title"))


def numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers of customers by balance, over all rows."""
    from pairlens.operators.pairs import dense_ids

    return dense_ids(read(spark, sf_dir, "customer").select("c_acctbal", "c_custkey"), ["c_acctbal", "c_custkey"]).select("c_custkey", "id")


def clipped_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values coerced to 0 or 1: not numbers go, the rest is clipped and rounded half to even."""
    v = F.get_json_object("props", "$.k").try_cast("double") / 50 - 0.5
    d = O.coerced_binary(read(spark, sf_dir, "events").select(v.alias("bit")), ["bit"])
    return d.groupBy("bit").agg(F.count(F.lit(1)).alias("n"))


def table_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.signature(read(spark, sf_dir, "labels"))


def tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.rates(tiered(spark, sf_dir), ("bias", "model", "tier"))
    return rounded(R.tier_summary(f, "model", "tier", "bias", "sensitivity", "runs"))


def validation_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best event of each user by value (a top-k report: the first hundred), with blank columns for annotators."""
    from pairlens.operators.scoring import validation_sheet as sheet

    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round("value", 6).alias("score"))
    best = R.first_of(e, ["user_id"], [F.desc("score"), F.col("event_id")]).orderBy(F.desc("score"), "event_id").limit(100)
    return sheet(best, "event_id", "event_type", "score", 0.0, ["cue"])


def labelled_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with the documents they judge, English ones and rare sources left out."""
    d = read(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", "source", "n_chars")
    j = read(spark, sf_dir, "labels").join(O.of_frequent(d, "source", 15), "doc_id")
    return rounded(j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.avg("quality").alias("quality")))


def daily_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and hour in UTC, seconds cut off."""
    e = read(spark, sf_dir, "events").withColumn("second", F.date_trunc("second", "ts")).withColumn("day", F.date_format("second", "yyyy-MM-dd"))
    return O.distinct_counts(e, ["day"], {"second": "seconds", "user_id": "users"})


QUERIES = {f.__name__: f for f in (
    table_signature, tier_summary, validation_sheet, labelled_lookup, daily_stamps, outcome_rates, complexity_quartiles, two_level_means, tier_two_level_means, model_level_spread, tier_spread, aggregated_matrix, strategy_medians, sensitivity_matrix, tier_trends, dense_tiers, winning_strategies,
    row_scores, row_percentiles, best_cells, entity_prevalence, candidate_prevalence, seen_and_unseen, paired_outcomes, change_histogram, rater_agreement, judged_quality, balanced_sample,
    capped_sample, run_expansion, merged_suffixes, cache_misses, shared_and_unknown, lookup_with_default, domain_order, numbered_orders, clipped_binary,
)}

_Z = "1.96"
_RATES = "count(*) AS runs, round(100 * avg(CAST(sensitive AS DOUBLE)), 6) AS sensitivity, round(100 * avg(CAST(harmful AS DOUBLE)), 6) AS harmfulness, round(100 * avg(CAST(uncertain AS DOUBLE)), 6) AS uncertainty"
ORACLE = {
    "table_signature": "WITH h AS (SELECT md5(doc_id::VARCHAR || '~' || quality::VARCHAR || '~' || toxic::VARCHAR) AS h FROM labels) SELECT sha1(count(*)::VARCHAR || '-' || " + " || '-' || ".join(f"coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT), 0)::VARCHAR" for i in range(4)) + ") AS signature FROM h",
    "tier_summary": f"WITH {RUNS}, f AS (SELECT bias, model, tier, count(*) AS runs, 100 * avg(CAST(sensitive AS DOUBLE)) AS s FROM tiered GROUP BY ALL), b AS (SELECT model, avg(s) AS b FROM (SELECT model, bias, avg(s) AS s FROM f GROUP BY ALL) GROUP BY model) SELECT model, tier, round(avg(s), 6) AS mean, sum(runs)::BIGINT AS n, round(any_value(b), 6) AS baseline, round(avg(s) - any_value(b), 6) AS delta FROM f JOIN b USING (model) GROUP BY model, tier",
    "validation_sheet": "WITH e AS (SELECT event_id, user_id, event_type, round(value, 6) AS score FROM events), b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) = 1 ORDER BY score DESC, event_id LIMIT 100) SELECT event_id, event_type, NULL::INT AS ann1_cue, NULL::INT AS ann2_cue FROM b WHERE score >= 0",
    "labelled_lookup": "WITH d AS (SELECT doc_id, source, n_chars FROM documents WHERE lang <> 'en'), big AS (SELECT source FROM d GROUP BY source HAVING count(*) >= 15) SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(avg(quality), 6) AS quality FROM labels JOIN d USING (doc_id) WHERE source IN (SELECT source FROM big) GROUP BY source",
    "daily_stamps": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT date_trunc('second', ts)) AS seconds, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "outcome_rates": f"WITH {RUNS} SELECT bias, tier, {_RATES} FROM tiered GROUP BY GROUPING SETS ((bias), (bias, tier))",
    "complexity_quartiles": f"WITH {RUNS} SELECT bias, round(quantile_cont(steps, 0.25), 6) AS q1, round(quantile_cont(steps, 0.5), 6) AS q2, round(quantile_cont(steps, 0.75), 6) AS q3 FROM runs GROUP BY bias",
    "two_level_means": f"WITH {FACTS}, m AS (SELECT bias, strategy, avg(sensitivity) AS s FROM facts GROUP BY ALL) SELECT strategy, round(avg(s), 6) AS mean, count(s) AS n FROM m GROUP BY strategy",
    "tier_two_level_means": f"WITH {RUNS}, f AS (SELECT bias, model, strategy, tier, 100 * avg(CAST(sensitive AS DOUBLE)) AS s FROM tiered GROUP BY ALL), m AS (SELECT bias, strategy, tier, avg(s) AS s FROM f GROUP BY ALL) SELECT strategy, tier, round(avg(s), 6) AS mean, count(s) AS n FROM m GROUP BY ALL",
    "model_level_spread": f"WITH {FACTS} SELECT model, strategy, round(avg(sensitivity), 6) AS mean, round(stddev_samp(sensitivity), 6) AS sd, count(*) AS n FROM facts GROUP BY ALL",
    "tier_spread": f"WITH {RUNS}, f AS (SELECT bias, model, tier, 100 * avg(CAST(sensitive AS DOUBLE)) AS s FROM tiered WHERE tier IS NOT NULL GROUP BY ALL) SELECT model, tier, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd, count(s) AS n FROM f GROUP BY ALL",
    "aggregated_matrix": f"WITH {RUNS}, f AS (SELECT bias, strategy, model, tier, 100 * avg(CAST(sensitive AS DOUBLE)) AS s FROM tiered GROUP BY ALL) SELECT bias, " + ", ".join(f"coalesce(round(max(s) FILTER (strategy = '{x}'), 6), 0) AS {x}" for x in STRATEGY_ORDER) + " FROM f GROUP BY bias",
    "strategy_medians": f"WITH {FACTS} SELECT coalesce(bias, 'all biases') AS bias, strategy, round(median(sensitivity), 6) AS median, count(*) AS n FROM facts GROUP BY GROUPING SETS ((bias, strategy), (strategy))",
    "sensitivity_matrix": f"WITH {FACTS} SELECT model, " + ", ".join(f"coalesce(round(avg(sensitivity) FILTER (strategy = '{s}'), 6), 0) AS {s}" for s in STRATEGY_ORDER) + " FROM facts GROUP BY model",
    "tier_trends": f"WITH {RUNS}, t AS (SELECT bias, tier, 100 * avg(CAST(sensitive AS DOUBLE)) AS y, CASE tier WHEN 'low' THEN 0 WHEN 'mid-low' THEN 1 WHEN 'mid-high' THEN 2 ELSE 3 END AS x FROM tiered WHERE tier IS NOT NULL GROUP BY ALL), s AS (SELECT bias, regr_slope(y, x) AS slope FROM t GROUP BY bias) SELECT bias, round(slope, 6) AS slope, CASE WHEN slope IS NULL THEN 'n/a' WHEN slope > 0.15 THEN 'up' WHEN slope < -0.15 THEN 'down' ELSE 'flat' END AS arrow FROM s",
    "dense_tiers": f"WITH {RUNS}, f AS (SELECT bias, model, tier, 100 * avg(CAST(sensitive AS DOUBLE)) AS rate FROM tiered WHERE steps > 40 GROUP BY ALL), b AS (SELECT model, avg(rate) AS base FROM f GROUP BY model), g AS (SELECT * FROM (SELECT DISTINCT bias, model FROM f), (VALUES ('low'), ('mid-low'), ('mid-high'), ('high')) AS v(tier)) SELECT g.bias, g.model, g.tier, round(rate, 6) AS rate, round(rate - base, 6) AS delta FROM g JOIN b ON g.model = b.model LEFT JOIN f ON f.bias = g.bias AND f.model = g.model AND f.tier = g.tier",
    "winning_strategies": f"WITH {FACTS}, m AS (SELECT bias, strategy, round(avg(sensitivity), 9) AS s FROM facts GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY bias ORDER BY s) AS place FROM m) SELECT bias, strategy, round(s, 6) AS sensitivity, place FROM r WHERE place = 1",
    "row_scores": f"WITH {FACTS}, m AS (SELECT model, strategy, avg(sensitivity) AS s FROM facts GROUP BY ALL) SELECT model, strategy, round(s, 6) AS sensitivity, round((s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0), 6) AS z FROM m WINDOW w AS (PARTITION BY model)",
    "row_percentiles": f"WITH {FACTS} SELECT bias, round(quantile_cont(sensitivity, 0.2), 6) AS p20, round(quantile_cont(sensitivity, 0.8), 6) AS p80, round(quantile_cont(sensitivity, 0.05), 6) AS p5, round(quantile_cont(sensitivity, 0.99), 6) AS p99 FROM facts GROUP BY bias",
    "best_cells": f"WITH {FACTS}, m AS (SELECT model, strategy, round(median(sensitivity), 9) AS median, count(*) AS n FROM facts WHERE strategy <> 's0' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY median, n DESC, strategy) AS k FROM m) SELECT model, strategy, round(median, 6) AS median, n FROM r WHERE k = 1",
    "entity_prevalence": f"WITH {RUNS}, e AS (SELECT bias, user_id, bool_or(steps >= 90) AS f, bool_or(steps >= 97) AS s FROM runs GROUP BY ALL), a AS (SELECT bias, count(*) AS n, count_if(f) AS k, count_if(s) AS strong_k, count_if(f AND NOT s) AS weak_k FROM e GROUP BY bias), w AS (SELECT *, k::DOUBLE / n AS p, 1 + {_Z} * {_Z}::DOUBLE / n AS d, {_Z}::DOUBLE AS z FROM a) SELECT bias, n, k, strong_k, weak_k, round(p, 6) AS prevalence, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / d, 6) AS wilson95_lo, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / d, 6) AS wilson95_hi FROM w",
    "candidate_prevalence": f"WITH {RUNS} SELECT coalesce(bias, 'ANY') AS bias, count(*) AS n, count_if(steps >= 90) AS k, round(100.0::DOUBLE * count_if(steps >= 90) / count(*), 6) AS pct FROM runs GROUP BY GROUPING SETS ((bias), ())",
    "seen_and_unseen": f"WITH {RUNS} SELECT bias, coalesce(count_if(bias <> 'purchase' AND steps >= 99), 0) AS mapped FROM runs GROUP BY bias",
    "paired_outcomes": "WITH d AS (SELECT lang, toxic AS a, quality AS b FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) AS n, avg(a::DOUBLE) AS base_rate, avg(b::DOUBLE) AS treated_rate, count_if(a = 0 AND b = 0) AS n00, count_if(a = 0 AND b = 1) AS n01, count_if(a = 1 AND b = 0) AS n10, count_if(a = 1 AND b = 1) AS n11 FROM d GROUP BY lang), e AS (SELECT *, ((n11 + n10)::DOUBLE * (n11 + n01) + (n00 + n01)::DOUBLE * (n00 + n10)) / (n::DOUBLE * n) AS pe FROM c) SELECT lang, n, round(base_rate, 6) AS base_rate, round(treated_rate, 6) AS treated_rate, n00, n01, n10, n11, round(base_rate - treated_rate, 6) AS absolute_reduction, round((base_rate - treated_rate) / nullif(base_rate, 0), 6) AS relative_reduction, round(greatest(abs(n10 - n01) - 1, 0)::DOUBLE ** 2 / nullif(n10 + n01, 0), 6) AS mcnemar, round(2 * (asin(sqrt(base_rate)) - asin(sqrt(treated_rate))), 6) AS cohens_h, round(((n11 + n00)::DOUBLE / n - pe) / nullif(1 - pe, 0), 6) AS kappa, round((n11 + n00)::DOUBLE / n, 6) AS agreement FROM e",
    "change_histogram": "SELECT v.change, count(l.doc_id) AS n FROM (VALUES (-1), (0), (1)) AS v(change) LEFT JOIN (SELECT * FROM labels WHERE NOT (quality = 0 AND toxic = 1)) l ON l.quality - l.toxic = v.change GROUP BY v.change",
    "rater_agreement": "SELECT count(*) AS n, round(avg((quality = toxic)::INT::DOUBLE), 6) AS agreement, count_if(quality <> toxic) AS n_disagree FROM labels",
    "judged_quality": "WITH c AS (SELECT source, count(*) AS n, count_if(quality = 1 AND toxic = 1) AS tp, count_if(quality = 0 AND toxic = 1) AS fp, count_if(quality = 1 AND toxic = 0) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY source HAVING count(*) >= 10), p AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM c) SELECT source, n, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, tp + fn AS support, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM p",
    "balanced_sample": "WITH c AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM events GROUP BY event_type)), r AS (SELECT event_id, event_type AS bias, user_id % 50 = 0 AS seed, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN user_id % 50 = 0 THEN 0 ELSE 1 END, md5('42~' || event_id), event_id) AS k FROM events) SELECT event_id, bias FROM r, c WHERE k <= least OR seed",
    "capped_sample": "SELECT event_id, event_type AS bias FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('7~' || event_id), event_id) <= 25",
    "run_expansion": "WITH r AS (SELECT item_id AS pair_id, run_id, arm, CASE arm WHEN 'biased' THEN 'Surely: ' || text || chr(10) || chr(10) || 'Best practices:' || chr(10) || 'think first' ELSE text END || repeat(' ', run_id) AS asked FROM benchmark, (SELECT unnest([0, 1, 2]) AS run_id), (SELECT unnest(['biased', 'unbiased']) AS arm)) SELECT pair_id, run_id::BIGINT AS run_id, arm, length(asked) AS chars, md5(asked) AS request_md5 FROM r",
    "merged_suffixes": "WITH o AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS p, o_totalprice AS t FROM orders) SELECT a.month, count(*) AS n, round(sum(a.t), 2) AS \"price_BASE\", round(sum(b.t), 2) AS \"price_OURS\" FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.month = b.month WHERE a.p = '1-URGENT' AND b.p = '5-LOW' GROUP BY a.month",
    "cache_misses": "SELECT o_custkey, count(*) AS requests FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey",
    "shared_and_unknown": "WITH n AS (SELECT n_nationkey AS k FROM nation), c AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), s AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 3000) SELECT 'both' AS part, k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'customers only', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'suppliers only', k FROM (SELECT k FROM s EXCEPT SELECT k FROM c) UNION ALL SELECT 'either', k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'unknown', k FROM (SELECT k FROM n EXCEPT (SELECT k FROM c UNION SELECT k FROM s))",
    "lookup_with_default": "SELECT n_name, CASE r_name WHEN 'AFRICA' THEN 'Af' WHEN 'ASIA' THEN 'As' ELSE r_name END AS region, count(c_custkey) AS rich FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9500 GROUP BY ALL",
    "domain_order": "SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END::BIGINT AS place, CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE lower(o_orderpriority) END AS label, array_to_string(list_transform(string_split(lower(o_orderpriority), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM orders GROUP BY o_orderpriority",
    "numbered_orders": "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS id FROM customer",
    "clipped_binary": "WITH v AS (SELECT greatest(least(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50 - 0.5, 1), 0) AS x FROM events) SELECT round_even(x, 0)::INT AS bit, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY 1",
}
