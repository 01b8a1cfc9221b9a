"""Outcome flags and rates of experiment runs, and the aggregates and windows over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairlens.functions import stats
from pairlens.functions.labels import TIERS
from pairlens.operators.shared import cut, exact_quantiles, null_safe_join, places_by_hash


def outcome_flags(runs: DataFrame) -> DataFrame:
    """Add sensitive, uncertain and harmful to runs (unbiased, biased, expected): whether the decisions differ, the
    unbiased one is not as expected (last characters), and the bias did harm: uncertain and equal, or certain and not."""
    differ = F.col("unbiased") != F.col("biased")
    uncertain = F.substring("unbiased", -1, 1) != F.substring("expected", -1, 1)
    return runs.withColumns({"sensitive": differ, "uncertain": uncertain, "harmful": uncertain != differ})


def with_tier(runs: DataFrame, metric: str) -> DataFrame:
    """Add ``tier`` by the exact quartiles of ``metric`` over all rows (one row, which is broadcast)."""
    q = exact_quantiles(runs, [], metric, [0.25, 0.5, 0.75], "_q")
    m = F.col(metric)
    tier = F.when(m.isNull(), None)
    for i, name in enumerate(TIERS[:3]):
        tier = tier.when(m <= F.col("_q")[i], name)
    return runs.crossJoin(F.broadcast(q)).withColumn("tier", tier.otherwise(F.when(m.isNotNull(), TIERS[3]))).drop("_q")


def _share(flag: str) -> Column:
    return 100 * F.avg(F.col(flag).cast("int"))


def rates(runs: DataFrame, *sets: tuple[str, ...]) -> DataFrame:
    """Runs and percentages of sensitive, harmful and uncertain for each of ``sets`` of columns, in one pass."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    agg = [F.count(F.lit(1)).alias("runs"), *[_share(f).alias(n) for f, n in (("sensitive", "sensitivity"), ("harmful", "harmfulness"), ("uncertain", "uncertainty"))]]
    if len(sets) == 1:
        return runs.groupBy(*columns).agg(*agg)
    return runs.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*agg)


def two_level_mean(facts: DataFrame, value: str, inner: list[str], outer: list[str]) -> DataFrame:
    """Mean of ``value`` by ``inner`` keys, then mean and non-null count of these by ``outer`` keys."""
    first = facts.groupBy(*inner).agg(F.avg(value).alias("_mean"))
    return first.groupBy(*outer).agg(F.avg("_mean").alias("mean"), F.count("_mean").alias("n"))


def spread(facts: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, sample deviation and count of ``value`` by ``keys``."""
    return facts.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def medians(facts: DataFrame, value: str, key: str, column: str, total: str | None = None) -> DataFrame:
    """Exact median by (key, column); with ``total``, also over all keys under that name. Medians come by selection."""

    def by(keys: list[str]) -> DataFrame:
        n = facts.groupBy(*keys).agg(F.count(value).alias("n"))
        return null_safe_join(n, exact_quantiles(facts, keys, value, [0.5], "_q"), keys).select(*keys, F.col("_q")[0].alias("median"), "n")

    if total is None:
        return by([key, column])
    every = by([column]).select(F.lit(total).alias(key), column, "median", "n")
    return by([key, column]).withColumn(key, F.coalesce(key, F.lit(total))).unionByName(every)


def matrix(facts: DataFrame, row: str, column: str, value: str, order: list[str], fill: float | None = None, first: list[str] | None = None, how: Callable[[str], Column] = F.avg) -> DataFrame:
    """Mean (or ``how``) of ``value`` as a matrix with columns in ``order``; with ``first``, facts are one by these keys before,
    by ``how`` as well."""
    if first:
        facts = facts.groupBy(*dict.fromkeys([row, column, *first])).agg(how(value).alias(value))
    out = facts.groupBy(row).pivot(column, order).agg(how(value))
    return out if fill is None else out.fillna(fill)


def trend_slope(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope of y over x; null with fewer than two points."""
    return points.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"))


def densify(facts: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """Every combination of ``keys`` that occurs with every value of ``column``."""
    grid = facts.select(*keys).distinct().withColumn(column, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(facts, [*keys, column], "left")


def benjamini_hochberg(tests: DataFrame, p: str, family: list[str], out: str = "q", missing: float | None = None) -> DataFrame:
    """Add ``out``, false-discovery adjusted ``p`` within each family; null p has null q, or counts as ``missing``.

    ``family`` may be empty: one family of all tests. Tests are dealt by ranges of p: a test's rank is its place in its range
    and the counts of the ranges before, its q the least of p m / rank from there on in its range and in all later ones.
    So a family of any size is adjusted by many tasks.
    """
    value = F.col(p) if missing is None else F.coalesce(p, F.lit(missing))
    d = tests.withColumn("_p", value).repartitionByRange(*family, F.asc_nulls_last("_p")).withColumn("_part", F.spark_partition_id())
    d = cut(d)
    own, parts = W.partitionBy(*family, "_part"), W.partitionBy(*family).orderBy("_part")  # ranges are no more than tasks
    sums = d.groupBy(*family, "_part").agg(F.count("_p").alias("_n"))
    start = F.coalesce(F.sum("_n").over(parts.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*family, "_part", start.alias("_start"), F.sum("_n").over(W.partitionBy(*family)).alias("_m"))
    d = null_safe_join(d.withColumn("_rank", F.row_number().over(own.orderBy(F.asc_nulls_last("_p")))), sums, [*family, "_part"])
    d = d.withColumn("_ratio", F.col("_p") * F.col("_m") / (F.col("_start") + F.col("_rank")))
    lows = d.groupBy(*family, "_part").agg(F.min("_ratio").alias("_low"))
    lows = lows.select(*family, "_part", F.min("_low").over(parts.rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    d = null_safe_join(d, lows, [*family, "_part"])
    here = F.min("_ratio").over(own.orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn(out, F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), here, F.col("_later")))).drop("_p", "_part", "_rank", "_start", "_m", "_ratio", "_later")


def winners(cells: DataFrame, key: str, value: str, ascending: bool = True) -> DataFrame:
    """Rows of the least (or largest) ``value`` of each key; ties share."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    return cells.withColumn("place", F.rank().over(W.partitionBy(key).orderBy(order))).where("place = 1")


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, place: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (which has to settle ties)."""
    out = df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= n)
    return out.withColumnRenamed("_place", place) if place else out.drop("_place")


def row_z(cells: DataFrame, row: str, value: str, out: str = "z") -> DataFrame:
    """Standard scores of ``value`` within each row of a matrix; null where a row does not vary."""
    w = W.partitionBy(row)
    return cells.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))


def seeded_cap(df: DataFrame, keys: list[str], ident: str, seed: int, cap: int | None = None, always: Column | None = None) -> DataFrame:
    """At most ``cap`` rows of each key, or as many as the smallest key has; rows of ``always`` first, then by hash."""
    draw = F.md5(F.concat_ws("~", F.lit(str(seed)), F.col(ident).cast("string")))
    first = F.lit(0) if always is None else F.when(always, 0).otherwise(1)
    limit = F.lit(cap)
    if cap is None:
        least = df.groupBy(*keys).count().agg(F.min("count").alias("_least"))
        df, limit = df.crossJoin(F.broadcast(least)), F.col("_least")
    placed = places_by_hash(df, keys, draw, ident, first)
    keep = F.col("_place") <= limit
    return placed.where(keep if always is None else keep | always).drop("_place", "_least")


def flag_prevalence(df: DataFrame, features: list[str]) -> DataFrame:
    """Counts and percentages of ``<feature>_strong``, ``_weak`` and ``_any`` flags, and of any feature, in one pass."""
    sums = [F.sum(f"{f}_{level}").alias(f"{f}_{level}") for f in features for level in ("strong", "weak", "any")]
    every = [F.sum(F.greatest(*[F.col(f"{f}_{level}") for f in features], F.lit(0))).alias(f"ANY_FEATURE_{level}") for level in ("strong", "any")]
    one = df.agg(F.count(F.lit(1)).alias("n_prompts"), *sums, *every, F.lit(None).cast("long").alias("ANY_FEATURE_weak"))
    rows = [F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}_{level}").cast("long").alias(f"{level}_count") for level in ("strong", "weak", "any")]) for f in [*features, "ANY_FEATURE"]]
    out = one.select("n_prompts", F.explode(F.array(*rows)).alias("r")).select("r.feature", "n_prompts", "r.strong_count", "r.weak_count", "r.any_count")
    return out.withColumns({f"{level}_pct": 100.0 * F.col(f"{level}_count") / F.col("n_prompts") for level in ("strong", "weak", "any")})


def entity_prevalence(rows: DataFrame, group: str, entity: str, flag: str, strong: str) -> DataFrame:
    """Of each group's entities, those with a flagged (and a strong) row: counts, prevalence and its Wilson interval."""
    each = rows.groupBy(group, entity).agg(F.bool_or(flag).alias("flag"), F.bool_or(strong).alias("strong"))
    out = each.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("k"), F.count_if("strong").alias("strong_k"), F.count_if(F.col("flag") & ~F.col("strong")).alias("weak_k"))
    low, high = stats.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return out.withColumns({"prevalence": F.col("k") / F.col("n"), "wilson95_lo": low, "wilson95_hi": high})


def paired_summary(pairs: DataFrame, key: list[str], base: str, treated: str) -> DataFrame:
    """Rates of two 0/1 columns, the four cells of their table, reductions, McNemar's statistic, h and kappa."""
    cells = {f"n{i}{j}": F.count_if((F.col(base) == i) & (F.col(treated) == j)) for i in (0, 1) for j in (0, 1)}
    out = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(base).alias("base_rate"), F.avg(treated).alias("treated_rate"), *[c.alias(k) for k, c in cells.items()])
    d = {k: F.col(k).cast("double") for k in cells}
    return out.withColumns({
        "absolute_reduction": F.col("base_rate") - F.col("treated_rate"),
        "relative_reduction": (F.col("base_rate") - F.col("treated_rate")) / F.nullif(F.col("base_rate"), F.lit(0.0)),
        "mcnemar": stats.mcnemar(d["n10"], d["n01"]),
        "cohens_h": stats.cohens_h(F.col("base_rate"), F.col("treated_rate")),
        "kappa": stats.kappa(d["n11"], d["n10"], d["n01"], d["n00"]),
        "agreement": (d["n11"] + d["n00"]) / F.col("n"),
    })


def binary_quality(df: DataFrame, key: list[str], truth: str, guess: str, least: int = 10) -> DataFrame:
    """Precision, recall, F1 and support of 0/1 guesses by key, for keys with ``least`` judged rows or more."""
    tp, fp, fn = (F.count_if((F.col(truth) == t) & (F.col(guess) == g)) for t, g in ((1, 1), (0, 1), (1, 0)))
    out = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).where(F.col("n") >= least)
    precision, recall = (F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col(x), F.lit(0)), F.lit(0.0)) for x in ("fp", "fn"))
    return out.withColumns({"precision": precision, "recall": recall, "support": F.col("tp") + F.col("fn")}).withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def signature(df: DataFrame) -> DataFrame:
    """One digest of a table's rows, whatever their order: from their number and the sums of the four 32-bit parts of their
    128-bit hashes. Repeated rows count as often as they are."""
    row = F.md5(F.concat_ws("~", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)]))
    lanes = [F.coalesce(F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)]
    return df.agg(F.sha1(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *lanes)).alias("signature"))


def tier_summary(facts: DataFrame, model: str, tier: str, bias: str, value: str, count: str) -> DataFrame:
    """Mean of ``value`` and sum of ``count`` by model and tier, with the mean of a model's biases as its baseline."""
    base = facts.select(model, bias, value).groupBy(model, bias).agg(F.avg(value).alias("_b")).groupBy(model).agg(F.avg("_b").alias("baseline"))
    out = facts.groupBy(model, tier).agg(F.avg(value).alias("mean"), F.sum(count).alias("n"))
    return out.join(base, model).withColumn("delta", F.col("mean") - F.col("baseline"))
