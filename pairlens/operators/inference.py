"""Rank and paired tests, effects of cues: aggregates over the cluster, closed forms over their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairlens.functions import stats
from pairlens.operators.rates import benjamini_hochberg
from pairlens.operators.shared import null_safe_join, running_total


def versus_baseline(values: DataFrame, keys: list[str], column: str, baseline: str, value: str) -> DataFrame:
    """Mann-Whitney tests of each column's values against the baseline's, by ``keys``.

    Values are ranked in the pool of both samples, ties by mean rank; medians come from the same ranked counts. Returns keys, column, n1, n2, u (of the column),
    ties (sum of t^3 - t), medians, their difference, effect (1 - 2u / (n1 n2), positive where the column is lower).
    """
    d = values.where(F.col(value).isNotNull()).select(*keys, F.col(column).alias("cell"), F.col(value).alias("v"))
    cells = d.where(F.col("cell") != baseline)
    # Counts of different values: those of the baseline, not its rows, are copied for each cell.
    own = cells.groupBy(*keys, "cell", "v").agg(F.count(F.lit(1)).alias("own")).withColumn("t", F.col("own"))
    base = d.where(F.col("cell") == baseline).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("t"))
    named = cells.select(*keys, "cell").distinct()
    paired = (base.join(named, keys) if keys else base.crossJoin(named)).withColumn("own", F.lit(0).cast("long"))
    tied = own.unionByName(paired).groupBy(*keys, "cell", "v").agg(F.sum("t").alias("t"), F.sum("own").alias("own"))
    tied = running_total(tied.withColumn("other", F.col("t") - F.col("own")), [*keys, "cell"], "v", ["t", "own"], ["before", "own_before"])
    tied = tied.withColumns({"rank": F.col("before") + (F.col("t") + 1) / 2, "other_before": F.col("before") - F.col("own_before")})
    sums = tied.groupBy(*keys, "cell").agg(F.sum("own").alias("n1"), F.sum("other").alias("n2"), F.sum(F.col("rank") * F.col("own")).alias("r1"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))

    def middle(before: str, own: str, n: str) -> Column:
        """The mean of the two values in the middle (of an odd number, of one)."""
        at = lambda place: F.max(F.when((F.col(before) <= place) & (place < F.col(before) + F.col(own)), F.col("v")))
        return (at(F.floor((F.col(n) - 1) / 2)) + at(F.floor(F.col(n) / 2))) / 2

    sized = null_safe_join(tied.select(*keys, "cell", "v", "own", "other", "own_before", "other_before"), sums.select(*keys, "cell", "n1", "n2"), [*keys, "cell"])
    middles = sized.groupBy(*keys, "cell").agg(middle("own_before", "own", "n1").alias("median"), middle("other_before", "other", "n2").alias("median_baseline"))
    out = null_safe_join(sums, middles, [*keys, "cell"]).withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    out = out.withColumns({"effect": 1 - 2 * F.col("u") / (F.col("n1") * F.col("n2")), "delta_median": F.col("median") - F.col("median_baseline")})
    return out.withColumnRenamed("cell", column).drop("r1")


def rank_tests(values: DataFrame, keys: list[str], column: str, baseline: str, value: str, family: list[str] | None = None) -> DataFrame:
    """``versus_baseline`` with p-values and false-discovery q-values within ``family`` (the keys by default)."""
    t = versus_baseline(values, keys, column, baseline, value)
    t = t.withColumn("p", stats.mann_whitney_p("u", "n1", "n2", "ties"))
    return benjamini_hochberg(t, "p", keys if family is None else family)


def aligned_units(values: DataFrame, unit: str, column: str, baseline: str, value: str) -> DataFrame:
    """One mean for each (unit, column), only of units that the column and the baseline both have."""
    one = values.groupBy(unit, column).agg(F.avg(value).alias(value))
    have = one.where(F.col(column) == baseline).select(unit)
    return one.join(have, unit, "left_semi")


def paired_t(values: DataFrame, keys: list[str], unit: str, column: str, high: str, low: str, value: str) -> DataFrame:
    """Paired t-tests of two columns over units: mean difference, t, n, p and a 95 % interval; at least two pairs."""
    pick = lambda name: F.avg(F.when(F.col(column) == name, F.col(value)))
    d = values.groupBy(*keys, unit).agg((pick(high) - pick(low)).alias("d")).where("d IS NOT NULL")
    out = d.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se")).where("n >= 2")
    out = out.withColumn("t", F.col("mean_diff") / F.nullif(F.col("se"), F.lit(0.0))).withColumn("df", (F.col("n") - 1).cast("double"))
    out = out.withColumns({"p": stats.t_test_p("t", "df"), "half": stats.t_quantile95("df") * F.col("se")})
    return out.withColumns({"ci_lower": F.col("mean_diff") - F.col("half"), "ci_upper": F.col("mean_diff") + F.col("half")}).drop("half", "df")


def cue_sums(df: DataFrame, group: str, flag: str, features: list[str], tokens: str) -> DataFrame:
    """For each group, feature and flag: rows and the sums that counts and rate regressions need, in one pass.

    Features are ``feat_<name>`` columns; rows are unpivoted, so the plan does not grow with pairs of features.
    """
    long = df.select(group, flag, F.col(tokens).alias("t0"), F.greatest(F.col(tokens), F.lit(1)).cast("double").alias("t"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"feat_{f}").cast("double").alias("y")) for f in features])).alias("r"))
    y, t = F.col("r.y"), F.col("t")
    return long.groupBy(group, F.col("r.feature").alias("feature"), flag).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("x"), F.sum("t0").alias("tokens"), F.sum(t).alias("offset"),
        F.sum(y * y).alias("yy"), F.sum(y * t).alias("yt"), F.sum(t * t).alias("tt"), F.sum(y * y / t).alias("yyt"),
    )


def cue_effects(df: DataFrame, group: str, flag: str, features: list[str], tokens: str, method: str = "auto", min_tokens: int = 10, hc1: bool = True, p_values: bool = True) -> DataFrame:
    """How cue rates differ by a boolean flag, by group and feature.

    ``method``: "poisson" (log rate ratio), "logit" (log-odds difference), "glm" (Poisson regression on the flag with a
    token offset and robust errors, in closed form) or "auto" (glm, scaled errors where overdispersed, and for totals
    below 20 p and interval of the exact or score test, see ``small_count_tests``). A zero count in a group falls back to "poisson".
    """
    sums = cue_sums(df, group, flag, features, tokens)
    both = sums.where(F.col(flag)).alias("a").join(sums.where(~F.col(flag)).alias("b"), [group, "feature"])
    c = lambda side, name: F.col(f"{side}.{name}").cast("double")
    x1, x0, t1, t0 = c("a", "x"), c("b", "x"), c("a", "tokens"), c("b", "tokens")
    wald, wald_se = stats.log_rate_ratio(x1, t1, x0, t0)
    odds, odds_se = stats.log_odds_difference(x1, t1, x0, t0)
    n = c("a", "n") + c("b", "n")
    some = {s: F.nullif(c(s, "x"), F.lit(0.0)) for s in "ab"}  # null where a group has no cue
    rates = {s: some[s] / c(s, "offset") for s in "ab"}
    robust = sum((c(s, "yy") - 2 * rates[s] * c(s, "yt") + rates[s] * rates[s] * c(s, "tt")) / (some[s] * some[s]) for s in "ab")
    chi2 = sum(c(s, "yyt") / rates[s] - c(s, "x") for s in "ab")
    phi = chi2 / F.greatest(n - 2, F.lit(1.0))
    glm_se = F.sqrt(robust * n / F.nullif(n - 2, F.lit(0.0)) if hc1 else robust)
    if method == "auto":
        glm_se = F.when(phi > 1.5, F.sqrt(phi * (1 / some["a"] + 1 / some["b"]))).otherwise(glm_se)
    positive = (x1 > 0) & (x0 > 0)
    few = positive & (x1 + x0 < 20) if method == "auto" else F.lit(False)
    if method == "poisson":
        effect, se = wald, wald_se
    elif method == "logit":
        effect, se = odds, odds_se
    else:
        effect = F.when(few, F.log(x1 / t1) - F.log(x0 / t0)).when(positive, F.log(rates["a"] / rates["b"])).otherwise(wald)
        se = F.when(positive & ~few, glm_se).otherwise(wald_se)
    out = both.where((t1 >= min_tokens) & (t0 >= min_tokens) & (x1 + x0 > 0)).select(
        group, "feature", effect.alias("effect"), se.alias("se"), F.col("a.x").alias("count_flagged"), F.col("b.x").alias("count_other"), F.col("a.tokens").alias("tokens_flagged"), F.col("b.tokens").alias("tokens_other"),
        (1000 * x1 / F.nullif(t1, F.lit(0.0))).alias("rate_flagged_per_1k"), (1000 * x0 / F.nullif(t0, F.lit(0.0))).alias("rate_other_per_1k"),
    )
    z = F.col("effect") / F.nullif(F.col("se"), F.lit(0.0))
    out = out.withColumns({"z": z, "ci_low": F.col("effect") - 1.96 * F.col("se"), "ci_high": F.col("effect") + 1.96 * F.col("se"), "direction": F.when(F.col("effect") > 0, "more").otherwise("less")})
    if not p_values:
        return out
    out = out.withColumn("p", stats.normal_p("z"))
    if method == "auto":
        out = small_count_tests(out, ["count_flagged", "tokens_flagged", "count_other", "tokens_other"], F.col("count_flagged") + F.col("count_other") < 20)
    out = benjamini_hochberg(out, "p", [], "q", missing=1.0)
    return out.withColumn("significant", F.col("q") < 0.05)


def small_count_tests(effects: DataFrame, counts: list[str], small: Column) -> DataFrame:
    """Put p and the interval ci_low to ci_high of log rate ratios right where ``small`` holds and both counts are above 0:
    by the exact conditional test for totals of up to 5, by the score test beyond. se is then the interval's half width over 1.96.

    ``counts`` names count and tokens of one group, then of the other.
    """
    args = [F.col(c).cast("double") for c in counts]
    total, both = args[0] + args[2], (args[0] > 0) & (args[2] > 0)
    out = effects.withColumn("_exact", stats.exact_rate_test(*[F.when(small & both & (total <= 5), a) for a in args]))
    score = small & both & (total > 5)
    low, high = stats.score_rate_interval(*args)
    by_score = stats.score_rate_p(*[F.when(score, a) for a in args])
    out = out.withColumn("_score", by_score)
    out = out.withColumns({
        "p": F.coalesce("_exact.p", "_score", "p"),
        "ci_low": F.when(F.col("_exact.p").isNotNull(), F.log("_exact.low")).when(score, F.log(low)).otherwise(F.col("ci_low")),
        "ci_high": F.when(F.col("_exact.p").isNotNull(), F.log("_exact.high")).when(score, F.log(high)).otherwise(F.col("ci_high")),
    })
    out = out.drop("_exact", "_score")
    if "se" in out.columns:
        out = out.withColumn("se", F.when(small & both, (F.col("ci_high") - F.col("ci_low")) / (2 * 1.96)).otherwise(F.col("se")))
        if "z" in out.columns:
            out = out.withColumn("z", F.col("effect") / F.nullif(F.col("se"), F.lit(0.0)))
    return out


def word_sums(df: DataFrame, group: str, flag: str, words: str, least: int = 3) -> DataFrame:
    """Counts of each word by flag, with the group's totals, for words of ``least`` occurrences or more."""
    long = df.select(group, flag, F.explode(words).alias("word"))
    n = long.groupBy(group, "word").agg(F.count_if(flag).alias("x1"), F.count_if(~F.col(flag)).alias("x0"))
    total = n.groupBy(group).agg(F.sum("x1").alias("t1"), F.sum("x0").alias("t0"))
    return n.where(F.col("x1") + F.col("x0") >= least).join(total, group)


def word_effects(df: DataFrame, group: str, flag: str, words: str, least: int = 3, min_tokens: int = 10, method: str = "auto") -> DataFrame:
    """Log rate ratios of words between flagged and other rows, with intervals, p-values, and q-values within each group.

    Groups in which a side has fewer than ``min_tokens`` words are left out. ``method`` "auto" takes the exact conditional
    test for totals of up to 5 and the score test beyond; a word that one side lacks has the ratio with a half added to
    each count, and null p, q and interval. "wald" adds the half to all counts and has p and interval for all.
    """
    s = word_sums(df, group, flag, words, least).where((F.col("t1") >= min_tokens) & (F.col("t0") >= min_tokens))
    c = {k: F.col(k).cast("double") for k in ("x1", "t1", "x0", "t0")}
    wald, wald_se = stats.log_rate_ratio(*c.values())
    if method == "wald":
        out = s.withColumns({"effect": wald, "ci_low": wald - 1.96 * wald_se, "ci_high": wald + 1.96 * wald_se}).withColumn("p", stats.normal_p(wald / wald_se))
    else:
        both = (F.col("x1") > 0) & (F.col("x0") > 0)
        out = s.withColumn("effect", F.when(both, F.log(c["x1"] / c["t1"]) - F.log(c["x0"] / c["t0"])).otherwise(wald))
        none = F.lit(None).cast("double")
        out = small_count_tests(out.withColumns({"p": none, "ci_low": none, "ci_high": none}), ["x1", "t1", "x0", "t0"], F.lit(True))
    return benjamini_hochberg(out, "p", [group])


def bootstrap_means(pairs: DataFrame, key: str, base: str, treated: str, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """95 % bootstrap intervals of the means of two 0/1 columns and of their difference.

    A resample of 0/1 pairs is a multinomial draw of the four cells of their table, so each key sends four counts to
    one task whatever its rows.
    """
    cells = pairs.groupBy(key).agg(*[F.count_if((F.col(base) == i) & (F.col(treated) == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])

    def draw(pdf):
        import numpy as np
        import pandas as pd

        rows = []
        for r in pdf.itertuples(index=False):
            n = np.array([r.n00, r.n01, r.n10, r.n11], float)
            rng = np.random.default_rng([seed, int(n.sum())])
            got = rng.multinomial(int(n.sum()), n / n.sum(), resamples) / n.sum()
            a, b = got[:, 2] + got[:, 3], got[:, 1] + got[:, 3]
            rows.append([getattr(r, key), *[float(v) for x in (a, b, a - b) for v in np.percentile(x, [2.5, 97.5])]])
        return pd.DataFrame(rows, columns=[key, "base_low", "base_high", "treated_low", "treated_high", "difference_low", "difference_high"])

    kind = dict(cells.dtypes)[key]
    return cells.groupBy(key).applyInPandas(draw, f"{key} {kind}, base_low double, base_high double, treated_low double, treated_high double, difference_low double, difference_high double")
