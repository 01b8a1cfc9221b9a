"""Quantiles by selection, adjusted p-values over ranges, exact and score tests, order-free signatures."""

import itertools
import math
import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pairlens.functions import stats
from pairlens.operators import inference as E, rates as R, shared


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    shares = [0.0, 0.2, 0.25, 0.5, 0.99, 1.0]
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 50 + [6.0] * 3, "many": rng.normal(size=3000).tolist(), None: [0.5, -0.5, 7.0], "nulls": [None, None]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("many", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.quantiles for r in shared.exact_quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(groups) and got.pop("nulls") == [None] * 6
    for k, q in got.items():
        assert np.allclose(q, np.quantile(groups[k], shares), rtol=1e-12)
    every = [v for values in groups.values() for v in values if v is not None]
    assert np.allclose(shared.exact_quantiles(df, [], "v", shares).first().quantiles, np.quantile(every, shares))
    assert shared.exact_quantiles(df.limit(0), ["k"], "v", shares).count() == 0
    med = {(r.k, r.c): r["median"] for r in R.medians(df.withColumn("c", F.lit("c")), "v", "k", "c", "all").collect()}
    assert med[("ties", "c")] == 5.0 and math.isclose(med[("all", "c")], np.median(every))


def test_no_buffer_of_all_values(spark):
    """No aggregate with a buffer of its own type, and no window over all rows of a key."""
    df = spark.range(1000).select(F.rand(1).alias("v"), (F.col("id") % 3).alias("k"))
    plan = shared.exact_quantiles(df, ["k"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan and "collect" not in plan


def naive(p):
    """q-values in one family by the definition: the least p m / rank of all that are no smaller."""
    known = sorted(x for x in p if x is not None)
    m = len(known)
    return [None if x is None else min(1.0, min(y * m / (i + 1) for i, y in enumerate(known) if y >= x)) for x in p]


def test_q_values_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([None, round(rng.random() ** 3, 2), rng.random() ** 4])) for i in range(900)] + [(900 + i, "c", None) for i in range(3)] + [(950, None, 0.04)]
    df = spark.createDataFrame(rows, "i int, f string, p double").repartition(7)
    got = {r.i: r.q for r in R.benjamini_hochberg(df, "p", ["f"]).collect()}
    for f in ("a", "b", "c", None):
        own = [r for r in rows if r[1] == f]
        assert all(got[i] is None if q is None else math.isclose(got[i], q, rel_tol=1e-12) for (i, _, _), q in zip(own, naive([r[2] for r in own]), strict=True))
    whole = {r.i: r.q for r in R.benjamini_hochberg(df, "p", [], missing=1.0).collect()}
    assert all(math.isclose(whole[r[0]], q, rel_tol=1e-12) for r, q in zip(rows, naive([1.0 if r[2] is None else r[2] for r in rows]), strict=True))
    assert R.benjamini_hochberg(df.limit(0), "p", []).count() == 0


def test_u_of_unequal_samples():
    """Against all subsets; the same for either order; large samples at once."""
    for n1, n2 in ((1, 1), (1, 7), (2, 5), (3, 4), (5, 6)):
        sums = [sum(s) - n1 * (n1 - 1) // 2 for s in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            top = max(u, n1 * n2 - u)
            want = min(1.0, 2 * sum(s >= top for s in sums) / len(sums))
            assert math.isclose(stats.exact_u_p(u, n1, n2), want, rel_tol=1e-12) and math.isclose(stats.exact_u_p(u, n2, n1), want, rel_tol=1e-12)
    began = time.time()
    p = stats.exact_u_p(2100, 2000, 5)
    assert p == stats.exact_u_p(2100, 5, 2000) and time.time() - began < 1 and 0 < p < 0.05
    assert math.isclose(stats.exact_u_p(0, 8, 3000), 2 / math.comb(3008, 8), rel_tol=1e-9)
    limit, stats.COUNTED_U = stats.COUNTED_U, 0
    try:
        for u in (10_000, 60_000, 79_000):  # the limit of large samples is near the count
            near = stats.exact_u_p(u, 4, 40_000)
            stats.COUNTED_U = limit
            assert math.isclose(near, stats.exact_u_p(u, 4, 40_000), rel_tol=2e-3)
            stats.COUNTED_U = 0
    finally:
        stats.COUNTED_U = limit


def binomial_tail(n, k, q):
    return sum(math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k, n + 1))


def test_exact_rates_against_counting():
    cases = [(x1, x0, t1, t0) for x1 in range(6) for x0 in range(6 - x1) for t1, t0 in ((100, 100), (50, 400)) if x1 + x0] + [(7, 9, 1000, 300), (18, 1, 70, 80)]
    x1, x0, t1, t0 = (np.array(c, float) for c in zip(*cases, strict=True))
    p, low, high = stats.exact_rates(x1, t1, x0, t0)
    for i, (a, b, s, t) in enumerate(cases):
        n, share = a + b, s / (s + t)
        mass = [math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1)]
        assert math.isclose(p[i], min(1, sum(m for m in mass if m <= mass[a] * (1 + 1e-7))), rel_tol=1e-9)
        at = lambda ratio: ratio * s / (ratio * s + t)  # noqa: B023, E731
        assert (low[i] == 0) if a == 0 else math.isclose(binomial_tail(n, a, at(low[i])), 0.025, rel_tol=1e-6)
        assert math.isinf(high[i]) if b == 0 else math.isclose(1 - binomial_tail(n, a + 1, at(high[i])), 0.025, rel_tol=1e-6)


def test_score_interval_is_what_the_test_keeps(spark):
    rows = [(7.0, 100.0, 5.0, 80.0), (1.0, 300.0, 12.0, 90.0), (300.0, 9000.0, 200.0, 9500.0), (4.0, 10.0, 0.0, 20.0)]
    df = spark.createDataFrame(rows, "x1 double, t1 double, x0 double, t0 double")
    low, high = stats.score_rate_interval(*[F.col(c) for c in df.columns])
    for r in df.select("*", low.alias("low"), high.alias("high")).collect():
        z = lambda ratio: (r.x1 - r.x0 * ratio * r.t1 / r.t0) / math.sqrt((r.x1 + r.x0) * ratio * r.t1 / r.t0)  # noqa: B023, E731
        assert math.isclose(z(r.low), 1.959963984540054, rel_tol=1e-9)
        assert math.isinf(r.high) if r.x0 == 0 else math.isclose(z(r.high), -1.959963984540054, rel_tol=1e-9)


def words_of(x1, x0, rest1=40, rest0=60):
    return [("g", True, ["w"] * x1 + ["rest"] * rest1), ("g", False, ["w"] * x0 + ["rest"] * rest0)]


def test_word_effects_by_total(spark):
    """Exact up to 5, score beyond; what one side lacks has an effect alone; small groups go."""
    for x1, x0 in ((3, 2), (9, 4), (25, 30), (5, 0)):
        df = spark.createDataFrame(words_of(x1, x0), "g string, flag boolean, words array<string>")
        r = E.word_effects(df, "g", "flag", "words").where("word = 'w'").first()
        t1, t0 = x1 + 40, x0 + 60
        if x0 == 0:
            assert r.p is None and r.q is None and r.ci_low is None and math.isclose(r.effect, math.log((x1 + 0.5) / t1) - math.log(0.5 / t0))
            continue
        assert math.isclose(r.effect, math.log(x1 / t1) - math.log(x0 / t0)) and r.ci_low < r.effect < r.ci_high
        if x1 + x0 <= 5:
            p, low, high = (v[0] for v in stats.exact_rates(*[np.array([float(v)]) for v in (x1, t1, x0, t0)]))
            assert math.isclose(r.p, p) and math.isclose(r.ci_low, math.log(low)) and math.isclose(r.ci_high, math.log(high))
        else:
            z = (x1 - x0 * t1 / t0) / math.sqrt((x1 + x0) * t1 / t0)
            assert math.isclose(r.p, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9)
    few = spark.createDataFrame(words_of(3, 3, 2, 60), "g string, flag boolean, words array<string>")
    assert E.word_effects(few, "g", "flag", "words").count() == 0
    both = spark.createDataFrame([*words_of(9, 4), *[("h", f, w) for _, f, w in words_of(9, 4)]], "g string, flag boolean, words array<string>")
    q = {(r.g, r.word): (r.p, r.q) for r in E.word_effects(both, "g", "flag", "words").collect()}
    one = {r.word: (r.p, r.q) for r in E.word_effects(both.where("g = 'g'"), "g", "flag", "words").collect()}
    assert all(q[(g, w)] == v for w, v in one.items() for g in "gh")  # a family for each group


def test_cue_effects_of_small_counts(spark):
    for x1, x0 in ((3, 2), (8, 5)):
        rows = [("g", True, x1, 500), ("g", False, x0, 900)]
        df = spark.createDataFrame(rows, "g string, flag boolean, feat_a int, tokens int")
        r = E.cue_effects(df, "g", "flag", ["a"], "tokens").first()
        assert math.isclose(r.effect, math.log(x1 / 500) - math.log(x0 / 900)) and r.ci_low < r.effect < r.ci_high
        if x1 + x0 <= 5:
            p, low, high = (v[0] for v in stats.exact_rates(*[np.array([float(v)]) for v in (x1, 500, x0, 900)]))
            assert math.isclose(r.p, p) and math.isclose(r.ci_low, math.log(low)) and math.isclose(r.se, math.log(high / low) / 3.92)


def test_signature_uses_all_bits(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": range(50), "b": list("xy") * 25}))
    sig = R.signature(df).first().signature
    assert sig == R.signature(df.repartition(7, "a")).first().signature
    assert len({sig, *(R.signature(d).first().signature for d in (df.unionByName(df.limit(1)), df.where("a < 49"), df.withColumn("b", F.when(F.col("a") == 3, "z").otherwise(F.col("b")))))}) == 4
