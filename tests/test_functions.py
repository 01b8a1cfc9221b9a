import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pairlens.functions import labels as L, stats, text as T
from pairlens.operators import pairs as P, rates as R, similarity as M, inference as E


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_published_figures(spark):
    """Two models of 40 pairs: rates 0.400 to 0.275 and 0.300, p 0.359 and 0.386, h 0.265 and 0.210."""
    row = spark.createDataFrame([(0.4, 0.275, 0.3)], "a double, b double, c double").select(stats.cohens_h(F.col("a"), F.col("b")), stats.cohens_h(F.col("a"), F.col("c"))).first()
    assert [round(v, 3) for v in row] == [0.265, 0.21]
    low, high = stats.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(3.0, 30.0), (12.0, 12.0), (0.0, 0.0)], "k double, n double").select(low, high).collect()
    assert [round(x, 4) for x in r[0]] == [0.0346, 0.2562] and round(r[1][0], 4) == 0.7575 and r[2][0] is None


def test_p_values():
    assert math.isclose(stats.student_p(2.0, 10), 0.07338803, rel_tol=1e-6)
    assert math.isclose(stats.student_quantile(0.95, 5), 2.5705818, rel_tol=1e-6)
    assert math.isclose(stats.exact_u_p(0, 3, 3), 0.1) and math.isclose(stats.exact_u_p(2, 4, 5), 0.06349206, rel_tol=1e-6)


@pytest.mark.parametrize(("answer", "want"), [
    ("Decision: A\nDecision: B", "Option B"), ("**Decision:** option a.", "Option A"), ("Answer:\n\nOption B", "Option B"), ("Decision: Option A and Option B", "Option A"),
    ("Decision: neither", None), ("no", None), ("", None), ("# Answer:\n\noption B\nmore", "Option B"), ("Option: A", "Option A"), ("Decision (final):\n* \"Option B\"", None), ("*Decision* ( ):\n* Option B", "Option B"),
    ("My decision is clear. Decision: both option b and option b", "Option B"), ("Decision:\n\n", None), ("Decision: A\nthe decision was easy", "Option A"), ("DECISION: **A**", "Option A"), ("Decision: I take option b", "Option B"), (None, None),
])
def test_decisions(spark, answer, want):
    assert one(spark, T.decision(F.col("x")), x=answer) == want


def test_labelled_lines_and_sections(spark):
    say = lambda f, x: one(spark, f(F.col("x")), x=x)
    assert say(T.explanation, "Explanation: one.\nExplanation:\n\n*two*.\nend") == "two" and say(T.explanation, "none") == ""
    assert say(T.best_practices, "**Best Practices:** *keep it small*") == "keep it small" and say(T.best_practices, "Best practices") == ""
    assert [say(T.validation, x) for x in ("Decision: Yes, no doubt", "Answer: I say yes", "Decision: yes\nDecision: no", "Decision: not yes", "yes")] == [True, True, False, False, False]
    section = lambda a, f, n: f"# Axioms of it\n\n```prolog\n{a}\n```\ntext\n## Facts\n```prolog\n{f}\n```\n3. NL:\n{n}"
    assert say(T.axioms_description, section("a.", "f.", "\n```\nit holds\n```")) == "it holds"
    assert say(T.axioms_description, section("a.", "f.", "first\nsecond")) == "first"
    assert [say(T.axioms_description, x) for x in (section(" ", "f.", "x"), section("a.", "", "x"), section("a.", "f.", ""), "Facts\n```prolog\nf\n```\nAxioms\n```prolog\na\n```\nNL\nx", "", None)] == [""] * 6


def test_text(spark):
    code = "Look:\n```py\nx = 1\n```\nuse `f()` here\n# comment\nimport os\nfor (i = 0; i < 3; i++) {\n  - a point\nété là"
    assert one(spark, T.strip_code(F.col("x")), x=code) == "Look: use here - a point"
    assert one(spark, T.strip_code(F.col("x"), unicode_letters=True), x=code).endswith("été là")
    assert one(spark, F.size(T.tokens(F.col("x"))), x="été là, a_b 3") == 4
    assert one(spark, T.parse_bool(F.col("x")), x="well\n it is\n Yes.") is True and one(spark, T.parse_label(F.col("x")), x="so\nlabel 7") == 7
    assert one(spark, T.clamp_span(F.col("s"), F.col("t")), s="HELLO", t="say Hello") == "Hello" and one(spark, T.clamp_span(F.col("s"), F.col("t")), s="x", t="say") == ""
    assert one(spark, T.axioms_description(F.col("x")), x="1. Axioms\n```prolog\na.\n```\n2. Facts\n```prolog\nb.\n```\n3. NL\nbest practice is: test") == "best practice is: test"
    assert one(spark, T.levenshtein_similarity(F.col("a"), F.col("b")), a="", b="") == 1.0 and one(spark, T.levenshtein_similarity(F.col("a"), F.col("b")), a="abcd", b="abed") == 0.75
    assert T.lexicon_patterns({"neg": {"not", "n't"}, "re": ["a+", "b"]}) == {"neg": r"(?:n['’]t|\bnot\b)", "re": "(?:a+|b)"}
    assert one(spark, T.to_binary(F.col("x")), x=" Yes ") == 1 and one(spark, T.to_binary(F.col("x")), x="?") is None
    flags = T.codebook_flags(spark.createDataFrame([("Everyone recommend it; I'm sure",)], "t string"), "t").first()
    assert flags.bandwagon_cues_strong == flags.overconfidence_cues_strong == flags.overconfidence_cues_weak == 1 and flags.hindsight_cues_any == 0


def test_spans_where_lower_case_is_longer(spark):
    for span, text, want in (("HELLO", "İİ say Hello", "Hello"), ("i̇x", "an İX here", ""), ("İx", "an i̇x, İX", "İX"), ("x" * 9, "İ", ""), ("", "İ", ""), ("ß", "MASSE ß", "ß")):
        assert one(spark, T.clamp_span(F.col("s"), F.col("t")), s=span, t=text) == want, span


def test_large_blocks_are_refused(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 3)
    monkeypatch.setattr(M, "LABELS", 1)
    df = spark.createDataFrame([(i, "g", [1.0, i + 0.0]) for i in range(4)], "i long, g string, v array<double>")
    for f in (lambda: M.similar_pairs(df, "g", "i", "v", 0.5), lambda: M.correlations(df.withColumn("x", F.lit(1.0)), "g", "i", "x"), lambda: M.nearest_labels(df, "i", "v", df.select(F.col("i").alias("l"), F.col("v").alias("label_vector")), "l", 1, 0.5)):
        with pytest.raises(ValueError, match="more than"):
            f()


def test_sets_and_prevalence(spark):
    from pairlens.operators import reports as O

    k = lambda *x: spark.createDataFrame([(v,) for v in x], "k long")
    got = {r.k: r.members for r in O.set_parts({"b": k(1, 2, 2), "a": k(2, 3)}, k(1, 2, 9, 9), "k").collect()}
    assert got == {1: ["b"], 2: ["a", "b"], 3: ["a"], 9: []}
    rows = spark.createDataFrame([("x", 1), ("x", 5), (None, 5)], "g string, v int")
    assert {tuple(r) for r in O.prevalence(rows, "g", F.col("v") > 3, "all").collect()} == {("x", 2, 1, 50.0), (None, 1, 1, 100.0), ("all", 3, 2, 200 / 3)}
    assert {r.g for r in O.of_frequent(rows, "g", 2).collect()} == {"x"}


def test_labels(spark):
    assert one(spark, L.normalize_bias(F.col("x"), {"anchoring": "anchoring bias"}), x="  Anchoring ") == "anchoring bias"
    assert one(spark, L.clean_tier(F.col("x")), x="Mid Low") == "mid-low" and one(spark, L.clean_tier(F.col("x")), x="top") is None
    assert L.header_key(" Bias-Type (a) ") == "bias_type_a" and one(spark, L.ellipsis(F.col("x"), 4), x="abc def") == "abc…"


def test_false_discovery(spark):
    p = [0.01, 0.04, 0.03, 0.2, None]
    q = {r.p: r.q for r in R.benjamini_hochberg(spark.createDataFrame([(v,) for v in p], "p double"), "p", []).collect()}
    assert q[None] is None and [round(q[v], 6) for v in p[:4]] == [0.04, 0.053333, 0.053333, 0.2]


def test_poisson_regression_agrees_with_newton(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [("b", bool(i % 2), int(rng.poisson(2 + i % 2)), int(rng.integers(20, 90))) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, flag boolean, feat_f long, tokens long")
    got = E.cue_effects(df, "g", "flag", ["f"], "tokens", "glm", p_values=False).first()
    y, t = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
    x = np.stack([np.ones(200), [float(r[1]) for r in rows]], axis=1)
    b = np.array([np.log(y.sum() / t.sum()), 0.0])
    for _ in range(50):
        mu = t * np.exp(x @ b)
        b += np.linalg.solve(x.T @ (mu[:, None] * x), x.T @ (y - mu))
    bread = np.linalg.inv(x.T @ (mu[:, None] * x))
    cov = bread @ (x.T @ (((y - mu) ** 2)[:, None] * x)) @ bread * 200 / 198
    assert math.isclose(got.effect, b[1], rel_tol=1e-9) and math.isclose(got.se, cov[1, 1] ** 0.5, rel_tol=1e-9)


def test_rank_tests_count_ties_and_small_groups(spark):
    v = [("k", "base", x) for x in (1.0, 2.0, 3.0)] + [("k", "s", x) for x in (4.0, 5.0, 6.0)] + [("k", "t", x) for x in (1.0, 1.0, 2.0)]
    got = {r.c: r for r in E.rank_tests(spark.createDataFrame(v, "k string, c string, x double"), ["k"], "c", "base", "x").collect()}
    assert got["s"].u == 9 and math.isclose(got["s"].p, 0.1) and got["s"].effect == -1 and got["t"].u == 2.5 and got["t"].ties == 30.0


def test_groups_of_similar_vectors(spark):
    df = spark.createDataFrame([(i,) for i in range(8)], "i long")
    pairs = spark.createDataFrame([(0, 5), (3, 5), (3, 7)], "a long, b long")
    assert sorted(r.i for r in M.keep_first_of_similar(df, "i", pairs).collect()) == [0, 1, 2, 4, 6]


def test_spans_and_ids(spark):
    df = spark.createDataFrame([("I think we surely should use it, right?", "I think we should use it.")], "b string, u string")
    r = df.select(P.inserted_spans("b", "u").alias("s"), P.largest_change("b", "u").alias("l")).first()
    assert r.s == ["surely", ", right?"] and r.l == "it, right?"
    marks = spark.createDataFrame([("do it (now) , please !", "do it")], "b string, u string")
    assert marks.select(P.inserted_spans("b", "u").alias("s")).first().s == ["( now ), please!"]  # only these marks join their word
    ids = P.dense_ids(spark.range(100).withColumn("v", -F.col("id")), ["v"], "n").collect()
    assert all(x.n == 99 - x.id for x in ids)


def value(spark, f, *args):
    names = [f"a{i}" for i in range(len(args))]
    return spark.createDataFrame([tuple(map(float, args))], ", ".join(f"{n} double" for n in names)).select(f(*names)).first()[0]


def test_published_tests_of_pairs(spark):
    """40 pairs: 16 to 11 with 19 that change gives p 0.359, 16 to 12 with 12 that change gives p 0.386."""
    for gone, new, want in ((12, 7, 0.359), (8, 4, 0.386)):
        statistic = spark.createDataFrame([(float(gone), float(new))], "b double, c double").select(stats.mcnemar(F.col("b"), F.col("c"))).first()[0]
        assert round(value(spark, stats.chi2_p, statistic), 3) == want


def test_p_values_against_counting(spark):
    rng = random.Random(1)
    for x1, t1, x0, t0 in ((3, 100, 0, 100), (1, 50, 4, 200), (2, 10, 2, 10), (5, 30, 0, 90)):
        n, q = x1 + x0, t1 / (t1 + t0)
        mass = {k: 0.0 for k in range(n + 1)}
        for hits in itertools.product((0, 1), repeat=n):
            mass[sum(hits)] += math.prod(q if h else 1 - q for h in hits)
        want = sum(m for m in mass.values() if m <= mass[x1] * (1 + 1e-7))
        assert math.isclose(value(spark, stats.exact_rate_p, x1, t1, x0, t0), min(1, want), rel_tol=1e-9)
    # The score test's normal tail against drawn splits of the same total.
    drawn = [sum(rng.random() < 0.5 for _ in range(60)) for _ in range(20_000)]
    far = sum(abs(d - 30) >= 7.5 for d in drawn) / len(drawn)
    assert abs(value(spark, stats.score_rate_p, 38, 100, 22, 100) - far) < 0.02
    # Mann-Whitney with ties and larger groups: shuffles of the pooled values.
    pool, n1 = [i // 2 for i in range(40)], 18
    ties = sum(pool.count(v) ** 3 - pool.count(v) for v in set(pool))
    rank = {v: sum(x < v for x in pool) + (pool.count(v) + 1) / 2 for v in set(pool)}
    u = lambda s: sum(rank[v] for v in s) - n1 * (n1 + 1) / 2
    mid = n1 * (40 - n1) / 2
    seen = [abs(u(rng.sample(pool, n1)) - mid) for _ in range(8000)]
    assert abs(value(spark, stats.mann_whitney_p, mid + 60, n1, 40 - n1, ties) - sum(x >= 60 for x in seen) / len(seen)) < 0.02


def test_bootstrap_against_resampling(spark):
    rows = [(0, 0)] * 9 + [(1, 0)] * 12 + [(0, 1)] * 5 + [(1, 1)] * 14
    df = spark.createDataFrame([("m", a, b) for a, b in rows], "model string, a int, b int")
    got = E.bootstrap_means(df, "model", "a", "b").first()
    rng = random.Random(2)
    means = sorted(sum(a - b for a, b in rng.choices(rows, k=40)) / 40 for _ in range(4000))
    assert abs(got.difference_low - means[100]) < 0.04 and abs(got.difference_high - means[-101]) < 0.04


def test_rates_without_cues_and_overdispersed(spark):
    """Scaled errors where counts spread more than a Poisson's, and the closed form where they don't."""
    rows = [("s", i % 2 == 0, 100, (0 if i % 4 < 2 else 20) if wide else 10) for wide in (True,) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, flag boolean, tokens int, feat_x int")
    r = E.cue_effects(df, "g", "flag", ["x"], "tokens").first()
    assert math.isclose(r.effect, 0, abs_tol=1e-9) and r.se > 1.5 * math.sqrt(2 / 200)


def test_two_step_and_instructions(spark):
    from pairlens.operators import scoring as S

    asked = spark.createDataFrame([("k1", "q1"), ("k2", "q2")], "key string, prompt string")
    scorer = lambda d: d.select("key", F.concat(F.lit("Best practices:\n- "), "prompt").alias("answer"))
    build = lambda d: d.withColumn("prompt", F.concat(F.lit("again "), F.coalesce("cues", F.lit("none"))))
    got = {r.key: r.answer for r in S.two_step(asked, "key", scorer, build).collect()}
    assert got["k1"].startswith("Best practices:\n- again") and set(got) == {"k1", "k2"}
    rules = [("warn", "Beware.", True), ("last", "Be short.", False)]
    said = spark.createDataFrame([(["last", "warn"],), (["last"],), ([],)], "flags array<string>").select(P.instructions(F.col("flags"), rules, "Answer.")).collect()
    assert [r[0] for r in said] == ["Beware.\nAnswer.\nBe short.", "Answer.\nBe short.", "Answer."]


def test_running_totals_and_places(spark):
    from pairlens.operators.shared import places_by_hash, running_total

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, n int")
    want = {(k, i): sum(n for q, j, n in rows if q == k and j < i) for k, i, _ in rows}
    assert {(r.k, r.i): r.before for r in running_total(df, ["k"], "i", "n", "before").collect()} == want
    places = {}
    for r in places_by_hash(df, ["k"], F.md5(F.col("i").cast("string")), "i").collect():
        places.setdefault(r.k, []).append((r._place, hashlib.md5(str(r.i).encode()).hexdigest()))
    for found in places.values():
        assert [p for p, _ in sorted(found)] == list(range(1, len(found) + 1)) and [h for _, h in sorted(found)] == sorted(h for _, h in found)


def test_report_tables(spark):
    from pairlens.operators import reports as O

    assert O.stamped(spark.range(1)).first().processed_at.endswith("Z")
    top = O.top_k_filled(spark.createDataFrame([(1,), (2,)], "q int"), spark.createDataFrame([("a",), ("b",), ("c",)], "d string"), spark.createDataFrame([(1, "c", 0.5)], "q int, d string, score double"), "q", "d", [], 2)
    assert sorted((r.q, r.place, r.d, r.score) for r in top.collect()) == [(1, 0, "c", 0.5), (1, 1, "a", 0.0), (2, 0, "a", 0.0), (2, 1, "b", 0.0)]
    assert O.without_sources(spark.createDataFrame([("Src1",), (None,), ("x",)], "s string"), "s", "src").count() == 2
