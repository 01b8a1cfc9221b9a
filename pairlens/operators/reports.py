"""Tables of reports: dimensions with defaults, matrices of one shape, counts that keep what nobody has, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pairlens.functions import stats
from pairlens.operators.rates import benjamini_hochberg, first_of, rates, with_tier
from pairlens.operators.shared import exact_quantiles


def with_dimension(df: DataFrame, column: str, dimension: DataFrame, other: str = "Other") -> DataFrame:
    """Add label, group and ord of a feature dimension (feature, label, group, ord); unknown features keep their name as
    label, are in group ``other``, and come last."""
    d = dimension.select(F.col("feature").alias("_feature"), "label", "group", "ord")
    last = dimension.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("_last"))
    out = df.join(d, F.col(column) == F.col("_feature"), "left").crossJoin(F.broadcast(last))
    return out.withColumns({"label": F.coalesce("label", column), "group": F.coalesce("group", F.lit(other)), "ord": F.coalesce("ord", "_last")}).drop("_feature", "_last")


def without_sources(df: DataFrame, column: str, pattern: str | None) -> DataFrame:
    """Rows whose source does not match ``pattern``, in any case; a null source matches nothing."""
    return df if not pattern else df.where(~F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False)))


def among(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose ``column`` is one of ``allowed``."""
    return df.where(F.col(column).isin(*allowed))


def coerced_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as 0 or 1: to numbers, rows with one that is none left out, clipped to 0 and 1, rounded half to even."""
    numbers = df.withColumns({c: F.col(c).try_cast("double") for c in columns}).dropna(subset=columns)
    return numbers.withColumns({c: F.bround(F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)), 0).cast("int") for c in columns})


def suffixed_join(base: DataFrame, ours: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_BASE", "_OURS")) -> DataFrame:
    """Inner join on ``keys``; columns that both have get suffixes."""
    clash = (set(base.columns) & set(ours.columns)) - set(keys)
    one, two = (d.withColumnsRenamed({c: c + s for c in clash}) for d, s in zip((base, ours), suffixes, strict=True))
    return one.join(two, keys)


def tier_rates(runs: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Rates by keys and tier, and the quartiles of ``metric`` of each key's own runs; tiers are cut by those of all runs."""
    q = exact_quantiles(runs, keys, metric, [0.25, 0.5, 0.75], "quartiles")
    tiers = rates(with_tier(runs, metric), (*keys, "tier")).where("tier IS NOT NULL")
    return tiers.join(q, keys)


def quartile_table(tiers: DataFrame, keys: list[str], order: Column, column: str = "quartiles") -> DataFrame:
    """The quartiles q1 to q3 of each key: those of its first tier in ``order`` that has three."""
    first = first_of(tiers.where(F.size(column) == 3), keys, [order])
    return first.select(*keys, *[F.col(column)[i].alias(f"q{i + 1}") for i in range(3)])


def first_counts(facts: DataFrame, row: str, column: str, value: str, order: list[str]) -> DataFrame:
    """The count of each row and column (it is the same in all its facts) as a matrix, with the largest of all."""
    table = facts.groupBy(row).pivot(column, order).agg(F.max(value))
    return table.crossJoin(F.broadcast(facts.agg(F.max(value).alias("largest"))))


def wide(cells: DataFrame, row: str, column: str, values: list[str], order: list[str], fill: dict[str, float] | None = None) -> DataFrame:
    """Matrices of one shape side by side: a column ``<column>_<value>`` for each value in ``order``; missing cells get ``fill``."""
    firsts = [F.first(v, ignorenulls=True).alias(v) for v in values]
    out = cells.groupBy(row).pivot(column, order).agg(*firsts)
    if len(values) == 1:
        out = out.withColumnsRenamed({c: f"{c}_{values[0]}" for c in order})
    return out.fillna({f"{c}_{v}": x for v, x in (fill or {}).items() for c in order})


def effect_matrices(cells: DataFrame, row: str, column: str, effect: str, q: str, order: list[str], level: float = 0.05) -> DataFrame:
    """The effects of ``wide`` (0 where missing), their q-values (1) and whether they are significant (0), on one shape."""
    d = cells.withColumns({"effect": F.col(effect), "q": F.coalesce(q, F.lit(1.0)), "significant": (F.coalesce(q, F.lit(1.0)) < level).cast("int")})
    return wide(d, row, column, ["effect", "q", "significant"], order, {"effect": 0.0, "q": 1.0, "significant": 0})


def top_significant(cells: DataFrame, row: str, column: str, effect: str, q: str, k: int, level: float = 0.05) -> DataFrame:
    """Of each row's significant cells, the ``k`` of largest absolute effect (ties by column)."""
    return first_of(cells.where(F.col(q) < level), [row], [F.abs(effect).desc(), F.col(column)], k, "place")


def best_cells(tests: DataFrame, row: str, column: str, order: Column) -> DataFrame:
    """Each row's cell of least median; ties go by largest absolute effect, then by ``order``."""
    return first_of(tests, [row], [F.col("median").asc_nulls_last(), F.abs("effect").desc_nulls_last(), order])


def adjusted(tests: DataFrame, p: str) -> DataFrame:
    """q-values over the whole result, where a missing p counts as 1."""
    return benjamini_hochberg(tests, p, [], missing=1.0)


def label_prevalence(mapped: DataFrame, labels: DataFrame, label: str, threshold: float, total: str = "ANY") -> DataFrame:
    """How many rows are mapped to each label, 0 for one that none is, and in all: label (string), n, k, pct, threshold."""
    n = mapped.agg(F.count(F.lit(1)).alias("n"), F.count_if("mapped").alias("_all"))
    k = mapped.where("mapped").groupBy(label).agg(F.count(F.lit(1)).alias("_k"))
    each = labels.select(label).join(k, label, "left").select(F.col(label).cast("string").alias(label), F.coalesce("_k", F.lit(0)).cast("long").alias("k"))
    both = each.crossJoin(F.broadcast(n)).select(label, "n", "k").unionByName(n.select(F.lit(total).alias(label), "n", F.col("_all").alias("k")))
    return both.withColumns({"pct": 100.0 * F.col("k") / F.nullif(F.col("n"), F.lit(0)), "threshold": F.lit(threshold)})


def prevalence(rows: DataFrame, key: str, flag: Column, total: str = "ANY") -> DataFrame:
    """Rows, flagged rows and their percentage of each key, and of all under the name ``total``, in one pass."""
    out = rows.groupingSets([[F.col(key)], []], key).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("k"), F.grouping(key).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, total).otherwise(F.col(key)).alias(key), "n", "k", (100.0 * F.col("k") / F.nullif(F.col("n"), F.lit(0))).alias("pct"))


def counted_dimension(dimension: DataFrame, facts: DataFrame, key: str, fact_key: str, out: str) -> DataFrame:
    """All rows of a dimension with the number of their facts as ``out``; 0 where there are none."""
    n = facts.groupBy(F.col(fact_key).alias("_fact_key")).agg(F.count(F.lit(1)).alias("_n"))
    return dimension.join(n, F.col(key) == F.col("_fact_key"), "left").withColumn(out, F.coalesce("_n", F.lit(0)).cast("long")).drop("_n", "_fact_key")


def of_frequent(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys that have ``least`` rows or more."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key), key, "left_semi")


def set_parts(sets: dict[str, DataFrame], universe: DataFrame, key: str) -> DataFrame:
    """How sets of ``key`` share the values of ``universe`` and their own: a row (key, members) for each different value, members
    the sorted names of the sets that have it; none for a value of the universe alone. One pass and one shuffle, whatever the number of sets."""
    rows = universe.select(F.col(key), F.lit(None).cast("string").alias("_set"))
    for name, d in sets.items():
        rows = rows.unionByName(d.select(F.col(key), F.lit(name).alias("_set")))
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("_set")).alias("members"))  # of as many names as sets


def distinct_counts(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Rows, and different values of each of ``columns`` (under the names given), by ``keys``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(name) for c, name in columns.items()])


def top_k_filled(queries: DataFrame, docs: DataFrame, scores: DataFrame, query_id: str, doc_id: str, block: list[str], k: int) -> DataFrame:
    """The k best documents of each query in its block; where fewer have a score, the first of the others at 0.

    Documents without a score are equal, so only the first k of a block can be needed: no pairs are made beyond these.
    """
    few = first_of(docs.select(*block, doc_id), block, [F.col(doc_id)], k) if block else docs.select(doc_id).orderBy(doc_id).limit(k)
    asked = queries.select(*block, query_id)
    none = (asked.join(few, block) if block else asked.crossJoin(F.broadcast(few))).withColumn("score", F.lit(0.0))
    every = scores.select(*block, query_id, doc_id, "score").unionByName(none.select(*block, query_id, doc_id, "score"))
    one = every.groupBy(*block, query_id, doc_id).agg(F.max("score").alias("score"))
    return first_of(one, [*block, query_id], [F.desc("score"), F.col(doc_id)], k, "place").withColumn("place", F.col("place").cast("long") - 1)


def annotations(df: DataFrame, features: dict[str, tuple[str, str]], keys: list[str], total: str | None = None) -> DataFrame:
    """0/1 columns of two annotators as rows: keys, feature, one, two; with ``total``, whether any feature is 1 as well."""
    pairs = dict(features)
    if total:
        each = [[F.col(f[side]) for f in features.values()] for side in (0, 1)]
        every = [reduce(lambda a, b: a & b, [c.isNotNull() for c in cs]) for cs in each]
        df = df.withColumns({f"_any{s}": F.when(every[s], F.greatest(*each[s], F.lit(0))) for s in (0, 1)})
        pairs[total] = ("_any0", "_any1")
    rows = [F.struct(F.lit(name).alias("feature"), F.col(a).cast("int").alias("one"), F.col(b).cast("int").alias("two")) for name, (a, b) in pairs.items()]
    return df.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def agreement(df: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Of ``annotations``: each annotator's prevalence, overlap, agreement, and kappa where ``least`` rows overlap."""
    cells = {f"n{i}{j}": F.count_if((F.col("one") == i) & (F.col("two") == j)) for i in (0, 1) for j in (0, 1)}
    out = df.groupBy(*keys, "feature").agg(F.avg("one").alias("prevalence_one"), F.avg("two").alias("prevalence_two"), *[c.alias(k) for k, c in cells.items()])
    d = {k: F.col(k).cast("double") for k in cells}
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    kappa = F.when(n >= least, stats.kappa(d["n11"], d["n10"], d["n01"], d["n00"]))
    return out.select(*keys, "feature", "prevalence_one", "prevalence_two", n.alias("n"), ((d["n11"] + d["n00"]) / F.nullif(n, F.lit(0))).alias("agreement"), (F.col("n01") + F.col("n10")).alias("n_disagree"), kappa.alias("kappa"))


def histogram(df: DataFrame, column: str, bins: list[int]) -> DataFrame:
    """How many rows have each value of ``bins``; empty ones stay."""
    grid = df.sparkSession.createDataFrame([(b,) for b in bins], f"{column} int")
    return grid.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def entity_ids(df: DataFrame, ident: str, order: list[str], out: str = "entity") -> DataFrame:
    """``ident`` as text; where it is missing or blank, the row's place in ``order`` from 0, over all rows."""
    from pairlens.operators.pairs import dense_ids

    numbered = dense_ids(df, order, "_place")
    return numbered.withColumn(out, F.coalesce(F.nullif(F.trim(F.col(ident).cast("string")), F.lit("")), F.col("_place").cast("string"))).drop("_place")


def stamped(df: DataFrame, out: str = "processed_at") -> DataFrame:
    """When rows were processed, in UTC to the second, one time for the whole query."""
    return df.withColumn(out, F.date_format(F.to_utc_timestamp(F.date_trunc("second", F.current_timestamp()), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def with_answers(runs: DataFrame, answers: DataFrame) -> DataFrame:
    """Runs with their answers, by pair_id, run_id and arm; a run without one has a null."""
    keys = ["pair_id", "run_id", "arm"]
    return runs.join(answers.select(*keys, "answer"), keys, "left")


def paired_decisions(answered: DataFrame, decision: Column) -> tuple[DataFrame, DataFrame]:
    """Both arms' decisions of each pair and run (pair_id, run_id, unbiased, biased), and how many runs have one that can't
    be read (n_runs, n_unparsed); these are left out of the first."""
    arm = lambda name: F.max(F.when(F.col("arm") == name, F.col("_decision"))).alias(name)
    both = answered.withColumn("_decision", decision).groupBy("pair_id", "run_id").agg(arm("unbiased"), arm("biased"))
    lost = F.col("unbiased").isNull() | F.col("biased").isNull()
    return both.where(~lost), both.agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(lost).alias("n_unparsed"))

