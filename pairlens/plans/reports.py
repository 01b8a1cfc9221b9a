"""Queries over report tables: dimensions, matrices, agreement, candidate scoring, prevalence with zero rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from pairlens.functions import labels as L, text as T
from pairlens.operators import pairs as P, rates as R, reports as O, scoring as S, similarity as M, inference as E
from pairlens.operators.shared import scratch
from pairlens.plans.outcomes import FACTS, RUNS, STRATEGY_ORDER, facts, read, rounded, runs, tiered
from pairlens.plans.texts import _MAP, _TF, tfidf_map
from pairlens.sources import files

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
FEATURES = {"view": ("Views", "Looking", 0), "click": ("Clicks", "Looking", 1), "purchase": ("Purchases", "Buying", 2)}


def feature_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types with label, theme group and order; those the dimension lacks are in "Other"."""
    dim = spark.createDataFrame([(k, *v) for k, v in FEATURES.items()], "feature string, label string, group string, ord int")
    n = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return O.with_dimension(n, "event_type", dim).withColumn("ord", F.col("ord").cast("long"))


def excluded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and language, without the sources that a pattern names and languages that are not allowed."""
    d = O.among(O.without_sources(read(spark, sf_dir, "documents"), "source", "SRC1"), "lang", ["en", "de", "fr"])
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def tier_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = O.tier_rates(R.outcome_flags(runs(spark, sf_dir)), ["bias"], "steps")
    return rounded(t.select("bias", "tier", "runs", "sensitivity", "harmfulness", *[F.col("quartiles")[i].alias(f"q{i + 1}") for i in range(3)]))


def quartile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of complexity by bias and model, and their means by bias."""
    t = O.tier_rates(R.outcome_flags(runs(spark, sf_dir)), ["bias", "model"], "steps")
    table = O.quartile_table(t, ["bias", "model"], L.rank_in(F.col("tier"), L.TIERS))
    means = [F.avg(f"q{i}").alias(f"q{i}") for i in (1, 2, 3)]
    return rounded(table.groupingSets([[F.col("bias"), F.col("model")], [F.col("bias")]], "bias", "model").agg(*means).withColumn("model", F.coalesce("model", F.lit("mean"))))


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each bias and tier as a matrix, with the largest of all."""
    t = R.rates(tiered(spark, sf_dir), ("bias", "tier")).where("tier IS NOT NULL")
    return O.first_counts(t, "bias", "tier", "runs", list(L.TIERS)).withColumnsRenamed({"mid-low": "mid_low", "mid-high": "mid_high"})


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and segments with customers' mean balances as effects, made p-values, and q-values over all."""
    c = read(spark, sf_dir, "customer")
    cells = c.groupBy("c_nationkey", "c_mktsegment").agg((F.avg("c_acctbal") / 1000 - 4).alias("effect"), F.min(F.when(F.col("c_custkey") % 13 > 0, F.pmod(F.col("c_custkey") * 7919, F.lit(1009)) / 1009.0)).alias("p"))
    return O.adjusted(rounded(cells, 9), "p")


def whole_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q-values of all customers' made p-values as one family, where a missing p counts as 1."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 13 > 0, F.pmod(F.col("c_custkey") * 7919, F.lit(1009)) / 1009.0).alias("p"))
    return rounded(O.adjusted(c, "p"))


def wide_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p- and q-values of nations by segment, side by side."""
    return rounded(O.wide(_cells(spark, sf_dir), "c_nationkey", "c_mktsegment", ["p", "q"], SEGMENTS))


def effect_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.effect_matrices(_cells(spark, sf_dir), "c_nationkey", "c_mktsegment", "effect", "q", SEGMENTS, 0.5))


def top_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest effects of each nation among those whose q is below a half."""
    t = O.top_significant(_cells(spark, sf_dir), "c_nationkey", "c_mktsegment", "effect", "q", 2, 0.5)
    return rounded(t.withColumn("place", F.col("place").cast("long")).select("c_nationkey", "c_mktsegment", "effect", "q", "place"))


def best_tested_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model the strategy of least median, ties by largest absolute effect against s0, then by domain order."""
    t = rounded(E.versus_baseline(facts(spark, sf_dir), ["model"], "strategy", "s0", "sensitivity"), 9)
    return rounded(O.best_cells(t, "model", "strategy", L.rank_in(F.col("strategy"), STRATEGY_ORDER, "s0")).select("model", "strategy", "median", "effect"))


def mapped_prevalence_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mapped to each benchmark item at 0.07, with items of none, and to any."""
    return rounded(O.label_prevalence(tfidf_map(spark, sf_dir), read(spark, sf_dir, "benchmark"), "item_id", 0.07))


def tfidf_top5_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five benchmark items for each document; items without a common term fill up at 0."""
    d, b = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text")
    scores = M.tfidf_cosine(d, b, "doc_id", "item_id", M.word_grams, "text", [], 5).withColumn("score", F.round("score", 6))
    return O.top_k_filled(d, b, scores, "doc_id", "item_id", [], 5)


def _brand_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts, the types of each brand, and the three best types of each part in its brand by words and characters."""
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", F.element_at(F.split("p_type", " "), -1)).alias("text"))
    types = read(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("cand")).distinct().withColumn("text", F.col("cand"))
    both = [M.tfidf_cosine(p, types, "p_partkey", "cand", g, "text", ["p_brand"], min_df=1, max_share=1.0) for g in (M.word_grams, M.char_grams)]
    scores = both[0].unionByName(both[1]).groupBy("p_brand", "p_partkey", "cand").agg(F.round(F.sum("score") / 2, 6).alias("score"))
    return p, types, O.top_k_filled(p, types, scores, "p_partkey", "cand", ["p_brand"], 3)


def brand_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brand_candidates(spark, sf_dir)[2]


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored in one job: a request for each, an answer for each different request, its reading, a flag."""
    p, _, top = _brand_candidates(spark, sf_dir)
    asked = top.join(p, ["p_brand", "p_partkey"]).withColumn("cand_text", F.col("cand"))
    asked = asked.withColumn("request", S.alignment_request(F.col("text"), F.col("cand_text"), 40)).withColumn("key", S.request_key(F.col("request"), F.lit("stub")))

    def stub(d: DataFrame) -> DataFrame:
        head = F.substring(F.col("text"), 1, 5)
        item = F.struct(F.lit("0").alias("idx"), F.lit(True).alias("aligned"), F.lit("strong").alias("alignment_strength"), F.when(F.length("cand") % 2 == 0, "0.9").otherwise("0.8").alias("score"), F.upper(head).alias("dev_cue_span"), F.substring("cand", 1, 4).alias("probe_cue_span"))
        return d.select("key", F.concat(F.lit("So: "), F.to_json(F.struct(F.array(item).alias("candidates")))).alias("answer"))

    out = S.aligned(S.score(asked, "key", stub)[0].drop("score"), "text", "cand_text", 0.85)
    return rounded(out.select("p_partkey", "cand", "place", F.length("request").cast("long").alias("chars"), "is_aligned", "is_strong", "score"))


def judged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two made classifiers judged against labels, by feature and for any feature; at least ten rows each."""
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    d = d.withColumns({"m_quality": (F.col("n_chars") > 300).cast("int"), "m_toxic": F.col("source").endswith("3").cast("int")})
    rows = O.annotations(d, {"quality": ("quality", "m_quality"), "toxic": ("toxic", "m_toxic")}, [], "ANY")
    return rounded(R.binary_quality(rows, ["feature"], "one", "two", 10))


def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators by source: prevalence of each, agreement, kappa only from ten rows on."""
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    d = d.withColumn("second", F.when(F.col("n_chars") % 5 > 0, F.when(F.col("n_chars") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))))
    return rounded(O.agreement(O.annotations(d, {"quality": ("quality", "second")}, ["source"]), ["source"]))


def paired_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of benchmark items joined with made answers by their keys: decisions that differ, and unreadable ones."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pair_id"), F.col("text").alias("unbiased"), F.concat(F.lit("So: "), F.col("text")).alias("biased"))
    d = P.expand_runs(b, 3)
    mark = F.length("prompt") + F.col("run_id")
    made = d.select("pair_id", "run_id", "arm", F.when(mark % 7 == 0, "no idea").when(mark % 2 == 0, "Decision: A").otherwise("Decision: Option B").alias("answer"))
    pairs, lost = O.paired_decisions(O.with_answers(d, made), T.decision(F.col("answer")))
    return pairs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("unbiased") != F.col("biased")).alias("differ")).crossJoin(lost).withColumn("run_id", F.col("run_id").cast("long"))


def validation_sheet_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet with predictions beside the blind one: all labelled documents of quality, with their scores."""
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").withColumn("score", F.round(F.col("quality") - F.col("toxic") / 3, 6))
    return S.validation_sheet(d, "doc_id", "source", "score", 0.6, ["cue", "hint"], blind=False)


def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with ids; those that have none get their place in the order of conversations."""
    c = read(spark, sf_dir, "conversations").withColumn("given", F.when(F.col("conv_id") % 3 > 0, F.concat_ws("-", "conv_id", "turn")).otherwise(" "))
    return O.entity_ids(c, "given", ["conv_id", "turn", "role", "text"]).select("conv_id", "turn", "entity")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as lines of JSON and items as separated tables, in folders by role, and read as a corpus."""
    folder = scratch(spark)
    c = read(spark, sf_dir, "conversations")
    c.select("role", F.to_json(F.struct(F.struct("role", F.col("text").alias("content")).alias("turn"))).alias("value")).write.partitionBy("role").text(f"{folder}/lines", lineSep="\n")
    # Spark writes .txt; corpora have .jsonl.
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    for status in fs.globStatus(path(f"{folder}/lines/role=*/*.txt")):
        name = status.getPath().toString()
        fs.rename(path(name), path(name.removesuffix(".txt") + ".jsonl"))
    read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("Prompt")).write.csv(f"{folder}/items", header=True, quoteAll=True, escape='"')
    d = files.corpus(spark, folder)
    kind = F.split("file", "/")[0]
    return d.groupBy(kind.alias("kind"), F.md5("prompt").alias("prompt_md5")).agg(F.count(F.lit(1)).alias("n"))


def counted_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the conversations' turns, as inputs of which some are empty, pointers or broken, are left out and why."""
    n = F.col("turn") % 4
    value = F.when(n == 1, " ").when(n == 2, "version https://git-lfs.github.com/spec/v1").when((n == 3) & (F.length("text") % 2 == 0), '{"text": ').otherwise(F.to_json(F.struct("role", "text")))
    skipped = Observation("inputs")
    files.sound(read(spark, sf_dir, "conversations").select(value.alias("value")), skipped).write.format("noop").mode("overwrite").save()
    got = skipped.get
    return spark.createDataFrame([tuple(int(got[c]) for c in ("n_inputs", "n_empty", "n_pointer", "n_broken"))], "n_inputs long, n_empty long, n_pointer long, n_broken long")


def flat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of turns as flat objects with a number and two strings under prompt keys."""
    c = read(spark, sf_dir, "conversations")
    value = F.to_json(F.struct("role", F.col("text").alias("content"), F.concat(F.lit(" ask "), "role").alias("query"), F.col("conv_id").alias("title")))
    found = c.select("conv_id", "turn", F.posexplode(files.flat_prompts(value)).alias("pos", "prompt"))
    return found.select("conv_id", "turn", "pos", F.md5("prompt").alias("prompt_md5"))


def merged_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as paired datasets of two data models and as lists with fuzzy keys, read again and merged. A file holds
    at most 64 items, so that no row grows with the table."""
    folder = scratch(spark)
    b = read(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 64).alias("part"), (F.col("item_id") % 2).alias("half"), F.concat(F.lit("bias "), F.col("item_id") % 3).alias("bias"), F.struct(F.col("item_id").cast("string").alias("pair"), F.concat(F.lit("So: "), F.col("text")).alias("biased"), F.col("text").alias("unbiased"), (F.col("item_id") % 5 > 0).alias("valid")).alias("p"))
    by = b.groupBy("part", "half", "bias").agg(F.collect_list("p").alias("pairs")).groupBy("part", "half").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("bias", "pairs")))).alias("value"))
    listed = b.groupBy("part").agg(F.to_json(F.collect_list(F.struct(F.col("bias").alias("Bias Type"), F.col("p.biased").alias("Biased prompt"), F.col("p.unbiased").alias("neutral-text"), F.col("p.valid").alias("valid")))).alias("value"))
    names = F.concat(F.lit("1_dataset_model"), F.col("half").cast("string"))
    by.select("part", names.alias("name"), "value").unionByName(listed.select("part", F.lit("list").alias("name"), "value")).write.partitionBy("part", "name").text(folder)
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(f"{folder}/named"))
    for status in fs.globStatus(path(f"{folder}/part=*/name=*/*.txt")):
        name = status.getPath().getParent()
        fs.mkdirs(path(f"{folder}/named/{name.getParent().getName()}"))
        fs.rename(status.getPath(), path(f"{folder}/named/{name.getParent().getName()}/{name.getName().removeprefix('name=')}.json"))
    maps = files.paired_datasets(spark, f"{folder}/named").select("data_model", "bias", "biased", "unbiased")
    lists = files.paired_lists(spark, f"{folder}/named", "list.json").select(F.lit("list").alias("data_model"), "bias", "biased", "unbiased")
    return maps.unionByName(lists).groupBy("data_model", "bias").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("biased") - F.length("unbiased")).alias("more"))


QUERIES = {f.__name__: f for f in (
    corpus_files, counted_inputs, flat_prompts, merged_datasets, feature_dimension, excluded_sources, tier_quartiles, quartile_table, tier_counts, whole_discovery, wide_tests, effect_matrices, top_significant, best_tested_cells, mapped_prevalence_any, tfidf_top5_filled,
    brand_candidates, scored_candidates, judged_features, annotator_agreement, paired_decisions, validation_sheet_scored, entity_ids,
)}

_CELLS = "c AS (SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal) / 1000 - 4, 9) AS effect, round(min(CASE WHEN c_custkey % 13 > 0 THEN (c_custkey * 7919 % 1009) / 1009.0::DOUBLE END), 9) AS p FROM customer GROUP BY ALL), r AS (SELECT *, coalesce(p, 1) AS pa, row_number() OVER (ORDER BY coalesce(p, 1)) AS k, count(*) OVER () AS m FROM c), cells AS (SELECT *, least(1, min(pa * m / k) OVER (ORDER BY pa DESC, k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)"
_UNITS = "v AS (SELECT model, strategy, sensitivity AS x FROM facts), pool AS (SELECT model, strategy AS cell, x, 1 AS own FROM v WHERE strategy <> 's0' UNION ALL SELECT b.model, c.cell, b.x, 0 FROM v b JOIN (SELECT DISTINCT model, strategy AS cell FROM v WHERE strategy <> 's0') c ON b.model = c.model WHERE b.strategy = 's0'), rk AS (SELECT *, rank() OVER (PARTITION BY model, cell ORDER BY x) + (count(*) OVER (PARTITION BY model, cell, x) - 1) / 2.0::DOUBLE AS rk FROM pool), s AS (SELECT model, cell, sum(own) AS n1, sum(1 - own) AS n2, sum(rk * own) AS r1, median(x) FILTER (own = 1) AS median FROM rk GROUP BY ALL), e AS (SELECT model, cell AS strategy, round(median, 9) AS median, round(1 - 2 * (r1 - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n2), 9) AS effect FROM s)"
_STEPS = "CASE WHEN steps IS NULL THEN NULL WHEN steps <= q1 THEN 'low' WHEN steps <= q2 THEN 'mid-low' WHEN steps <= q3 THEN 'mid-high' ELSE 'high' END"
_QUART = ", ".join(f"round(quantile_cont(steps, {p}), 6) AS q{i}" for i, p in ((1, 0.25), (2, 0.5), (3, 0.75)))
_FILLED = "every AS (SELECT doc_id, item_id, score FROM scores UNION ALL SELECT doc_id, item_id, 0 FROM documents, benchmark WHERE (doc_id, item_id) NOT IN (SELECT (doc_id, item_id) FROM scores))"


def grams_sql(words: str, chars: str) -> str:
    """Words and word pairs, and n-grams of padded words, of ``x``: (block, side, id, channel, term) from ``src``."""
    w = "regexp_extract_all(lower(x), '[\\p{L}\\p{N}_]{2,}')"
    padded = "list_transform(string_split(trim(regexp_replace(lower(x), '\\s+', ' ', 'g')), ' '), lambda w: ' ' || w || ' ')"
    return f"""{words} AS (SELECT block, side, id, 0 AS channel, unnest({w}) AS term FROM src UNION ALL SELECT block, side, id, 0, t[i] || ' ' || t[i + 1] FROM (SELECT block, side, id, t, unnest(range(1, len(t))) AS i FROM (SELECT block, side, id, {w} AS t FROM src))),
{chars} AS (SELECT block, side, id, 1 AS channel, substr(w, i, n) AS term FROM (SELECT block, side, id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM (SELECT block, side, id, unnest({padded}) AS w, 0 AS z FROM src), (VALUES (3), (4), (5)) AS v(n) WHERE length(w) >= n))"""


def two_channels_sql() -> str:
    """Mean cosines of the two channels in each block: ``scores`` (block, q, cand, score)."""
    return grams_sql("wg", "cg") + """,
tf AS (SELECT block, side, id, channel, term, count(*) AS tf FROM (SELECT * FROM wg UNION ALL SELECT * FROM cg) GROUP BY ALL),
n AS (SELECT block, count(*) AS n FROM src WHERE side = 1 GROUP BY block),
voc AS (SELECT block, channel, term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT block, channel, term, count(*) AS df FROM tf WHERE side = 1 GROUP BY ALL) JOIN n USING (block)),
raw AS (SELECT block, side, id, channel, term, tf * idf AS r FROM tf JOIN voc USING (block, channel, term)),
unit AS (SELECT block, side, id, channel, term, r / sqrt(sum(r * r) OVER (PARTITION BY block, side, id, channel)) AS w FROM raw),
scores AS (SELECT a.block, a.id AS q, b.id AS cand, round(sum(a.w * b.w) / 2, 6) AS score FROM unit a JOIN unit b ON a.block = b.block AND a.channel = b.channel AND a.term = b.term AND a.side = 0 AND b.side = 1 GROUP BY ALL)"""


_BRANDS = f"""src AS (SELECT p_brand AS block, 0 AS side, p_partkey::VARCHAR AS id, p_name || ' ' || string_split(p_type, ' ')[-1] AS x FROM part UNION ALL SELECT DISTINCT p_brand, 1, p_type, p_type FROM part), {two_channels_sql()},
every AS (SELECT a.block, a.id AS q, b.id AS cand, a.x, coalesce(s.score, 0) AS score FROM src a JOIN src b ON a.block = b.block AND a.side = 0 AND b.side = 1 LEFT JOIN scores s ON s.block = a.block AND s.q = a.id AND s.cand = b.id),
top AS (SELECT block, q, cand, x, score, row_number() OVER (PARTITION BY block, q ORDER BY score DESC, cand) - 1 AS place FROM every QUALIFY place < 3)"""
_NATIONS = f"""src AS (SELECT 0 AS block, 0 AS side, p_partkey::VARCHAR AS id, 'nation ' || p_name || ' ' || p_type AS x FROM part UNION ALL SELECT 0, 0, (n_nationkey + 10000000)::VARCHAR, n_name || ' ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 0, 1, n_name, 'nation ' || n_name || ' ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey), {two_channels_sql()}"""
ORACLE = {
    "counted_inputs": "SELECT count(*) AS n_inputs, count_if(turn % 4 = 1) AS n_empty, count_if(turn % 4 = 2) AS n_pointer, count_if(turn % 4 = 3 AND length(text) % 2 = 0) AS n_broken FROM conversations",
    "flat_prompts": "WITH c AS (SELECT conv_id, turn, 0::INT AS pos, 'ask ' || role AS p FROM conversations WHERE lower(role) IN ('user', 'human', 'prompter', 'questioner') UNION ALL SELECT conv_id, turn, 1, regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM conversations WHERE lower(role) IN ('user', 'human', 'prompter', 'questioner')) SELECT conv_id, turn, pos, md5(p) AS prompt_md5 FROM c WHERE p <> ''",
    "corpus_files": "WITH t AS (SELECT 'lines' AS kind, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS p FROM conversations WHERE lower(role) IN ('user', 'human', 'prompter', 'questioner') UNION ALL SELECT 'items', trim(text) FROM benchmark) SELECT kind, md5(p) AS prompt_md5, count(*) AS n FROM t WHERE p <> '' GROUP BY ALL",
    "merged_datasets": "WITH t AS (SELECT 'model' || (item_id % 2) AS data_model, 'bias ' || (item_id % 3) AS bias, item_id FROM benchmark WHERE item_id % 5 > 0 UNION ALL SELECT 'list', 'bias ' || (item_id % 3), item_id FROM benchmark WHERE item_id % 5 > 0) SELECT data_model, bias, count(*) AS n, 4 * count(*) AS more FROM t GROUP BY ALL",
    "two_channel_top": f"WITH {_NATIONS} SELECT q::BIGINT AS p_partkey, cand, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand) - 1 AS place FROM scores QUALIFY place < 2",
    "feature_dimension": "SELECT event_type, count(*) AS n, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in FEATURES.items()) + " ELSE event_type END AS label, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in FEATURES.items()) + " ELSE 'Other' END AS \"group\", CASE event_type " + " ".join(f"WHEN '{k}' THEN {v[2]}" for k, v in FEATURES.items()) + " ELSE 3 END::BIGINT AS ord FROM events GROUP BY event_type",
    "excluded_sources": "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE NOT regexp_matches(coalesce(source, ''), '(?i)SRC1') AND lang IN ('en', 'de', 'fr') GROUP BY ALL",
    "tier_quartiles": f"WITH {RUNS}, b AS (SELECT bias, {_QUART} FROM runs GROUP BY bias) SELECT t.bias, tier, count(*) AS runs, round(100 * avg(CAST(sensitive AS DOUBLE)), 6) AS sensitivity, round(100 * avg(CAST(harmful AS DOUBLE)), 6) AS harmfulness, any_value(b.q1) AS q1, any_value(b.q2) AS q2, any_value(b.q3) AS q3 FROM tiered t JOIN b ON b.bias = t.bias WHERE tier IS NOT NULL GROUP BY t.bias, tier",
    "quartile_table": f"WITH {RUNS}, b AS (SELECT bias, model, quantile_cont(steps, 0.25) AS q1, quantile_cont(steps, 0.5) AS q2, quantile_cont(steps, 0.75) AS q3 FROM runs GROUP BY ALL) SELECT bias, coalesce(model, 'mean') AS model, round(avg(q1), 6) AS q1, round(avg(q2), 6) AS q2, round(avg(q3), 6) AS q3 FROM b GROUP BY GROUPING SETS ((bias, model), (bias))",
    "tier_counts": f"WITH {RUNS}, t AS (SELECT bias, tier, count(*) AS n FROM tiered WHERE tier IS NOT NULL GROUP BY ALL) SELECT bias, max(n) FILTER (tier = 'low') AS low, max(n) FILTER (tier = 'mid-low') AS mid_low, max(n) FILTER (tier = 'mid-high') AS mid_high, max(n) FILTER (tier = 'high') AS high, (SELECT max(n) FROM t) AS largest FROM t GROUP BY bias",
    "whole_discovery": "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 13 > 0 THEN (c_custkey * 7919 % 1009) / 1009.0::DOUBLE END AS p FROM customer), r AS (SELECT *, coalesce(p, 1) AS pa, row_number() OVER (ORDER BY coalesce(p, 1)) AS k, count(*) OVER () AS m FROM c) SELECT c_custkey, round(p, 6) AS p, round(least(1, min(pa * m / k) OVER (ORDER BY pa DESC, k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r",
    "wide_tests": f"WITH {_CELLS} SELECT c_nationkey, " + ", ".join(f"round(any_value(p) FILTER (c_mktsegment = '{s}'), 6) AS \"{s}_p\", round(any_value(q) FILTER (c_mktsegment = '{s}'), 6) AS \"{s}_q\"" for s in SEGMENTS) + " FROM cells GROUP BY c_nationkey",
    "effect_matrices": f"WITH {_CELLS} SELECT c_nationkey, " + ", ".join(f"coalesce(round(any_value(effect) FILTER (c_mktsegment = '{s}'), 6), 0) AS \"{s}_effect\", coalesce(round(any_value(q) FILTER (c_mktsegment = '{s}'), 6), 1) AS \"{s}_q\", coalesce(any_value((q < 0.5)::INT) FILTER (c_mktsegment = '{s}'), 0) AS \"{s}_significant\"" for s in SEGMENTS) + " FROM cells GROUP BY c_nationkey",
    "top_significant": f"WITH {_CELLS} SELECT c_nationkey, c_mktsegment, round(effect, 6) AS effect, round(q, 6) AS q, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(effect) DESC, c_mktsegment) AS place FROM cells WHERE q < 0.5 QUALIFY place <= 2",
    "best_tested_cells": f"WITH {FACTS}, {_UNITS} SELECT model, strategy, round(median, 6) AS median, round(effect, 6) AS effect FROM e QUALIFY row_number() OVER (PARTITION BY model ORDER BY median, abs(effect) DESC, strategy) = 1",
    "mapped_prevalence_any": f"WITH {_MAP}, t AS (SELECT count(*) AS n, count_if(mapped) AS k FROM mapped), u AS (SELECT b.item_id::VARCHAR AS item_id, t.n, coalesce(count_if(m.mapped), 0) AS k FROM benchmark b CROSS JOIN t LEFT JOIN mapped m ON m.item_id = b.item_id GROUP BY b.item_id, t.n UNION ALL SELECT 'ANY', n, k FROM t) SELECT *, round(100.0::DOUBLE * k / n, 6) AS pct, 0.07::DOUBLE AS threshold FROM u",
    "tfidf_top5_filled": f"WITH {_TF}, {_FILLED} SELECT doc_id, item_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) - 1 AS place FROM every QUALIFY place < 5",
    "brand_candidates": f"WITH {_BRANDS} SELECT block AS p_brand, q::BIGINT AS p_partkey, cand, score::DOUBLE AS score, place FROM top",
    "judged_features": "WITH d AS (SELECT quality, toxic, (n_chars > 300)::INT AS mq, (source LIKE '%3')::INT AS mt FROM labels JOIN documents USING (doc_id)), a AS (SELECT 'quality' AS feature, quality AS one, mq AS two FROM d UNION ALL SELECT 'toxic', toxic, mt FROM d UNION ALL SELECT 'ANY', greatest(quality, toxic), greatest(mq, mt) FROM d), c AS (SELECT feature, count(*) AS n, count_if(one = 1 AND two = 1) AS tp, count_if(one = 0 AND two = 1) AS fp, count_if(one = 1 AND two = 0) AS fn FROM a WHERE one IS NOT NULL AND two IS NOT NULL GROUP BY feature HAVING count(*) >= 10), p AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM c) SELECT feature, n, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, tp + fn AS support, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM p",
    "annotator_agreement": "WITH d AS (SELECT source, quality AS one, CASE WHEN n_chars % 5 > 0 THEN CASE WHEN n_chars % 7 = 0 THEN 1 - quality ELSE quality END END AS two FROM labels JOIN documents USING (doc_id)), c AS (SELECT source, avg(one::DOUBLE) AS p1, avg(two::DOUBLE) AS p2, count_if(one = 0 AND two = 0) AS a, count_if(one = 0 AND two = 1) AS b, count_if(one = 1 AND two = 0) AS c, count_if(one = 1 AND two = 1) AS d FROM d GROUP BY source), n AS (SELECT *, a + b + c + d AS n, ((d + c)::DOUBLE * (d + b) + (a + b)::DOUBLE * (a + c)) / nullif((a + b + c + d)::DOUBLE ** 2, 0) AS pe FROM c) SELECT source, 'quality' AS feature, round(p1, 6) AS prevalence_one, round(p2, 6) AS prevalence_two, n, round((a + d)::DOUBLE / nullif(n, 0), 6) AS agreement, b + c AS n_disagree, CASE WHEN n >= 10 THEN round(((a + d)::DOUBLE / n - pe) / nullif(1 - pe, 0), 6) END AS kappa FROM n",
    "paired_decisions": "WITH r AS (SELECT item_id, run_id, length(text) + run_id AS u, length(text) + 4 + run_id AS b FROM benchmark, (SELECT unnest([0, 1, 2]) AS run_id)), d AS (SELECT run_id, CASE WHEN u % 7 = 0 THEN NULL WHEN u % 2 = 0 THEN 'A' ELSE 'B' END AS u, CASE WHEN b % 7 = 0 THEN NULL WHEN b % 2 = 0 THEN 'A' ELSE 'B' END AS b FROM r), l AS (SELECT count(*) AS n_runs, count_if(u IS NULL OR b IS NULL) AS n_unparsed FROM d) SELECT run_id::BIGINT AS run_id, count(*) AS n, count_if(u <> b) AS differ, any_value(n_runs) AS n_runs, any_value(n_unparsed) AS n_unparsed FROM d, l WHERE u IS NOT NULL AND b IS NOT NULL GROUP BY run_id",
    "validation_sheet_scored": "WITH d AS (SELECT doc_id, source, round(quality - toxic / 3.0::DOUBLE, 6) AS score FROM labels JOIN documents USING (doc_id)) SELECT doc_id, source, score, NULL::INT AS ann1_cue, NULL::INT AS ann1_hint, NULL::INT AS ann2_cue, NULL::INT AS ann2_hint FROM d WHERE score >= 0.6",
    "entity_ids": "SELECT conv_id, turn, CASE WHEN conv_id % 3 > 0 THEN conv_id || '-' || turn ELSE (row_number() OVER (ORDER BY conv_id, turn, role, text) - 1)::VARCHAR END AS entity FROM conversations",
    "scored_candidates": f"WITH {_BRANDS}, t AS (SELECT *, length(cand) % 2 = 0 AS high, ('Query: ' || CASE WHEN length(x) > 40 THEN rtrim(substr(x, 1, 40)) || '…' ELSE x END || chr(10) || 'Candidate 0: ' || CASE WHEN length(cand) > 40 THEN rtrim(substr(cand, 1, 40)) || '…' ELSE cand END) AS asked FROM top) SELECT q::BIGINT AS p_partkey, cand, place, length(asked) + {len(S.ALIGNMENT_TASK)} AS chars, high AS is_aligned, high AS is_strong, CASE WHEN high THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS score FROM t",
}
