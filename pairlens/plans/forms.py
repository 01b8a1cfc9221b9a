"""Queries over forms that answers, labels and files come in, and over files that are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlens.functions import labels as L, text as T
from pairlens.operators import inference as E, pairs as P, scoring as S
from pairlens.operators.shared import scratch
from pairlens.plans.outcomes import read, rounded
from pairlens.sources import files

# What strategies tell a model, in order: flag, text, and whether it stands before the task.
RULES = [("chain_of_thought", "Think step by step.", True), ("bias_warning", "Beware of biases.", True), ("impersonified_self_debiasing", "You are careful.", False)]
# Words of the invented texts, by kind.
KINDS = {"joints": {"and", "und", "et", "y"}, "n": {"n't", "the"}, "ends": [r"tion\b", r"ung\b"]}


def answered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers with sections, practices and decisions, and as labels of many spellings, all read back."""
    e = read(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    fence = F.lit("```")
    sections = F.concat(F.lit("Axioms of it:\n"), fence, F.lit("prolog\n"), F.when(n % 5 == 0, " ").otherwise(kind), F.lit("\n"), fence, F.lit("\n\nFacts\n\n"), fence, F.lit("prolog\nfact.\n"), fence, F.lit("\n# NL\n\n"), F.when(n % 2 == 0, F.concat(fence, F.lit("\n"))).otherwise(""), kind, F.lit(" holds\nmore"))
    practice = F.concat(F.lit("Best practices: none\n**Best Practices:**\n\n*keep "), kind, F.lit("*.\nend"))
    verdict = F.concat(F.when(n % 3 == 0, "Decision: no\n").otherwise(""), F.lit("Answer: "), F.when(n % 4 == 0, "Yes, no doubt").when(n % 4 == 1, "I say yes").when(n % 4 == 2, "not yes").otherwise("No"))
    tier = F.when(n % 4 == 0, " Mid Low").when(n % 4 == 1, "HIGH ").when(n % 4 == 2, "mid_high").otherwise("top")
    bit = F.when(n % 4 == 0, " Yes ").when(n % 4 == 1, "0.0").when(n % 4 == 2, "?").otherwise("T")
    p = (F.pmod(n, F.lit(100)) / 1000.0).cast("double")
    return e.select(
        "event_id", T.axioms_description(sections).alias("axiom"), T.best_practices(practice).alias("practice"), T.validation(verdict).alias("valid"), L.clean_tier(tier).alias("tier"),
        T.to_binary(bit).cast("long").alias("bit"), L.stars(p).alias("stars"), L.ellipsis(F.concat(kind, F.lit("   of users")), 8).alias("short"),
    )


def strategy_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions of each strategy for each benchmark item."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("task"))
    s = L.strategies(spark).select("strategy", "flags")
    d = b.crossJoin(F.broadcast(s)).withColumn("rules", P.instructions(F.col("flags"), RULES, "Answer A or B."))  # twelve strategies
    return d.select("strategy", "item_id", F.md5(F.concat("rules", F.lit("\n"), "task")).alias("request_md5"), F.length("rules").cast("long").alias("chars"))


def two_step_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns answered for cues first, then with the cues that the answers named; each distinct request once."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.md5("text").alias("key"))
    stub = lambda d: d.select("key", F.concat(F.lit("Best Practices: rule "), F.length("text") % 7, F.lit(".\nend")).alias("answer"))
    build = lambda d: d.select("conv_id", "turn", F.col("cues").alias("text"), F.md5(F.concat_ws("~", "key", "cues")).alias("key"), "cues")
    return S.two_step(c, "key", stub, build).select("conv_id", "turn", "cues", "answer")


def lexicon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a lexicon of words and of endings in each document."""
    d = T.lexicon_counts(read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x20-\x7E\n]", "~").alias("text")), "text", T.lexicon_patterns(KINDS))
    return d.select("doc_id", *[F.col(f"feat_{k}").cast("long").alias(k) for k in KINDS])


def separated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as two tables with other separators and columns, their required columns read together without gaps, and
    written as fixed columns and as lines of JSON, which are read."""
    folder = scratch(spark)
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    o.where("o_orderkey % 2 = 0").write.csv(f"{folder}/a", header=True)
    o.where("o_orderkey % 2 = 1").select("o_orderpriority", "price", "o_orderkey").write.csv(f"{folder}/b", header=True, sep=";")
    read(spark, sf_dir, "region").write.csv(f"{folder}/c", header=True)
    both = files.union_required(spark, [f"{folder}/{x}" for x in "abc"], ["o_orderkey", "o_orderpriority", "price"])
    files.write_csv(both, f"{folder}/out", ["o_orderkey", "note", "price"])
    files.write_jsonl(both.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority"), f"{folder}/lines")
    one = spark.read.csv(f"{folder}/out", header=True).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.coalesce("note", F.lit("")).alias("note"), F.col("price").cast("double").alias("price"))
    two = spark.read.schema("o_orderkey long, o_orderpriority string").json(f"{folder}/lines")
    d = one.join(two, "o_orderkey").groupBy("o_orderpriority", "note").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"))
    return rounded(d)


def attrition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of discarded rows by bias and filter, written as a JSON file for each source, with their totals."""
    folder = scratch(spark)
    d = read(spark, sf_dir, "documents").select("source", F.col("lang").alias("bias"), F.when(F.col("n_chars") > 1500, "long").otherwise("short").alias("filter")).where("source IS NOT NULL AND bias IS NOT NULL")
    by_bias = d.groupBy("source", "filter", "bias").agg(F.count(F.lit(1)).alias("n"))
    by_filter = by_bias.groupBy("source", "filter").agg(F.map_from_entries(F.collect_list(F.struct("bias", "n"))).alias("by"))  # few languages
    body = by_filter.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("filter", "by"))).alias("m"))  # two filters
    body = body.select("source", F.to_json(F.struct(F.col("m").alias("discarded_dilemmas_count_by_filter_by_bias"))).alias("value"))
    body.repartition("source").write.partitionBy("source").text(folder)
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    for status in fs.globStatus(path(f"{folder}/source=*/*.txt")):  # a file for each source
        name = status.getPath()
        fs.rename(name, path(f"{folder}/{name.getParent().getName().removeprefix('source=')}.json"))
    return files.attrition(spark, folder).select(F.regexp_replace("file", r"\.json$", "").alias("source"), "bias", "filter", "discarded")


def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each stratum of at least three uses with their totals, of groups with ten words or more a side: what word effects are made of."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    d = d.select(F.col("lang").alias("stratum"), (F.col("toxic") == 1).alias("flag"), T.tokens(F.lower("text")).alias("words"))
    out = E.word_effects(d, "stratum", "flag", "words", 3)
    both = (F.col("x1") > 0) & (F.col("x0") > 0)
    score = F.when(both & (F.col("x1") + F.col("x0") > 5), F.round("ci_low", 6))
    return rounded(out.select("stratum", "word", "x1", "x0", "effect", score.alias("low"), F.when(score.isNotNull(), F.col("ci_high")).alias("high")))


QUERIES = {f.__name__: f for f in (answered_sections, strategy_instructions, two_step_answers, lexicon_words, separated_files, attrition_files, first_words)}

_RULES = " || ".join(["array_to_string(list_filter([" + ", ".join([*[f"CASE WHEN list_contains(flags, '{f}') THEN '{t}' END" for f, t, before in RULES if before], "'Answer A or B.'", *[f"CASE WHEN list_contains(flags, '{f}') THEN '{t}' END" for f, t, before in RULES if not before]]) + "], lambda x: x IS NOT NULL), chr(10))"])
_STRATEGIES = ", ".join(f"('{k}', [{', '.join(repr(f) for f in v)}]::VARCHAR[])" for k, v in L.STRATEGIES.items())
_LOW = "lower(regexp_replace(text, '[^\\x20-\\x7E\\n]', '~', 'g'))"
_Z = "1.959963984540054::DOUBLE"
ORACLE = {
    "answered_sections": "WITH e AS (SELECT event_id, event_type AS k, event_id % 100 AS h FROM events) SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE k || ' holds' END AS axiom, 'keep ' || k AS practice, event_id % 4 IN (0, 1) AS valid, ['mid-low', 'high', 'mid-high', NULL][event_id % 4 + 1] AS tier, [1, 0, NULL, 1][event_id % 4 + 1]::BIGINT AS bit, CASE WHEN h < 1 THEN '***' WHEN h < 10 THEN '**' WHEN h < 50 THEN '*' ELSE '' END AS stars, rtrim(substr(k || '   of users', 1, 8)) || '…' AS short FROM e",
    "strategy_instructions": f"WITH s AS (SELECT * FROM (VALUES {_STRATEGIES}) AS t(strategy, flags)), r AS (SELECT strategy, item_id, text, {_RULES} AS rules FROM s, benchmark) SELECT strategy, item_id, md5(rules || chr(10) || text) AS request_md5, length(rules) AS chars FROM r",
    "two_step_answers": "WITH c AS (SELECT conv_id, turn, 'rule ' || (length(text) % 7) AS cues FROM conversations) SELECT conv_id, turn, cues, 'Best Practices: rule ' || (length(cues) % 7) || '.' || chr(10) || 'end' AS answer FROM c",
    "lexicon_words": f"SELECT doc_id, len(regexp_extract_all({_LOW}, '\\b(?:and|und|et|y)\\b')) AS joints, len(regexp_extract_all({_LOW}, 'n[''’]t|\\bthe\\b')) AS n, len(regexp_extract_all({_LOW}, 'tion\\b|ung\\b')) AS ends FROM documents",
    "separated_files": "SELECT o_orderpriority, '' AS note, count(*) AS n, sum(round(round(o_totalprice, 2) * 100)::BIGINT)::BIGINT AS cents FROM orders WHERE o_orderkey % 10 > 0 GROUP BY o_orderpriority",
    "attrition_files": "WITH d AS (SELECT source, lang AS bias, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS filter FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) SELECT source, bias, filter, count(*) AS discarded FROM d GROUP BY ROLLUP (source, bias, filter) HAVING source IS NOT NULL",
    "first_words": f"WITH d AS (SELECT lang AS stratum, toxic = 1 AS flag, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents JOIN labels USING (doc_id)), n AS (SELECT stratum, word, count_if(flag) AS x1, count_if(NOT flag) AS x0 FROM d GROUP BY ALL), t AS (SELECT *, sum(x1) OVER w AS t1, sum(x0) OVER w AS t0 FROM n WINDOW w AS (PARTITION BY stratum)), "
    f"k AS (SELECT *, x1 > 0 AND x0 > 0 AS both_, {_Z} * {_Z} * (x1 + x0) + 2.0::DOUBLE * x1 * x0 AS b, t0::DOUBLE / t1 AS s FROM t WHERE x1 + x0 >= 3 AND t1 >= 10 AND t0 >= 10), r AS (SELECT *, sqrt(greatest(b * b - 4.0::DOUBLE * x0 * x0 * x1 * x1, 0)) AS root FROM k) "
    "SELECT stratum, word, x1, x0, round(CASE WHEN both_ THEN ln(x1::DOUBLE / t1) - ln(x0::DOUBLE / t0) ELSE ln((x1 + 0.5::DOUBLE) / t1) - ln((x0 + 0.5::DOUBLE) / t0) END, 6) AS effect, CASE WHEN both_ AND x1 + x0 > 5 THEN round(ln(2.0::DOUBLE * x1 * x1 / (b + root) * s), 6) END AS low, CASE WHEN both_ AND x1 + x0 > 5 THEN round(ln((b + root) / (2.0::DOUBLE * x0 * x0) * s), 6) END AS high FROM r",
}
