"""Queries over texts: cleaning, cues, parsers, word and lexicon effects, similarity, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlens.functions import labels as L, text as T
from pairlens.operators import pairs as P, rates as R, scoring as S, similarity as M, inference as E
from pairlens.plans.outcomes import read, rounded
from pairlens.sources import files

# A codebook and lexicon of words that the invented texts hold; both engines read these patterns alike.
BOOK = {"articles": {"strong": [r"\bthe\s+of\b", r"\bof\s+the\b"], "weak": [r"\bthe\b", r"\bof\b"]}, "links": {"strong": [r"\band\s+the\b"], "weak": [r"\band\b", r"\bwith\b"]}}
LEXICON = {"articles": ["the", "un[ea]?"], "links": ["and|und", "avec"], "dots": [r"\.\n"]}


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "text", F.col("lang").alias("stratum"), (F.col("toxic") == 1).alias("flag"))


def clean_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns without code, empty ones left out, the first of each text kept, in order of conversation and turn."""
    c = files.asking_turns(read(spark, sf_dir, "conversations")).withColumn("clean", T.strip_code(F.col("text"))).where(F.length("clean") > 0)
    first = R.first_of(c, ["clean"], [F.col("conv_id"), F.col("turn"), F.col("text")])
    return first.select("conv_id", "turn", F.md5("clean").alias("clean_md5"), F.length("clean").cast("long").alias("chars"))


def codebook_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.flag_prevalence(T.codebook_flags(read(spark, sf_dir, "documents").select("text"), "text", BOOK), list(BOOK)))


def english_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with a cue of the built-in codebook, by feature, and decision-like prompts."""
    d = T.codebook_flags(read(spark, sf_dir, "conversations").withColumn("decision", T.is_decision(F.col("text")).cast("int")), "text")
    return d.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("decision").alias("decision_like"), *[F.sum(f"{f}_any").alias(f) for f in T.CODEBOOK])


def lexicon_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.lexicon_counts(_labelled(spark, sf_dir), "text", {k: "(?:" + "|".join(v) + ")" for k, v in LEXICON.items()})
    return E.cue_sums(d, "stratum", "flag", list(LEXICON), "tokens").select("stratum", "flag", "feature", "n", "x", "tokens")


def _effects(spark: SparkSession, sf_dir: str, method: str, p_values: bool) -> DataFrame:
    d = T.lexicon_counts(_labelled(spark, sf_dir), "text", {k: "(?:" + "|".join(v) + ")" for k, v in LEXICON.items()})
    return E.cue_effects(d, "stratum", "flag", list(LEXICON), "tokens", method, p_values=p_values)


def cue_rate_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_effects(spark, sf_dir, "poisson", False))


def cue_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_effects(spark, sf_dir, "logit", False).select("stratum", "feature", "effect", "se", "direction"))


def cue_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_effects(spark, sf_dir, "glm", False).select("stratum", "feature", "effect", "se"))


def cue_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects with p- and q-values; SQL has no error function."""
    return rounded(_effects(spark, sf_dir, "auto", True))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir).withColumn("words", T.tokens(F.lower("text")))
    return E.word_sums(d, "stratum", "flag", "words", 3)


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five words of each stratum whose rates differ most (by q, then effect), of those that differ significantly; where
    these are few, the next ones follow, marked."""
    d = E.word_effects(_labelled(spark, sf_dir).withColumn("words", T.tokens(F.lower("text"))), "stratum", "flag", "words", 3)
    d = d.where("q IS NOT NULL").withColumn("significant", F.col("q") < 0.05)
    return rounded(R.first_of(d, ["stratum"], [F.col("q").asc(), F.abs("effect").desc(), F.col("word")], 5))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of events in the forms that models give."""
    e = read(spark, sf_dir, "events")
    letter = F.when(F.col("event_id") % 3 == 0, "B").otherwise("A")
    form = F.col("event_id") % 6
    body = (
        F.when(form == 0, F.concat(F.lit("**Decision:** Option "), letter, F.lit(".\nExplanation: seen "), F.col("event_type")))
        .when(form == 1, F.concat(F.lit("Decision: Option A\nDecision: "), letter))
        .when(form == 2, F.concat(F.lit("<think>Decision: B</think>\n# Answer:\n\noption "), letter, F.lit("\nExplanation: because *it* is")))
        .when(form == 3, F.lit("Decision: Option A and Option B"))
        .when(form == 4, F.concat(F.lit("I see "), F.col("event_type"), F.when(letter == "A", F.lit("\nTRUE")).otherwise("\n No.")))
        .otherwise(F.concat(F.lit("reason\n{\"idx\": \"0\", \"score\": 0."), F.col("user_id") % 10, F.lit("} end\n7")))
    )
    return e.select("event_id", body.alias("answer"))


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T.after_last(F.col("answer"), "</think>")
    j = T.loose_json(F.col("answer"), "struct<idx string, score double>")
    return rounded(_answers(spark, sf_dir).select("event_id", T.decision(a).alias("decision"), T.explanation(a).alias("explanation"), T.parse_bool(a).alias("label"), T.parse_label(a).cast("long").alias("digit"), j["score"].alias("score"), T.validation(a).alias("valid")))


def span_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of eight letters in lower case, found again in their texts as they stand there."""
    d = read(spark, sf_dir, "documents").withColumn("span", F.lower(F.substring("text", 3, 8)))
    return d.select("doc_id", T.clamp_span(F.col("span"), F.col("text")).alias("found"), T.first_non_blank(F.nullif(F.col("lang"), F.lit("en")), F.col("source")).alias("label"))


def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean edit similarity of the pairs of nations' names in each region."""
    d = read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    return rounded(M.mean_levenshtein(d, "n_regionkey", "n_nationkey", "n_name"))


def edit_similarity_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean edit similarity of all pairs of benchmark items; SQL's edit distance counts bytes, not characters."""
    d = read(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("set"), "item_id", "text")
    return rounded(M.mean_levenshtein(d, "set", "item_id", "text"))


def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "benchmark")
    return d.select("item_id", P.content_key(F.col("item_id"), F.col("text")).alias("key"))


def changed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What benchmark items have beyond themselves without every seventh word: a sequence diff, which SQL lacks."""
    w = F.split("text", " ")
    d = read(spark, sf_dir, "benchmark").withColumn("shorter", F.array_join(F.filter(w, lambda x, i: i % 7 != 3), " "))
    return d.select("item_id", P.inserted_spans("text", "shorter").alias("spans"), P.largest_change("text", "shorter").alias("largest"))


def cue_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole turns of each role in order, as chunks of 1,024 turns."""
    c = P.cue_chunks(read(spark, sf_dir, "conversations"), "role", "text", ["conv_id", "turn"])
    return c.select("role", "chunk", "n_spans", F.md5("cue_doc").alias("md5"), F.length("cue_doc").cast("long").alias("chars"))


def _queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    b = read(spark, sf_dir, "benchmark").select("item_id", "text")
    return d, b


def tfidf_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's best benchmark item by TF-IDF cosine over words and word pairs; every document, every item."""
    d, b = _queries(spark, sf_dir)
    scores = M.tfidf_cosine(d, b, "doc_id", "item_id", M.word_grams, "text", [], 1).withColumn("score", F.round("score", 6))
    return M.best_label(d, scores, "doc_id", "item_id", b, 0.07)


def tfidf_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = _queries(spark, sf_dir)
    scores = M.tfidf_cosine(d, b, "doc_id", "item_id", M.word_grams, "text", [], 3).withColumn("score", F.round("score", 6))
    return M.top_k(scores, "doc_id", "item_id", 3).withColumn("place", F.col("place").cast("long"))


def mapped_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mapped to each benchmark item at 0.07, items without any at 0."""
    m = tfidf_map(spark, sf_dir).where("mapped").groupBy("item_id").agg(F.count(F.lit(1)).alias("k"))
    items = read(spark, sf_dir, "benchmark").select("item_id")
    n = read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    return rounded(items.join(m, "item_id", "left").crossJoin(F.broadcast(n)).select("item_id", "n", F.coalesce("k", F.lit(0)).cast("long").alias("k"), (100.0 * F.coalesce("k", F.lit(0)) / F.col("n")).alias("pct")))


def two_channel_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations ranked for texts of parts and nations by the mean of word and character-n-gram cosines."""
    n = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    docs = n.select(F.col("n_name").alias("cand"), F.concat_ws(" ", F.lit("nation"), "n_name", "r_name").alias("text"))
    parts = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.lit("nation"), "p_name", "p_type").alias("text"))
    asked = parts.unionByName(n.select((F.col("n_nationkey") + 10_000_000).cast("long").alias("p_partkey"), F.concat_ws(" ", "n_name", "r_name").alias("text")))
    both = [M.tfidf_cosine(asked, docs, "p_partkey", "cand", g, "text", [], min_df=1, max_share=1.0) for g in (M.word_grams, M.char_grams)]
    scores = both[0].unionByName(both[1]).groupBy("p_partkey", "cand").agg((F.sum("score") / 2).alias("score"))
    return M.top_k(scores.withColumn("score", F.round("score", 6)), "p_partkey", "cand", 2).withColumn("place", F.col("place").cast("long"))


def vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.mean_cosine(read(spark, sf_dir, "embeddings"), "label", "embedding"))


def vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest label means, the best one and whether it reaches 0.3."""
    e = read(spark, sf_dir, "embeddings").withColumn("v", M.clean_vector(F.col("embedding")))
    return rounded(M.nearest_labels(e, "vec_id", "v", M.label_vectors(e, "label", "v", 64), "label", 3, 0.3))


def similar_label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors of one label whose cosine is above 0.3."""
    return rounded(M.similar_pairs_tiled(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.3))


def pruned_label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs, of which only vectors that can be similar meet."""
    return rounded(M.similar_pairs_pruned(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.3))


def first_of_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are the first of those that cosines above 0.3 link to them within their label."""
    e = read(spark, sf_dir, "embeddings")
    return M.keep_first_of_similar(e, "vec_id", M.similar_pairs_tiled(e, "label", "vec_id", "embedding", 0.3)).select("vec_id", "label")


def first_of_greedy_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are not superfluous by sets grown in the order of similar pairs, which SQL can't express."""
    e = read(spark, sf_dir, "embeddings")
    return M.keep_first_of_similar(e, "vec_id", M.similar_pairs_tiled(e, "label", "vec_id", "embedding", 0.3), "greedy").select("vec_id", "label")


def similar_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cosine with the first one."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rounded(M.similarity_to(e, "vec_id", "embedding", e.orderBy("vec_id").limit(1)))


def tfidf_top3_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's three best benchmark items by words and word pairs without English function words."""
    d, b = _queries(spark, sf_dir)
    grams = lambda text: M.word_grams(text, 2, M.ENGLISH_STOP)
    scores = M.tfidf_cosine(d, b, "doc_id", "item_id", grams, "text", [], 3).withColumn("score", F.round("score", 6))
    return M.top_k(scores, "doc_id", "item_id", 3).withColumn("place", F.col("place").cast("long"))


def aligned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each document's three nearest benchmark items by answers read back: spans that the texts do not hold void
    them; by score, strength, then nearness."""
    d, b = _queries(spark, sf_dir)
    near = tfidf_top3(spark, sf_dir).select("doc_id", "item_id", F.col("score").alias("tfidf"))
    c = near.join(d, "doc_id").join(b.withColumnRenamed("text", "cand_text"), "item_id")
    span = F.when((F.col("doc_id") + F.col("item_id")) % 2 == 0, F.lower(F.substring("text", 1, 6))).otherwise("not there ###")
    item = F.struct(F.lit("0").alias("idx"), F.lit(True).alias("aligned"), F.when(F.col("doc_id") % 2 == 0, "strong").otherwise("weak").alias("alignment_strength"), (F.lit(0.8) + F.col("item_id") % 3 / 10.0).cast("string").alias("score"), span.alias("dev_cue_span"), F.substring("cand_text", 1, 4).alias("probe_cue_span"))
    out = S.aligned(c.withColumn("answer", F.concat(F.lit("Here: "), F.to_json(F.struct(F.array(item).alias("candidates"))))), "text", "cand_text", 0.85)
    best = R.first_of(out, ["doc_id"], [F.desc("score"), F.desc("strength"), F.desc("tfidf"), F.col("item_id")])
    return rounded(best.select("doc_id", "item_id", "aligned", "strength", "score", "tfidf", F.lower("query_span").alias("query_span"), "is_aligned", "is_strong"))


# Names of biases as people write them.
_WRITTEN = ("Anchoring", "  Framing   effect", "present\tbias", "AVAILABILITY", "hindsight bias ", "Halo effect", "Time  Preference", "bandwagon", "sunk cost")


def _named_biases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under names of biases by their keys."""
    names = F.array(*[F.lit(x) for x in _WRITTEN])
    return read(spark, sf_dir, "part").select("p_size", F.get(names, (F.col("p_partkey") % len(_WRITTEN)).cast("int")).alias("written"))


def bias_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Biases under one name each, with their cue features."""
    d = _named_biases(spark, sf_dir).select(L.normalize_bias(F.col("written")).alias("bias"), L.bias_feature(F.col("written")).alias("feature"), "p_size")
    return d.groupBy("bias", "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))


def unknown_biases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _named_biases(spark, sf_dir).select(L.normalize_bias(F.col("written")).alias("bias"))
    return L.unknown_labels(d, "bias", L.biases(spark).select("bias"))


def scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns scored once for each distinct request; those that a system turn said are served from a cache."""
    c = read(spark, sf_dir, "conversations").withColumn("key", S.request_key(F.lit("rate"), F.col("text"), F.lit("stub"), F.lit(0)))
    cache = c.where("role = 'system'").select("key", F.lit("cached").alias("answer")).distinct()
    stub = lambda d: d.select("key", F.concat(F.lit("chars "), F.length("text")).alias("answer"))
    out, _ = S.score(c, "key", stub, cache)
    return out.groupBy("role", "answer").agg(F.count(F.lit(1)).alias("n"))


def labelling_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages with stub answers by the length of a text: coding, any cue, which cue."""
    c = read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.length("text").alias("n"))
    coding = c.select("id", F.when(F.col("n") % 3 > 0, "because\nTRUE").otherwise("no idea").alias("answer"))
    cue = c.select("id", F.when(F.col("n") % 2 > 0, "it is\nyes").otherwise("none\nFALSE").alias("answer"))
    kind = c.select("id", F.concat(F.lit("kind\n"), F.col("n") % 5).alias("answer"))
    return S.cascade(c.select("id"), "id", coding, cue, kind, ["a", "b", "c", "d"]).groupBy("is_coding", "has_cue", "cue_type").agg(F.count(F.lit(1)).alias("n"))


def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 good documents that have no toxicity label of 1 yet (a limit is what this operator is for)."""
    l = read(spark, sf_dir, "labels")
    done = l.where("toxic = 1")
    return S.eligible(l.select("doc_id", F.col("quality").cast("double").alias("score")), "score", 1.0, "doc_id", done, 50).select("doc_id", "score")


QUERIES = {f.__name__: f for f in (
    clean_prompts, codebook_prevalence, english_cues, lexicon_totals, cue_rate_ratios, cue_log_odds, cue_regression, cue_effects, word_counts, top_words, parsed_answers, span_clamp,
    edit_similarity, edit_similarity_items, content_keys, changed_spans, cue_document_chunks, tfidf_map, tfidf_top3, mapped_prevalence, two_channel_top, vector_groups, vector_labels, similar_label_vectors, pruned_label_vectors, first_of_similar_vectors, first_of_greedy_sets, similar_to_one, tfidf_top3_stopped, aligned_candidates, bias_labels, unknown_biases, scored_requests,
    labelling_cascade, eligible_rows,
)}

_LEX = ", ".join(f"({i}, '{k}', '(?:{'|'.join(v)})')" for i, (k, v) in enumerate(LEXICON.items()))
_D = f"""d AS (SELECT doc_id, lower(text) AS t, lang AS stratum, toxic = 1 AS flag, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS tokens FROM documents JOIN labels USING (doc_id)),
lex AS (SELECT * FROM (VALUES {_LEX}) AS v(i, feature, p)),
c AS (SELECT stratum, flag, feature, tokens, greatest(tokens, 1)::DOUBLE AS o, len(CASE i WHEN 0 THEN regexp_extract_all(t, '(?:{"|".join(LEXICON["articles"])})') WHEN 1 THEN regexp_extract_all(t, '(?:{"|".join(LEXICON["links"])})') ELSE regexp_extract_all(t, '(?:{LEXICON["dots"][0]})') END)::DOUBLE AS y FROM d, lex),
s AS (SELECT stratum, flag, feature, count(*) AS n, sum(y)::BIGINT AS x, sum(tokens)::BIGINT AS tokens, sum(o) AS o, sum(y * y) AS yy, sum(y * o) AS yo, sum(o * o) AS oo FROM c GROUP BY ALL),
j AS (SELECT a.stratum, a.feature, a.x::DOUBLE AS x1, b.x::DOUBLE AS x0, a.tokens::DOUBLE AS t1, b.tokens::DOUBLE AS t0, a.n + b.n AS n, a.x::DOUBLE / a.o AS r1, b.x::DOUBLE / b.o AS r0,
 (a.yy - 2 * (a.x / a.o) * a.yo + (a.x / a.o) ** 2 * a.oo) / (a.x::DOUBLE ** 2) + (b.yy - 2 * (b.x / b.o) * b.yo + (b.x / b.o) ** 2 * b.oo) / (b.x::DOUBLE ** 2) AS v
 FROM s a JOIN s b ON a.stratum = b.stratum AND a.feature = b.feature WHERE a.flag AND NOT b.flag AND a.tokens >= 10 AND b.tokens >= 10 AND a.x + b.x > 0),
e AS (SELECT *, ln((x1 + 0.5) / t1) - ln((x0 + 0.5) / t0) AS we, sqrt(1 / (x1 + 0.5) + 1 / (x0 + 0.5)) AS ws, greatest(least((x1 + 1) / (t1 + 2), 1 - 1e-6), 1e-6) AS p1, greatest(least((x0 + 1) / (t0 + 2), 1 - 1e-6), 1e-6) AS p0 FROM j)"""
_TF = """tok AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') FROM benchmark),
grams AS (SELECT side, id, unnest(w) AS term FROM tok UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM tok)),
tf AS (SELECT side, id, term, count(*) AS tf FROM grams GROUP BY ALL),
n AS (SELECT count(*) AS n FROM benchmark),
voc AS (SELECT term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df FROM tf WHERE side = 1 GROUP BY term), n WHERE df >= 2 AND df <= 0.95 * n),
raw AS (SELECT side, id, term, tf * idf AS r FROM tf JOIN voc USING (term)),
unit AS (SELECT side, id, term, r / sqrt(sum(r * r) OVER (PARTITION BY side, id)) AS w FROM raw),
scores AS (SELECT a.id AS doc_id, b.id AS item_id, round(sum(a.w * b.w), 6) AS score FROM unit a JOIN unit b ON a.term = b.term AND a.side = 0 AND b.side = 1 GROUP BY ALL)"""
_STOPPED = _TF.replace("tok AS (", "all_ AS (", 1).replace("grams AS (", "tok AS (SELECT side, id, list_filter(w, lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in M.ENGLISH_STOP) + "], x)) AS w FROM all_),\ngrams AS (", 1)
_SIMILAR = "WITH p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE c > 0.3)"
_quoted = lambda x: "'" + x + "'"
_BIAS_SQL = "CASE p_partkey % " + str(len(_WRITTEN)) + " " + " ".join(f"WHEN {i} THEN '{L.BIAS_ALIASES.get(' '.join(w.lower().split()), ' '.join(w.lower().split()))}'" for i, w in enumerate(_WRITTEN)) + " END"
_MAP = _TF + """, best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1),
mapped AS (SELECT d.doc_id, coalesce(b.item_id, (SELECT min(item_id) FROM benchmark)) AS item_id, coalesce(score, 0) AS score, coalesce(score, 0) >= 0.07 AS mapped FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id)"""
_FLAGS = ", ".join(f"regexp_matches(text, '(?i){'|'.join(f'(?:{p})' for p in v[k])}') AS {f}_{k}" for f, v in BOOK.items() for k in ("strong", "weak"))
_PREV = " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n_prompts, count_if({f}_strong) AS strong_count, count_if({f}_weak) AS weak_count, count_if({f}_strong OR {f}_weak) AS any_count FROM f" for f in BOOK)
_CUES = ", ".join("regexp_matches(text, '(?i)" + "|".join(f"(?:{p})" for k in ("strong", "weak") for p in v[k]).replace("'", "''") + f"')::INT AS {f}" for f, v in T.CODEBOOK.items())
# Of these texts DuckDB's classes, which know ASCII alone, cut words where Spark's do: letters and digits beyond ASCII and marks on a
# letter are parts of a word, and a vertical tab is white space. A dot is no end of a line.
_WORDS = "regexp_replace(regexp_replace(regexp_replace(text, '([\\p{L}\\p{Nd}])\\p{Mn}+', '\\1_', 'g'), '[^\\x00-\\x7F\\P{L}]|[^\\x00-\\x7F\\P{Nd}]', '_', 'g'), '\\x0B', ' ', 'g')"
_INLINE = "[^\\n\\r\\x{85}\\x{2028}\\x{2029}]*"
_SPACE = "[ \\t\\n\\x0B\\f\\r]"
_CLEAN = f"""WITH t AS (SELECT conv_id, turn, text, regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g') AS t FROM conversations WHERE lower(role) IN ('user', 'human', 'prompter', 'questioner')),
l AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]') AND NOT regexp_matches(x, '{T.COMMENT_LINE}') AND NOT regexp_matches(x, '{T.CODE_LINE}') AND NOT coalesce(len(regexp_extract_all(x, '[^A-Za-z0-9 \\t\\n\\x0B\\f\\r]')) / nullif(length(x), 0) > {T.SYMBOL_SHARE}, false)) AS lines FROM t),
c AS (SELECT conv_id, turn, text, trim(regexp_replace(array_to_string(lines, ' '), '{_SPACE}+', ' ', 'g')) AS clean FROM l)
SELECT conv_id, turn, md5(clean) AS clean_md5, length(clean) AS chars FROM c WHERE clean <> '' QUALIFY row_number() OVER (PARTITION BY clean ORDER BY conv_id, turn, text) = 1"""
ORACLE = {
    "codebook_prevalence": f"WITH f AS (SELECT {_FLAGS} FROM documents), c AS ({_PREV} UNION ALL SELECT 'ANY_FEATURE', count(*), count_if(articles_strong OR links_strong), NULL, count_if(articles_strong OR articles_weak OR links_strong OR links_weak) FROM f) SELECT *, round(100.0::DOUBLE * strong_count / n_prompts, 6) AS strong_pct, round(100.0::DOUBLE * weak_count / n_prompts, 6) AS weak_pct, round(100.0::DOUBLE * any_count / n_prompts, 6) AS any_pct FROM c",
    "lexicon_totals": f"WITH {_D} SELECT stratum, flag, feature, n, x, tokens FROM s",
    "cue_rate_ratios": f"WITH {_D} SELECT stratum, feature, round(we, 6) AS effect, round(ws, 6) AS se, x1::BIGINT AS count_flagged, x0::BIGINT AS count_other, t1::BIGINT AS tokens_flagged, t0::BIGINT AS tokens_other, round(1000 * x1 / t1, 6) AS rate_flagged_per_1k, round(1000 * x0 / t0, 6) AS rate_other_per_1k, round(we / ws, 6) AS z, round(we - 1.96 * ws, 6) AS ci_low, round(we + 1.96 * ws, 6) AS ci_high, CASE WHEN we > 0 THEN 'more' ELSE 'less' END AS direction FROM e",
    "cue_log_odds": f"WITH {_D}, o AS (SELECT *, ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) AS eff, sqrt(1 / greatest(t1 * p1 * (1 - p1), 1e-9) + 1 / greatest(t0 * p0 * (1 - p0), 1e-9)) AS se FROM e) SELECT stratum, feature, round(eff, 6) AS effect, round(se, 6) AS se, CASE WHEN eff > 0 THEN 'more' ELSE 'less' END AS direction FROM o",
    "cue_regression": f"WITH {_D} SELECT stratum, feature, round(CASE WHEN x1 > 0 AND x0 > 0 THEN ln(r1 / r0) ELSE we END, 6) AS effect, round(CASE WHEN x1 > 0 AND x0 > 0 THEN sqrt(v * n / (n - 2)) ELSE ws END, 6) AS se FROM e",
    "word_counts": "WITH d AS (SELECT lang AS stratum, toxic = 1 AS flag, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents JOIN labels USING (doc_id)), n AS (SELECT stratum, word, count_if(flag) AS x1, count_if(NOT flag) AS x0 FROM d GROUP BY ALL) SELECT n.*, sum(x1) OVER w AS t1, sum(x0) OVER w AS t0 FROM n WINDOW w AS (PARTITION BY stratum) QUALIFY x1 + x0 >= 3",
    "span_clamp": "WITH s AS (SELECT doc_id, lang, source, text, lower(substr(text, 3, 8)) AS span FROM documents) SELECT doc_id, CASE WHEN span = '' THEN '' WHEN strpos(text, span) > 0 THEN span WHEN strpos(lower(text), span) > 0 THEN substr(text, strpos(lower(text), span), length(span)) ELSE '' END AS found, coalesce(nullif(trim(nullif(lang, 'en')), ''), nullif(trim(source), ''), '') AS label FROM s",
    "edit_similarity": "SELECT a.n_regionkey, count(*) AS pairs, round(avg(1 - levenshtein(a.n_name, b.n_name)::DOUBLE / greatest(length(a.n_name), length(b.n_name))), 6) AS mean_similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY a.n_regionkey",
    "cue_document_chunks": "WITH n AS (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, text) - 1 AS k FROM conversations WHERE text IS NOT NULL), c AS (SELECT role, k // 1024 AS chunk, count(*) AS n_spans, string_agg(text, ' ' ORDER BY k) AS doc FROM n GROUP BY ALL) SELECT role, chunk::BIGINT AS chunk, n_spans, md5(doc) AS md5, length(doc) AS chars FROM c",
    "tfidf_map": f"WITH {_MAP} SELECT * FROM mapped",
    "tfidf_top3": f"WITH {_TF} SELECT doc_id, item_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) - 1 AS place FROM scores QUALIFY place < 3",
    "mapped_prevalence": f"WITH {_MAP}, t AS (SELECT count(*) AS n FROM documents) SELECT b.item_id, t.n, coalesce(count_if(m.mapped), 0) AS k, round(100.0::DOUBLE * coalesce(count_if(m.mapped), 0) / t.n, 6) AS pct FROM benchmark b CROSS JOIN t LEFT JOIN mapped m ON m.item_id = b.item_id GROUP BY b.item_id, t.n",
    "vector_groups": "WITH p AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings), u AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM p), s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM u GROUP BY ALL) SELECT label, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) AS mean_cosine FROM s GROUP BY label",
    "similar_label_vectors": _SIMILAR + " SELECT label, a, b, round(c, 6) AS cosine FROM p",
    "pruned_label_vectors": _SIMILAR + " SELECT label, a, b, round(c, 6) AS cosine FROM p",
    "first_of_similar_vectors": _SIMILAR.replace("WITH ", "WITH RECURSIVE ") + ", l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT vec_id, label FROM embeddings JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = vec_id WHERE m = vec_id",
    "similar_to_one": "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) o",
    "tfidf_top3_stopped": f"WITH {_STOPPED} SELECT doc_id, item_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) - 1 AS place FROM scores QUALIFY place < 3",
    "aligned_candidates": f"WITH {_TF}, k AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) <= 3), c AS (SELECT doc_id, item_id, k.score AS tfidf, text, (doc_id + item_id) % 2 = 0 AS held FROM k JOIN documents USING (doc_id)), "
    "a AS (SELECT doc_id, item_id, tfidf, held, CASE WHEN held THEN CASE WHEN doc_id % 2 = 0 THEN 'strong' ELSE 'weak' END ELSE 'none' END AS strength, CASE WHEN held THEN 0.8::DOUBLE + item_id % 3 / 10.0::DOUBLE ELSE 0 END AS score, CASE WHEN held THEN lower(substr(text, 1, 6)) ELSE '' END AS query_span FROM c) "
    "SELECT doc_id, item_id, held AS aligned, strength, round(score, 6) AS score, tfidf, query_span, held AND score >= 0.85 AS is_aligned, held AND score >= 0.85 AND strength = 'strong' AS is_strong FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY a.score DESC, strength DESC, tfidf DESC, item_id) = 1",
    "bias_labels": f"WITH n AS (SELECT p_size, {_BIAS_SQL} AS bias FROM part), m AS (SELECT * FROM (VALUES {', '.join(f'({_quoted(b)}, {_quoted(f)})' for b, f in L.BIAS_FEATURES.items())}) AS t(bias, feature)) SELECT n.bias, m.feature, count(*) AS n, sum(p_size)::BIGINT AS size FROM n LEFT JOIN m ON m.bias = n.bias GROUP BY ALL",
    "unknown_biases": f"SELECT DISTINCT {_BIAS_SQL} AS bias FROM part WHERE bias NOT IN ({', '.join(map(_quoted, L.BIAS_FEATURES))})",
    "scored_requests": "WITH c AS (SELECT role, text, text IN (SELECT text FROM conversations WHERE role = 'system') AS known FROM conversations) SELECT role, CASE WHEN known THEN 'cached' ELSE 'chars ' || length(text) END AS answer, count(*) AS n FROM c GROUP BY ALL",
    "labelling_cascade": "WITH c AS (SELECT length(text) AS n FROM conversations), f AS (SELECT n % 3 > 0 AS is_coding, CASE WHEN n % 3 > 0 THEN n % 2 > 0 END AS has_cue, CASE WHEN n % 3 > 0 AND n % 2 > 0 AND n % 5 > 0 THEN ['a', 'b', 'c', 'd'][n % 5] END AS cue_type FROM c) SELECT *, count(*) AS n FROM f GROUP BY ALL",
    "eligible_rows": "SELECT doc_id, quality::DOUBLE AS score FROM labels WHERE quality >= 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY doc_id LIMIT 50",
    "clean_prompts": _CLEAN,
    "english_cues": f"WITH t AS (SELECT role, {_WORDS} AS text FROM conversations), f AS (SELECT role, regexp_matches(text, '(?i){T.DECISION_WORDS}')::INT AS d, {_CUES.replace('.*', _INLINE)} FROM t) SELECT role, count(*) AS n, coalesce(sum(d), 0)::BIGINT AS decision_like, " + ", ".join(f"coalesce(sum({f}), 0)::BIGINT AS {f}" for f in T.CODEBOOK) + " FROM f GROUP BY role",
    "content_keys": "SELECT item_id, sha256(to_json({'item_id': item_id, 'text': text})) AS key FROM benchmark",
    "vector_labels": "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS i FROM v), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL), l AS (SELECT label, list(x ORDER BY i) AS m FROM m GROUP BY label), c AS (SELECT vec_id, l.label, round(list_cosine_similarity(v, m), 9) AS c FROM v, l), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS k FROM c) SELECT vec_id, min(label) FILTER (k = 1) AS best, round(max(c), 6) AS score, max(c) >= 0.3 AS mapped, list(label ORDER BY k) FILTER (k <= 3) AS top FROM r GROUP BY vec_id",
    "parsed_answers": "WITH e AS (SELECT event_id, event_type, event_id % 6 AS f, CASE WHEN event_id % 3 = 0 THEN 'B' ELSE 'A' END AS l, user_id FROM events) SELECT event_id, CASE WHEN f IN (0, 1, 2) THEN 'Option ' || l WHEN f = 3 THEN 'Option A' END AS decision, CASE f WHEN 0 THEN 'seen ' || event_type WHEN 2 THEN 'because *it* is' ELSE '' END AS explanation, CASE WHEN f = 4 THEN l = 'A' END AS label, CASE WHEN f = 5 THEN 7 END::BIGINT AS digit, CASE WHEN f = 5 THEN (user_id % 10)::DOUBLE / 10 END AS score, false AS valid FROM e",
}
