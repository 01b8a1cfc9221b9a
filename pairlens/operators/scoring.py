"""Scoring of requests by a function that the caller gives, with a table of results as a cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pairlens.functions import text as T
from pairlens.functions.labels import ellipsis


def request_key(*parts: Column) -> Column:
    """The cache key of a request: instruction, prompt, model and sampling parameters."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def score(requests: DataFrame, key: str, scorer: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None, empty_is_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """Answers for ``requests``: distinct keys that the cache has no answer for are scored, the others are not.

    ``scorer`` maps a table of distinct requests to (key, answer), for example by ``mapInPandas`` around a remote call;
    an answer may be null. Returns (requests with answer, the cache with the new answers).
    """
    have = None
    if cache is not None:
        have = cache.where(F.col("answer").isNotNull() & ((F.col("answer") != "") if empty_is_missing else F.lit(True)))
    todo = requests.dropDuplicates([key])
    if have is not None:
        todo = todo.join(have, key, "left_anti")
    new = scorer(todo).select(key, "answer")
    known = new if have is None else have.select(key, "answer").unionByName(new)
    return requests.join(known, key, "left"), known


def two_step(requests: DataFrame, key: str, scorer: Callable[[DataFrame], DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score once for cues, build the second request from the answer, and score that."""
    first, _ = score(requests, key, scorer)
    second = build(first.withColumn("cues", T.best_practices(F.col("answer"))).drop("answer"))
    return score(second, key, scorer)[0]


def cascade(rows: DataFrame, ident: str, coding: DataFrame, cue: DataFrame, kind: DataFrame, kinds: list[str]) -> DataFrame:
    """Three labelling stages, given their answers (ident, answer): coding? any cue? which cue?

    A missing or unreadable answer counts as no at each stage; rows that are not coding get nulls after it.
    """
    for name, answers in (("coding", coding), ("cue", cue), ("kind", kind)):
        rows = rows.join(answers.select(ident, F.col("answer").alias(f"_{name}")), ident, "left")
    is_coding = F.coalesce(T.parse_bool(F.col("_coding")), F.lit(False))
    has_cue = F.coalesce(T.parse_bool(F.col("_cue")), F.lit(False))
    which = F.try_element_at(F.array(*[F.lit(k) for k in kinds]), T.parse_label(F.col("_kind")))
    return rows.withColumns({
        "is_coding": is_coding,
        "has_cue": F.when(is_coding, has_cue),
        "cue_type": F.when(is_coding & has_cue, which),
        "coding_explanation": T.body_before_last_line(F.col("_coding")),
    }).drop("_coding", "_cue", "_kind")


#: What an alignment scorer is asked to do and to return, before the query and its candidate.
ALIGNMENT_TASK = (
    "Say whether the query and the candidate show the same cue of the same bias. Quote the words that show it from each. "
    'Answer with JSON: {"candidates": [{"idx": "0", "aligned": true or false, "alignment_strength": "strong", "weak" or "none", '
    '"score": 0 to 1, "dev_cue_span": words of the query, "probe_cue_span": words of the candidate}]}\n\n'
)


def alignment_request(query: Column, candidate: Column, most: int = 1200) -> Column:
    """The request that scores one candidate; texts of over ``most`` characters are cut and end in an ellipsis."""
    return F.concat(F.lit(ALIGNMENT_TASK), F.lit("Query: "), ellipsis(query, most), F.lit("\nCandidate 0: "), ellipsis(candidate, most))


def aligned(candidates: DataFrame, query_text: str, candidate_text: str, threshold: float = 0.85) -> DataFrame:
    """Read alignment answers: flag, strength, score and spans; a span that its text does not hold voids the alignment."""
    schema = "dev_id string, bias_type string, candidates array<struct<idx string, aligned boolean, alignment_strength string, score string, dev_cue_span string, probe_cue_span string, notes string>>"
    d = candidates.withColumn("_c", F.try_element_at(F.filter(T.loose_json(F.col("answer"), schema)["candidates"], lambda c: c["idx"] == "0"), F.lit(1)))
    strength = F.lower(F.col("_c.alignment_strength"))
    spans = {n: T.clamp_span(F.coalesce(F.col(f"_c.{s}"), F.lit("")), F.col(t)) for n, s, t in (("query_span", "dev_cue_span", query_text), ("candidate_span", "probe_cue_span", candidate_text))}
    lost = (F.coalesce(F.col("_c.dev_cue_span"), F.lit("")) != "") & (spans["query_span"] == "") | (F.coalesce(F.col("_c.probe_cue_span"), F.lit("")) != "") & (spans["candidate_span"] == "")
    flag = F.coalesce(F.col("_c.aligned"), F.lit(False)) & ~lost
    d = d.withColumns({"aligned": flag, "strength": F.when(flag & strength.isin("strong", "weak"), strength).otherwise("none"), "score": F.when(lost, 0.0).otherwise(F.col("_c.score").try_cast("double")), **spans})
    ok = F.col("aligned") & (F.coalesce("score", F.lit(-1.0)) >= threshold)
    return d.withColumns({"is_aligned": ok, "is_strong": ok & (F.col("strength") == "strong")}).drop("_c")


def eligible(rows: DataFrame, score_column: str, threshold: float, ident: str, labelled: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Rows at or above ``threshold`` that are not yet labelled, the first ``limit`` by id."""
    out = rows.where(F.coalesce(F.col(score_column), F.lit(-1.0)) >= threshold)
    if labelled is not None:
        out = out.join(labelled.select(ident), ident, "left_anti")
    return out if limit is None else out.orderBy(ident).limit(limit)


def validation_sheet(rows: DataFrame, ident: str, text: str, score_column: str, threshold: float, features: list[str], blind: bool = True) -> DataFrame:
    """Rows for human annotators with empty columns for two of them; without predictions if ``blind``."""
    blank = [F.lit(None).cast("int").alias(f"{who}_{f}") for who in ("ann1", "ann2") for f in features]
    shown = [] if blind else [score_column]
    return rows.where(F.col(score_column) >= threshold).select(ident, text, *shown, *blank)
