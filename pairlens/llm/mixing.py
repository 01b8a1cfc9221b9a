"""Mixing sources to target weights: exact length counts, a bounded-knapsack remainder, seeded selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, gapless_rank, materialize

#: The knapsack's capacity in words, the words beyond which a document is long, and how many of a size are left to choose
#: from; parts of the program over all sizes: at most, at least, and in all its steps together.
CAPACITY, LONG, SPARE = 65_536, 16_384, 3
PARTS, FEWEST, STEPS = 1 << 21, 1 << 17, 1 << 29


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Target words of each source from ``sizes`` (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all words; a target stops
    at ``most`` times its source and the excess goes to the others by weight. That level is found in closed form:
    below it, in the order of cap by weight, sources are full. Returns source, source_size, target double.
    """
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    up = W.orderBy("full_at", F.asc_nulls_last("source"))
    d = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    every = W.partitionBy()
    d = d.withColumn("total", share * F.sum("source_size").over(every))
    d = d.withColumn("full", F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.withColumn("open", F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)))
    d = d.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    d = d.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"])
    return d.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _halves(counts: np.ndarray) -> list[tuple[int, int]]:
    """(place, k) for parts 1, 2, 4, ... of each count, of which any number of documents of a size is a sum."""
    out = []
    for i, many in enumerate(counts.tolist()):
        k = 1
        while many > 0:
            out.append((i, min(k, many)))
            many, k = many - k, 2 * k
    return out


def _nearest(sizes: np.ndarray, counts: np.ndarray, budget: int, floor: int = 0) -> np.ndarray:
    """How many documents of each size to take so that their sum is nearest to ``budget``, by one program over all sizes.

    A bounded-knapsack dynamic program over sums up to twice ``budget``, long sizes first. Sums are exact; one is kept for
    each part of that range, of which there are ``PARTS``, or for many sizes ``STEPS`` by their number, ``FEWEST`` at
    least. So budgets of up to half as many words are met as well as can be. It ends at a sum ``floor`` off.
    """
    out, down = np.zeros(len(sizes), np.int64), np.argsort(-sizes, kind="stable")
    items = [(int(down[i]), k) for i, k in _halves(counts[down]) if 0 < sizes[down[i]] * k <= 2 * budget]
    if budget <= 0 or not items:
        return out
    part = -(-(2 * budget + 1) // max(FEWEST, min(PARTS, STEPS // len(items))))
    held = np.full(2 * budget // part + 1, -1, np.int64)
    via = np.full(len(held), -1, np.int32)
    held[0], known, best = 0, np.zeros(1, np.int64), (budget, 0)
    for n, (i, k) in enumerate(items):
        sums = known + k * int(sizes[i])
        sums = sums[sums <= 2 * budget]
        sums = sums[held[sums // part] < 0]
        if len(sums):
            if part > 1:
                sums = sums[np.unique(sums // part, return_index=True)[1]]
            held[sums // part], via[sums // part] = sums, n
            known = np.concatenate([known, sums])
            at = int(np.abs(sums - budget).argmin())
            best = min(best, (abs(int(sums[at]) - budget), int(sums[at])))
            if best[0] <= floor:
                break
    at = best[1]
    while at:
        i, k = items[via[at // part]]
        out[i] += k
        at -= k * int(sizes[i])
    return out


def _filled(sizes: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """Documents of up to ``LONG`` words, the longest first, until ``CAPACITY`` words are left; then the nearest sum of what is left."""
    take = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= CAPACITY:
            break
        if 0 < sizes[i] <= LONG:
            take[i] = min(int(left[i]), (rest - CAPACITY) // int(sizes[i]) + 1)
            rest -= int(take[i] * sizes[i])
    return take + _nearest(sizes, left - take, rest) if 0 < rest <= CAPACITY else take


def _loosened(sizes: np.ndarray, take: np.ndarray) -> np.ndarray:
    """``take`` without its shortest documents, of which about a quarter of ``PARTS`` words are taken back."""
    out, words = take.copy(), 0
    for i in np.argsort(sizes, kind="stable"):
        if words >= PARTS // 4 or sizes[i] > PARTS // 4:
            break
        if sizes[i] > 0:
            back = min(int(out[i]), -(-(PARTS // 4 - words) // int(sizes[i])))
            out[i] -= back
            words += back * int(sizes[i])
    return out


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, none twice, so that their sum comes nearest to ``budget``.

    First each size's proportional part but for ``SPARE`` documents; of the rest the longest, until ``CAPACITY`` words
    are left; then the bounded-knapsack program over those words. Where that does not meet the budget, as with few
    or long documents, the program runs over all that the proportional part left, then over all documents, and at last over what the nearest
    of these sums leaves without its shortest documents. That is the nearest there is for budgets of up to a million words, and within a 65,536th of
    the budget of it beyond (see ``_nearest``). The sum of distinct sizes is at most the source's, so their number is below
    the square root of twice that sum.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    step = int(np.gcd.reduce(sizes))
    floor = min(budget % step, -budget % step)  # no sum is nearer
    off = lambda take: abs(int((take * sizes).sum()) - budget)
    part = np.array([max(0, int(c) * budget // total - SPARE) for c in counts], np.int64)
    rest = budget - int((sizes * part).sum())
    best = part + _filled(sizes, counts - part, rest)
    for begin in (lambda: part, lambda: np.zeros_like(part), lambda: _loosened(sizes, best)):
        if off(best) > floor:
            start = begin()
            some = start + _nearest(sizes, counts - start, budget - int((sizes * start).sum()), floor)
            best = min(best, some, key=off)
    return best


def _plan(most: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        total, budget = int((sizes * counts).sum()), int(round(float(pdf["target"].iloc[0])))
        passes = min(most, budget // total) if total else 0
        some = knapsack(sizes, counts, budget - passes * total) if total and passes < most else np.zeros_like(counts)
        return pd.DataFrame({"source": pdf["source"], "size": sizes, "target": pdf["target"], "source_size": pdf["source_size"], "passes": passes, "some": some})

    return plan


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """How often a mix by weight takes each document (doc_id, text, source).

    A document's size is its number of words (null text: 0). Each source is taken whole as often as its target
    allows; of the rest, ``knapsack`` fixes how many documents of each length are taken once more, and a seeded
    hash of doc_id picks them. Only length counts reach one task, a source's at a time. Null sources are one
    source. Documents without words count as taken with their source's passes, at 0 words. Repeated rows are
    documents of their own; reruns agree on any cluster. No documents: no rows. Other columns are ignored.
    Returns doc_id, source, size long, source_size long, target double, times int, taken long; with ``keep``, these
    columns of ``docs`` and times.
    """
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    rows = materialize(docs.select(*kept, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("_draw"), F.xxhash64("text").alias("_text")))
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    goals = goals.withColumnRenamed("source", "_source")
    plan = counts.join(goals, F.col("source").eqNullSafe(F.col("_source"))).groupBy("source").applyInPandas(_plan(most), "source string, size long, target double, source_size long, passes int, some long")
    plan = materialize(plan.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "target", "source_size", "passes", "some"))
    ranked = gapless_rank(rows, ["source", "size"], ["_draw", "doc_id", "_text"], "_rank")
    times = (F.col("passes") + (F.col("_rank") < F.col("some")).cast("int")).cast("int")
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    if keep:
        return joined.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], times.alias("times"))
    return joined.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).cast("long").alias("taken"))
