"""Pairs of prompts: expansion into runs, prompts and instructions, changed spans, content keys, dense ids."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from pairlens.operators.shared import cut


def expand_runs(pairs: DataFrame, runs: int) -> DataFrame:
    """A row for each pair, run (0..) and arm, with the arm's text as ``prompt``."""
    arms = F.array(F.struct(F.lit("biased").alias("arm"), F.col("biased").alias("prompt")), F.struct(F.lit("unbiased").alias("arm"), F.col("unbiased").alias("prompt")))
    out = pairs.withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("_arm", F.explode(arms))
    return out.select("*", "_arm.arm", "_arm.prompt").drop("_arm")


def request(prompt: Column, cues: Column, run_id: Column) -> Column:
    """A run's request: the prompt, a section of cues where there are any, and a blank for each run before it."""
    section = F.when(F.coalesce(F.length(cues), F.lit(0)) > 0, F.concat(F.lit("\n\nBest practices:\n"), cues)).otherwise("")
    return F.concat(prompt, section, F.repeat(F.lit(" "), run_id))


def instructions(flags: Column, rules: list[tuple[str, str, bool]], base: str) -> Column:
    """``base`` with the text of each flag that a strategy has: (flag, text, before the base or after), in this order."""
    parts = [F.when(F.array_contains(flags, f), t) for f, t, before in rules if before] + [F.lit(base)]
    return F.concat_ws("\n", *parts, *[F.when(F.array_contains(flags, f), t) for f, t, before in rules if not before])


def content_key(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


_TOKEN = re.compile(r"\w+|[^\w\s]")


def _inserted(biased: str, unbiased: str) -> list[str]:
    a, b = _TOKEN.findall(unbiased or ""), _TOKEN.findall(biased or "")
    spans = [b[j1:j2] for kind, _, _, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes() if kind == "insert" or (kind == "replace" and j2 - j1 >= 2)]
    texts = [re.sub(r"\s+([,.;:!?])", r"\1", " ".join(s)).strip() for s in spans]
    return [t for t in texts if len(t) >= 3]


@pandas_udf(ArrayType(StringType()))
def inserted_spans(biased: pd.Series, unbiased: pd.Series) -> pd.Series:
    """What the biased text has beyond the unbiased one: inserted tokens, and replacements of two tokens or more."""
    return pd.Series([_inserted(b, u) for b, u in zip(biased, unbiased, strict=True)])


@pandas_udf(StringType())
def largest_change(biased: pd.Series, unbiased: pd.Series) -> pd.Series:
    """The longest changed run of words of the biased text, at most 50 words."""

    def one(b: str, u: str) -> str:
        x, y = (u or "").split(), (b or "").split()
        spans = [y[j1:j2] for kind, _, _, j1, j2 in difflib.SequenceMatcher(None, x, y).get_opcodes() if kind in ("insert", "replace")]
        return " ".join(max(spans, key=len, default=[])[:50])

    return pd.Series([one(b, u) for b, u in zip(biased, unbiased, strict=True)])


def cue_documents(spans: DataFrame, group: str, span: str, order: list[str]) -> DataFrame:
    """All spans of a group as one text, in ``order``."""
    return spans.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, span))), lambda r: r[span]), " ").alias("cue_doc"))


def cue_chunks(spans: DataFrame, group: str, span: str, order: list[str], rows: int = 1024) -> DataFrame:
    """The text of ``cue_documents`` as chunks of at most ``rows`` spans: group, chunk (0..), n_spans, cue_doc.

    Chunks in order, with blanks between, are the group's text; so no row or task holds a group that grows.
    """
    sizes = spans.where(F.col(span).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy(group).rowsBetween(W.unboundedPreceding, -1)  # of groups' counts, which are few
    starts = sizes.select(F.col(group).alias("_group"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    numbered = dense_ids(spans.where(F.col(span).isNotNull()).select(group, *order, span), [group, *order, span], "_id")
    numbered = numbered.join(starts, F.col(group).eqNullSafe(F.col("_group"))).withColumn("_at", F.col("_id") - F.col("_first"))
    chunks = numbered.groupBy(group, F.floor(F.col("_at") / rows).cast("long").alias("chunk"))
    return chunks.agg(F.count(F.lit(1)).alias("n_spans"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(span).alias("_span")))), lambda r: r["_span"]), " ").alias("cue_doc"))


def dense_ids(df: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """Number rows 0.. in ``order``: counts of range partitions first, then a place in each."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    spread = spread.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    spread = cut(spread)
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return spread.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
