"""Labels of biases, tiers, models and strategies: normalisers and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Complexity tiers from the lowest, biases, the feature family of each, other names of biases, strategies and their flags.
TIERS = ("low", "mid-low", "mid-high", "high")
BIAS_FEATURES = {
    "confirmation bias": "confirmation_cues",
    "anchoring bias": "anchoring_phrases",
    "framing effect": "framing_language",
    "bandwagon effect": "bandwagon_cues",
    "overconfidence bias": "overconfidence_cues",
    "availability bias": "availability_cues",
    "hindsight bias": "hindsight_cues",
    "hyperbolic discounting": "time_preference_cues",
}
BIAS_ALIASES = {
    "anchoring": "anchoring bias",
    "availability": "availability bias",
    "bandwagon": "bandwagon effect",
    "confirmation": "confirmation bias",
    "framing": "framing effect",
    "hindsight": "hindsight bias",
    "overconfidence": "overconfidence bias",
    "present bias": "hyperbolic discounting",
    "time preference": "hyperbolic discounting",
}
STRATEGIES = {
    "Ø": [],
    "ProbeAX": ["inject_axioms"],
    "CoT": ["chain_of_thought"],
    "IMP": ["implication_prompting"],
    "IsD": ["impersonified_self_debiasing"],
    "BW": ["bias_warning"],
    "BW+IsD": ["bias_warning", "impersonified_self_debiasing"],
    "2sAX": ["bistep_axioms_elicitation"],
    "2sAX+BW": ["bias_warning", "bistep_axioms_elicitation"],
    "sAX": ["self_axioms_elicitation"],
    "sAX+BW": ["bias_warning", "self_axioms_elicitation"],
    "sAX+BW+IsD": ["bias_warning", "impersonified_self_debiasing", "self_axioms_elicitation"],
}


def lookup(value: Column, names: dict[str, str], keep: bool = True) -> Column:
    """``names[value]``; unknown values pass through, or are null if not ``keep``."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.try_element_at(table, value)
    return F.coalesce(found, value) if keep else found


def normalize_bias(value: Column, aliases: dict[str, str] = BIAS_ALIASES) -> Column:
    """Trimmed, lower case, single blanks, then ``aliases`` (the short names of biases); null becomes empty."""
    text = F.coalesce(F.lower(F.regexp_replace(F.trim(value), r"\s+", " ")), F.lit(""))
    return lookup(text, aliases) if aliases else text


def bias_feature(value: Column) -> Column:
    """The cue feature of a bias under any of its names, or null."""
    return lookup(normalize_bias(value), BIAS_FEATURES, keep=False)


def biases(spark: SparkSession) -> DataFrame:
    """The bias dimension: bias, feature, ord."""
    return spark.createDataFrame([(b, f, i) for i, (b, f) in enumerate(BIAS_FEATURES.items())], "bias string, feature string, ord int")


def clean_tier(value: Column) -> Column:
    """A tier's label, or null where it is none; "mid low" counts as "mid-low"."""
    text = F.regexp_replace(F.lower(F.trim(value)), r"^mid[ _]+", "mid-")
    return F.when(text.isin(*TIERS), text)


def rank_in(value: Column, order: list[str] | tuple[str, ...], first: str | None = None) -> Column:
    """The place of ``value`` in a domain's order, for sorting; ``first`` comes before all, unknown values last."""
    ordered = [*([first] if first else []), *[v for v in order if v != first]]
    places = F.create_map(*[F.lit(x) for i, v in enumerate(ordered) for x in (v, i)])
    return F.coalesce(F.try_element_at(places, value), F.lit(len(ordered)))


def strategies(spark: SparkSession, names: dict[str, list[str]] = STRATEGIES) -> DataFrame:
    """The strategy dimension: strategy, flags (sorted), ord."""
    rows = [(k, sorted(v), i) for i, (k, v) in enumerate(names.items())]
    return spark.createDataFrame(rows, "strategy string, flags array<string>, ord int")


def unknown_labels(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Distinct values of ``column`` that ``known`` (one column of that name) does not have."""
    return df.select(column).distinct().join(known, column, "left_anti")


def header_key(name: str) -> str:
    """A column header in lower case with runs of other characters as one underscore."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def title(value: Column) -> Column:
    """A label with a capital at each word."""
    return F.initcap(F.lower(value))


def stars(p: Column) -> Column:
    """*** below 0.001, ** below 0.01, * below 0.05, else empty."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def trend_arrow(slope: Column, flat: float = 0.15) -> Column:
    return F.when(slope.isNull(), "n/a").when(slope > flat, "up").when(slope < -flat, "down").otherwise("flat")


def ellipsis(text: Column, most: int) -> Column:
    """``text``, or its first ``most`` characters without trailing blanks and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)
