"""Chat formatting with Spark expressions only: sort turns, merge neighbours of one role, concatenate, mark the loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: The template: a run of turns of one role is OPEN role BODY text (NEXT text)* CLOSE. All control strings begin with "<|".
OPEN, BODY, NEXT, CLOSE = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"


def escape(text: Column) -> Column:
    """Make "<|" impossible inside ``text``: each "<", any backslashes, "|" gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def format_chats(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Format conversations (conv_id, turn, role, text) into one string each, with the spans a loss counts.

    Turns are sorted by turn, role and text (so ties and repeated rows have one order); a null role or text is
    empty. Adjacent turns of one role are merged into one run, between whose texts NEXT stands. ``spans`` (start
    from 0, length; in characters of ``formatted``) hold the escaped texts of ``trained_role`` and nothing else.
    Null conv_ids form one conversation. A conversation is one output value, so it has to fit into a row. Other
    columns are ignored. Returns conv_id, formatted, spans array<struct<start long, length long>>.
    """
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    body = escape(F.col("text"))
    first = F.lag("role").over(order).isNull() | (F.lag("role").over(order) != F.col("role"))
    last = F.lead("role").over(order).isNull() | (F.lead("role").over(order) != F.col("role"))
    rows = rows.select("conv_id", "turn", "role", body.alias("body"), F.col("text"), first.alias("first"), last.alias("last"))
    head = F.when(F.col("first"), F.length(F.lit(OPEN)) + F.length(escape(F.col("role"))) + len(BODY)).otherwise(len(NEXT)).cast("long")
    size = F.length("body").cast("long")
    place = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.sum(head + size + F.when(F.col("last"), len(CLOSE)).otherwise(0)).over(place.rowsBetween(W.unboundedPreceding, 0)) - size - F.when(F.col("last"), len(CLOSE)).otherwise(0))
    # ``at`` grows from turn to turn, so repeated rows keep the window's order, in which ``first`` and ``at`` were found.
    turns = F.array_sort(F.collect_list(F.struct(F.col("at").alias("start"), "role", "first", "body", size.alias("length"))))
    chats = rows.groupBy("conv_id").agg(turns.alias("turns"))
    heads = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["first"])
    chats = chats.withColumn("heads", heads)

    def run(i: Column, k: Column) -> Column:
        after = F.coalesce(F.try_element_at("heads", k + 2), F.size("turns") + 1)
        texts = F.transform(F.slice("turns", i, after - i), lambda t: t["body"])
        return F.concat(F.lit(OPEN), escape(F.element_at("turns", i)["role"]), F.lit(BODY), F.array_join(texts, NEXT), F.lit(CLOSE))

    trained = F.filter("turns", lambda t: t["role"] == trained_role)
    return chats.select(
        "conv_id",
        F.array_join(F.transform("heads", run), "").alias("formatted"),
        F.transform(trained, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted string holds: array<struct<role, text>>, one for each turn that went in."""
    runs = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda r: r != "")

    def turns(run: Column) -> Column:
        halves = F.split(F.substring(run, len(OPEN) + 1, 2**31 - 1), r"<\|text\|>")
        return F.transform(F.split(halves[1], r"<\|next\|>"), lambda t: F.struct(unescape(halves[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, with nothing between."""
    cut = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, cut), "")


def digests(chats: DataFrame) -> DataFrame:
    """What a formatted conversation reads back as: counts and digests of its turns and of its loss text."""
    turns = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
