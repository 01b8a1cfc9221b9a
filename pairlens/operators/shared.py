"""The folder that driver and executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a local session gets a temporary one; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pairlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder, which survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def null_safe_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, of which null equals null; the table's other columns are added."""
    names = {k: f"_of{i}" for i, k in enumerate(keys)}
    same = F.lit(True)
    for k, name in names.items():
        same &= F.col(k).eqNullSafe(F.col(name))
    return rows.join(table.withColumnsRenamed(names), same, how).drop(*names.values())


def places_by_hash(df: DataFrame, keys: list[str], draw: Column, ident: str, first: Column | None = None, out: str = "_place", total: str | None = None) -> DataFrame:
    """Number the rows of each key from 1 by ``draw`` (a hash in hex), then ``ident``; those of least ``first`` before others.

    Rows are counted by the first digits of the hash, and numbered within these buckets: a key of any size is numbered by
    many tasks. ``total`` names a column for the rows of the key.
    """
    order = F.lit(0) if first is None else first
    dealt = df.withColumn("_draw", draw).withColumn("_bucket", F.concat(order.cast("string"), F.substring("_draw", 1, 3)))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = [F.sum("_n").over(W.partitionBy(*keys)).alias(total)] if total else []
    starts = counts.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_start"), *sizes)
    placed = dealt.withColumn(out, F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy("_draw", ident)))
    return null_safe_join(placed, starts, [*keys, "_bucket"]).withColumn(out, F.col(out) + F.col("_start")).drop("_draw", "_bucket", "_start")


def running_total(df: DataFrame, keys: list[str], order: str, value: str | list[str], out: str | list[str]) -> DataFrame:
    """The sum of ``value`` over the rows of a key that come before in ``order``: by ranges first, then within each.

    Ranges are even over all keys, so a key of any size is summed by many tasks. Several values are summed in one pass.
    """
    values, outs = ([x] if isinstance(x, str) else x for x in (value, out))
    spread = cut(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    sums = spread.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_sum{i}") for i, v in enumerate(values)])
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    before = upto(W.partitionBy(*keys).orderBy("_part"))  # of a key's ranges, which are no more than tasks
    starts = sums.select(*keys, "_part", *[F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)).alias(f"_start{i}") for i in range(len(values))])
    inner = upto(W.partitionBy(*keys, "_part").orderBy(order))
    within = spread.withColumns({o: F.coalesce(F.sum(v).over(inner), F.lit(0)) for v, o in zip(values, outs, strict=True)})
    found = null_safe_join(within, starts, [*keys, "_part"]).withColumns({o: F.col(o) + F.col(f"_start{i}") for i, o in enumerate(outs)})
    return found.drop("_part", *[f"_start{i}" for i in range(len(values))])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], out: str = "quantiles") -> DataFrame:
    """Exact quantiles of ``value`` by ``keys`` (none: of all rows), interpolated between neighbours; keys, ``out`` (doubles).

    Different values are counted, the counts are added up over ranges of values, and of each share the two values are
    taken whose ranges of places hold it: no task holds all values of a key. Nulls don't count; a key of nulls alone has
    nulls.
    """
    counts = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_n"))
    ranked = running_total(counts.where("_n > 0"), keys, "_v", "_n", "_before")
    total = ranked.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    sized = null_safe_join(ranked, total, keys) if keys else ranked.crossJoin(F.broadcast(total))
    at = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col("_v")))
    found, names = [], []
    for i, share in enumerate(shares):
        place = share * (F.col("_total") - 1)
        found += [at(F.floor(place)).alias(f"_low{i}"), at(F.ceil(place)).alias(f"_high{i}"), F.max(place - F.floor(place)).alias(f"_part{i}")]
        names.append(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}"))
    picked = sized.groupBy(*keys).agg(*found).select(*keys, F.array(*names).alias(out))
    if not keys:
        return picked
    return null_safe_join(df.select(*keys).distinct(), picked, keys, "left").withColumn(out, F.coalesce(out, F.array(*[F.lit(None).cast("double")] * len(shares))))


def components(edges: DataFrame) -> DataFrame:
    """Components of the graph of ``edges`` (a, b): a row (id, label) for each id in an edge, label the least id that links reach.

    Each round links every id's larger neighbours, then its smaller ones, to the least of all, so rounds grow with the
    logarithm of the longest path. A round's edges and least neighbours are checkpoints in the shared folder.
    """
    now, state = cut(edges.select("a", "b").where("a <> b").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("_m")))
        larger = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        least = cut(larger.groupBy("a").agg(F.min("b").alias("_m")))
        smaller = larger.join(least, "a").select(F.when(F.col("b") == F.col("_m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("_m").alias("b"))
        now = cut(smaller.where("a <> b").distinct())
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == state:
            break
        state = new
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(roots)
