"""What the operators of this subpackage share: tables in the shared folder, gapless ranks, components."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Words are maximal runs of other bytes than blank, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a group that one task numbers, about.
RANKED = 65_536


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Let Arrow batches have at most ``rows`` rows in this session: rows here hold whole texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; the session's Arrow batches become small."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that was freed back to the system, as far as Arrow's and the C library's allocators hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


_held: list = []


def hold(drop) -> None:
    """Note how to drop what this worker keeps between tasks."""
    _held.append(drop)


def drop_held() -> None:
    for drop in _held:
        drop()
    _held.clear()


def releasing(f, keep: bool = False):
    """``f``, a function of Arrow batches, followed by ``release``: a worker lives on after its task, beside those of other stages.

    What tasks of another function have left in the worker is dropped first, unless ``keep``.
    """

    def run(batches):
        if not keep:
            drop_held()
        yield from f(batches)
        release()

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary one; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pairlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class _Written(threading.local):
    """The tables that this thread's operators write, for each ``intermediates`` that is open."""

    def __init__(self):
        self.open: list[list[str]] = []


_written = _Written()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again.

    It cuts the lineage: what was written survives the loss of any executor. See ``intermediates`` and ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pairlens/{uuid.uuid4().hex}"
    for paths in _written.open[-1:]:
        paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pairlens_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and that nothing reads any more."""
    remove(df.sparkSession, df._pairlens_path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Remove, at its end, all tables that operators of this thread wrote inside: write their results before it ends."""
    _written.open.append([])
    try:
        yield
    finally:
        for path in _written.open.pop():
            remove(spark, path)


def gapless_rank(df: DataFrame, keys: list[str], by: list[str], out: str) -> DataFrame:
    """Number the rows of each group of ``keys`` from 0 without gaps, in an order that hashes of ``by`` fix.

    A group of more than ``RANKED`` rows is cut into hash buckets that are counted first; a bucket's numbers begin
    where the counts of the buckets before it end. So a group that holds a third of all rows is numbered by many
    tasks, and the numbers are the same whatever the cluster.
    """

    def joined(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
        names = {k: f"_k{i}" for i, k in enumerate(on)}
        same = F.lit(True)
        for k, name in names.items():
            same &= F.col(k).eqNullSafe(F.col(name))
        return rows.join(table.withColumnsRenamed(names), same, "left").drop(*names.values())

    def placed(rows: DataFrame, on: list[str]) -> DataFrame:
        return rows.withColumn(out, (F.row_number().over(W.partitionBy(*on).orderBy(F.xxhash64(*by), *by)) - 1).cast("long"))

    big = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > RANKED).select(*keys, F.ceil(F.col("_n") / RANKED).alias("_buckets")))
    if not big.limit(1).count():
        return placed(df, keys)
    dealt = joined(df, big, keys).withColumn("_bucket", F.coalesce(F.pmod(F.xxhash64(F.lit(1), *by), F.col("_buckets")), F.lit(0)))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.where("_buckets IS NOT NULL").groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = materialize(counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    ranked = joined(placed(dealt, [*keys, "_bucket"]), starts, [*keys, "_bucket"])
    return ranked.withColumn(out, F.col(out) + F.coalesce("_start", F.lit(0))).drop("_bucket", "_buckets", "_start")


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest id of each component of the given edges."""
    if not len(a):
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new[new]]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(ids))
    return ids[keep], ids[label[keep]]


def _contracted(batches):
    """The edges of a task as stars, about a million at a time."""
    a, b, n = [], [], 0
    for batch in batches:
        a.append(batch["a"].to_numpy())
        b.append(batch["b"].to_numpy())
        n += batch.num_rows
        if n > 1_000_000:
            a, b = ([x] for x in spanning(np.concatenate(a), np.concatenate(b)))
            n = 0
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spanning(np.concatenate(a), np.concatenate(b))], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph of ``edges`` (a long, b long): a row (id, component) for each id in an edge.

    ``component`` is the smallest id that links reach. Alternating large-star and small-star rounds, each a
    group-by and a join; a round's edges and its least neighbours are tables in the shared folder, so that the join has
    exchanges of its own, of which Spark can split a hot id's. Rounds grow with the logarithm of the
    longest path; edges of a task are contracted before the first. Edges with a null end are left out.
    """
    now = materialize(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").mapInArrow(_contracted, "a long, b long").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = materialize(small)
        row = after.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        drop(now)
        now = after
        if (row.n, row.x) == state:
            break
        state = (row.n, row.x)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
