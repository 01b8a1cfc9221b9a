"""Sharding by longest-processing-time scheduling: groups stay together, the largest first to the least loaded shard."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import gapless_rank, materialize

#: Hash buckets, whatever the cluster; bins of a bucket; the parts of a shard from which a group is a bin of its own.
BUCKETS, BINS, PARTS = 512, 64, 64


def _bins(bins: int, large: int):
    """Deal the groups of each bucket, largest first, to its least loaded bin; a large group is a bin alone."""

    def deal(batches):
        bucket, heap, alone = None, [], bins
        for batch in batches:
            out = []
            for b, size in zip(batch["bucket"].to_pylist(), batch["group_size"].to_pylist(), strict=True):
                if b != bucket:
                    bucket, heap, alone = b, [(0, i) for i in range(bins)], bins
                if size >= large:
                    out.append(alone)
                    alone += 1
                else:
                    load, i = heap[0]
                    heapq.heapreplace(heap, (load + size, i))
                    out.append(i)
            yield pa.RecordBatch.from_arrays([batch["group_key"], batch["bucket"], pa.array(out, pa.int32()), batch["group_size"]], ["group_key", "bucket", "bin", "group_size"])

    return deal


def lpt_shards(groups: DataFrame, shards: int, buckets: int = BUCKETS) -> DataFrame:
    """Assign ``groups`` (group_key, group_size) to shards 0 to ``shards`` - 1 with near equal sums of group_size.

    Longest-processing-time in two levels, so that no task and not the driver sees all groups: hash buckets deal
    their sorted groups to bins through a heap, then the bins (``BINS`` a bucket, and the few groups of over
    1/``PARTS`` of a shard) go, largest first, to the least loaded shard through a heap. ``buckets`` has to be the
    same for the same shards; a cluster with more tasks than that wants more. Group keys are unique and not null.
    Ties go by key, then by bin number: reruns agree on any cluster. No groups: no rows.
    Returns group_key, shard int.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    dealt = groups.select("group_key", F.pmod(F.xxhash64("group_key"), F.lit(buckets)).cast("int").alias("bucket"), "group_size")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", F.desc("group_size"), "group_key")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema if f.name != "group_size")
    dealt = materialize(dealt.mapInArrow(_bins(BINS, max(1, total // (shards * PARTS))), f"{kinds}, bin int, group_size long"))
    # Of bounded number: bins of each bucket, and at most shards * PARTS large groups.
    loads = dealt.groupBy("bucket", "bin").agg(F.sum("group_size").alias("load")).collect()
    heap, rows = [(0, s) for s in range(shards)], []
    for r in sorted(loads, key=lambda r: (-r.load, r.bucket, r.bin)):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + r.load, s))
        rows.append((r.bucket, r.bin, s))
    where = spark.createDataFrame(rows, "bucket int, bin int, shard int")
    return dealt.join(F.broadcast(where), ["bucket", "bin"]).select("group_key", "shard")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard documents (doc_id, text) so that equal texts stay together and shards' bytes are near equal.

    A document's size is the UTF-8 bytes of its text plus 1; a null text has none, and null texts form one group.
    A group above a shard's share fills a shard alone. Repeated rows each keep a slot. Other columns are ignored.
    Returns doc_id, size long, text_crc32 long (a null text's is 0), shard int, slot long (0.. in each shard).
    """
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = materialize(
        docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.coalesce(F.md5(F.encode("text", "UTF-8")), F.lit("null")).alias("group_key"))
    )
    where = lpt_shards(rows.groupBy("group_key").agg(F.sum("size").alias("group_size")), shards)
    placed = rows.join(where, "group_key").drop("group_key")
    return gapless_rank(placed, ["shard"], ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
