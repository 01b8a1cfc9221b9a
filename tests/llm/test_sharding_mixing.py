import heapq
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pairlens.llm import common, mixing, sharding

SF = "/root/testdata/sf0.001"


def test_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit(9)).withColumn("size", F.lit(1))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = sharding.shard_documents(docs, 16).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    load, where, slots = Counter(), {}, defaultdict(list)
    for r in got:
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
        assert where.setdefault(texts[r.doc_id], r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) <= 1.02 * sum(load.values()) / 16
    assert {tuple(r) for r in got} == {tuple(r) for r in sharding.shard_documents(docs, 16).collect()}


def test_shard_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y" * 100_000), (None, None)], "doc_id long, text string")
    got = sharding.shard_documents(docs, 4).collect()
    assert len(got) == 6 and len({r.shard for r in got if r.size == 2}) == 1
    assert sharding.shard_documents(docs.limit(0), 4).count() == 0


def fill(sizes, weights, share, most):
    """Targets by pouring: what is above a cap goes to the others by weight, again and again."""
    total = share * sum(sizes)
    goal, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(goal[i] for i in range(len(sizes)) if i not in open_)
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i]}
        for i in over or open_:
            goal[i] = most * sizes[i] if over else left * weights[i] / w
        if not over:
            break
        open_ -= over
    return goal


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "C": 400, "d": 0, "é": 90, None: 300, "z": 5000}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, (5, 2, 1), 1.5, 2).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)
    assert np.allclose([got[s] for s in order], want)


def test_knapsack_hits_budgets():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = np.unique(rng.integers(1, 3000, 80))
        counts = rng.integers(1, 50, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() * 1.2))
        take = mixing.knapsack(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert (take * sizes).sum() == min(budget, (sizes * counts).sum())


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("target", F.lit("x"))
    docs = docs.unionByName(docs.limit(3).withColumn("source", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(int)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by[(r.source, r.source_size, r.target)] += r.taken
    for (_, size, target), taken in by.items():
        assert abs(taken - target) <= max(2, 0.03 * size), (size, target, taken)  # sources of ten documents
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_knapsack_of_documents_longer_than_its_capacity():
    for sizes, counts, budget, want in (([200_000], [2], 150_000, [1]), ([200_000], [2], 90_000, [0]), ([0, 150_000, 400_000], [3, 1, 1], 80_000, [0, 1, 0])):
        assert mixing.knapsack(np.array(sizes), np.array(counts), budget).tolist() == want


def test_knapsack_of_few_long_documents():
    """Nearest sums of a few documents, by trying all."""
    assert mixing.knapsack(np.array([70_000, 200_000]), np.array([1, 1]), 190_000).tolist() == [0, 1]
    assert mixing.knapsack(np.array([16_384, 70_000]), np.array([9, 9]), 210_000).tolist() == [0, 3]
    assert mixing.knapsack(np.array([12_000, 90_000]), np.array([8, 4]), 180_000).tolist() == [0, 2]
    rng = np.random.default_rng(8)
    for _ in range(300):
        sizes = np.unique(rng.integers(1, rng.choice([100, 3000, 300_000, 5_000_000]), rng.integers(1, 6)))
        counts = rng.integers(1, 5, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(rng.integers(0, total))
        take = mixing.knapsack(sizes, counts, budget)
        best = min(abs(sum(int(s) * c for s, c in zip(sizes, some, strict=True)) - budget) for some in itertools.product(*[range(c + 1) for c in counts]))
        assert (take >= 0).all() and (take <= counts).all() and abs(int((take * sizes).sum()) - budget) <= best + (budget // 65_536 if budget > 1_000_000 else 0)


def test_knapsack_of_many_long_documents_and_of_odd_sizes():
    rng = np.random.default_rng(9)
    for n, top, most in ((2000, 200_000, 3), (60, 1_000_000, 3), (12_000, 20_000, 30)):
        sizes = np.unique(rng.integers(1, top, n))
        counts = rng.integers(1, most, len(sizes))
        budget = int((sizes * counts).sum() * 0.41)
        assert abs(int((mixing.knapsack(sizes, counts, budget) * sizes).sum()) - budget) <= budget // 65_536
    sizes = np.array([1000, 3000, 7000])  # sums are whole thousands
    assert mixing.knapsack(sizes, np.array([50, 60, 70]), 333_400) @ sizes == 333_000
    sizes = np.append(2 * np.unique(rng.integers(1, 5000, 900)), 10_001)  # one odd size, of one document
    counts = np.append(rng.integers(1, 30, len(sizes) - 1), 1)
    budget = int(sizes @ counts * 0.4) | 1
    assert mixing.knapsack(sizes, counts, budget) @ sizes == budget


def test_same_on_any_cluster(spark, monkeypatch):
    """Shards, slots and the mix don't depend on the number of shuffle partitions, nor on buckets of ranks."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = []
    for partitions in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got.append([sorted(map(tuple, d.collect()), key=str) for d in (sharding.shard_documents(docs, 16), mixing.mix(docs))])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]
    monkeypatch.setattr(common, "RANKED", 5)
    slots = defaultdict(list)
    for r in sharding.shard_documents(docs, 3).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_against_a_heap_over_all_groups(spark):
    """Loads come within a share of those of longest processing time over all groups at once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = Counter()
    for r in docs.collect():
        groups[r.text] += len((r.text or "").encode()) + 1
    heap = [(0, s) for s in range(16)]
    for size in sorted(groups.values(), reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    load = Counter()
    for r in sharding.shard_documents(docs, 16).collect():
        load[r.shard] += r.size
    assert max(load.values()) <= 1.02 * max(heap)[0]
