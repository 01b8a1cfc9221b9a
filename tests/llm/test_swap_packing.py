import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairlens.llm import packing, swap_packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def used(lengths, window, pack):
    where, offsets = pack(lengths, window)
    load = Counter()
    for n, b, at in sorted(zip(lengths, where, offsets, strict=True), key=lambda r: (r[1], r[2])):
        assert at == load[b]
        load[b] += n
    assert max(load.values(), default=0) <= window
    return len(load)


def fewest(lengths, window):
    """The fewest bins, by trying all."""
    best = [len(lengths)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for k in range(len(room)):
            if room[k] >= lengths[i] and room[k] not in room[:k]:
                go(i + 1, [*room[:k], room[k] - lengths[i], *room[k + 1 :]])
        go(i + 1, [*room, window - lengths[i]])

    go(0, [])
    return best[0]


def test_few_bins():
    rng = random.Random(5)
    ours = best_fit = least = 0
    for _ in range(150):
        lengths = sorted((rng.randrange(15, 60) for _ in range(rng.randrange(1, 11))), reverse=True)
        n = used(lengths, 100, swap_packing.pack_lengths)
        best = fewest(lengths, 100)
        assert swap_packing.least_bins(lengths, 100) <= best <= n <= best + 1
        ours, best_fit, least = ours + n, best_fit + used(lengths, 100, packing.best_fit_decreasing), least + best
    assert ours <= best_fit and ours <= 1.01 * least


def test_search_beats_best_fit():
    rng = random.Random(6)
    for low, high in ((200, 700), (250, 520), (1, 1024)):
        lengths = sorted((rng.randrange(low, high) for _ in range(3000)), reverse=True)
        ours, first = used(lengths, 1024, swap_packing.pack_lengths), used(lengths, 1024, packing.best_fit_decreasing)
        assert swap_packing.least_bins(lengths, 1024) <= ours <= first and (low == 1 or ours < first)


def test_each_exchange_raises_squared_fill():
    """Every kind of exchange, on bins made for it; the sum of squares never falls."""
    squares = lambda bins: sum(sum(b) ** 2 for b in bins)
    for bins, want in (
        ([[60, 30], [10]], [[60, 30, 10]]),  # move
        ([[60, 30], [40, 5]], [[60, 40], [30, 5]]),  # one for one
        ([[60, 30], [25, 15]], [[60, 25, 15], [30]]),  # two for one
        ([[50, 22, 15], [50, 9]], [[50, 50], [22, 15, 9]]),  # one for two
    ):
        got = swap_packing.swap_search([list(b) for b in bins], 100)
        assert sorted(map(sorted, got)) == sorted(map(sorted, want)) and squares(got) > squares(bins)
    rng = random.Random(7)
    for _ in range(200):
        bins = [[rng.randrange(1, 50) for _ in range(rng.randrange(1, 3))] for _ in range(12)]
        got = swap_packing.swap_search([list(b) for b in bins], 100)
        assert squares(got) >= squares(bins) and len(got) <= len(bins) and all(got)
        assert sorted(itertools.chain(*got)) == sorted(itertools.chain(*bins)) and all(sum(b) <= 100 for b in got)


def check(docs, rows):
    t, left = Tokenizer.from_file(PATH), Counter()
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, at in enumerate([0, *range(first, len(ids), 1024)]):
            piece = ids[at : at + 1024] if k else ids[:first]
            left[(r.doc_id, k, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids))] += 1
    got = swap_packing.pack_documents(docs, PATH).collect()
    sequences = defaultdict(list)
    for r in got:
        left[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.doc_tokens)] -= 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert not any(left.values())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    return [r.length for r in got], len(sequences)


def test_tables(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lengths, sequences = check(docs.withColumn("salt", F.lit("x")), docs.collect())
    assert swap_packing.least_bins(lengths, 1024) <= sequences <= swap_packing.least_bins(lengths, 1024) + 2
    monkeypatch.setattr(swap_packing, "BUCKET", 20)  # several buckets of a task
    assert check(docs, docs.collect())[1] <= 1.1 * sequences


def test_edges(spark):
    t = Tokenizer.from_file(PATH)
    word = next(w for w in (" a", "x") if len(t.encode(w * 10, add_special_tokens=False).ids) == 10)
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 5000), *[(10 + n, word * n) for n in (1022, 1023, 1024, 2047, 2048)], *[(9, "same")] * 50]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, docs.collect())
    assert swap_packing.pack_documents(docs.limit(0), PATH).count() == 0
