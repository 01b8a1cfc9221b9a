import random
import re

import numpy as np
from pyspark.sql import functions as F

from pairlens.llm import ngram_join

SF = "/root/testdata/sf0.001"


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and den * min(len(s), len(t)) >= num * max(len(s), len(t)) and den * len(s & t) >= num * len(s | t):
                p, q = sorted((root(a), root(b)))
                comp[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def got(docs, n, num, den):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, n, num, den).collect()}


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (12, 40, 90, 200, 400)]
    texts = [None, "", " \n\t", "one", "One", "one two", "ONE  two", "É two three", "é two three", "x x x x", "x x x x x"]
    texts += [edited(rng, b, k) for b in base for k in (0, 0, 1, 1, 1, 2, 3, 4, 6, 8, 12)] + [" ".join(rng.choice(vocabulary[:5]) for _ in range(30)) for _ in range(20)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("x")).withColumn("n", F.lit(1))
    for n, num, den in ((3, 90, 100), (5, 80, 100), (2, 70, 100)):
        assert got(docs, n, num, den) == brute(rows, n, num, den)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)  # groups in many tiles
    monkeypatch.setattr(ngram_join, "VOLUME", 500)
    assert got(docs, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "a b c d")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in ngram_join.jaccard_components(docs, 3).collect()) == [("7", "7"), ("7", "7"), ("9", "7"), ("None", "None"), ("None", "None")]


def test_empty_table(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_finds_what_connects():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 400, (6, 30))
    sets = [np.unique(np.concatenate([rng.permutation(base[i % 6])[: rng.integers(18, 30)], rng.integers(0, 400, 4)])) for i in range(60)]

    def groups(links):
        a, b = ngram_join.spanning(*np.array(links).T)
        return sorted(zip(a.tolist(), b.tolist(), strict=True))

    for num in (50, 60, 70):
        every = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j]))]
        links = ngram_join.trie_links(sets, num, 100)
        assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in every} and groups(links) == groups(every)


def test_long_near_copies(spark):
    """Texts of 100,000 words: parts by hash range find them, and rows stay of bounded size."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    other = [f"w{rng.randrange(10**6)}" for _ in range(60_000)] + base[:40_000]
    rows = [(1, " ".join(base)), (2, edited(rng, base, 1500)), (3, edited(rng, base, 6000)), (4, " ".join(other)), (5, edited(rng, other, 900)), (6, edited(rng, base[:-8000], 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, 3, 90, 100) == brute(rows, 3, 90, 100)
    counts = spark.sparkContext.broadcast(ngram_join.counted(docs, 3)[1])
    parts = docs.mapInArrow(ngram_join._prefixes(3, 90, 100, counts), "doc_id long, class binary, n int, level int, part int, m int, sketch binary, first array<long>")
    most = parts.agg(F.max(F.octet_length("sketch") + 8 * F.size("first")), F.sum((F.octet_length("sketch") + 8) * F.size("first"))).first()
    assert most[0] < 5000 and most[1] < 30 * sum(len(t) for _, t in rows)


def test_large_groups_in_rounds(spark, monkeypatch):
    """A group of near copies in many blocks, beside some that share its passages but don't link with it."""
    monkeypatch.setattr(ngram_join, "VOLUME", 700)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(6)
    base, far = ([f"{p}{rng.randrange(10**5)}" for _ in range(60)] for p in "ab")
    texts = [edited(rng, base, rng.randrange(3)) for _ in range(90)] + [edited(rng, base, 12) for _ in range(15)] + [" ".join(base[:40] + far[: 20 + i]) for i in range(10)] + [edited(rng, far, 1) for _ in range(20)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, 3, 80, 100) == brute(rows, 3, 80, 100)


def test_candidates_of_a_hot_shingle_are_few(spark, monkeypatch):
    """Rows that are compared grow with a group of near copies, not with its square; those that stand apart still meet all."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**5)}" for _ in range(50)]
    seen, made = [], ngram_join._minor_tiles
    monkeypatch.setattr(ngram_join, "_minor_tiles", lambda *a: (lambda d: (seen.append(d.selectExpr("sum(size(tiles))").first()[0] or 0), d)[1])(made(*a)))
    for n in (150, 600):
        texts = [edited(rng, base, rng.randrange(2)) for _ in range(n)] + [" ".join(base[:30] + [f"v{i}"] * 40) for i in range(3)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert got(docs, 3, 80, 100) == brute(list(enumerate(texts)), 3, 80, 100)
        assert seen.pop() <= 8 * 48 * n and not seen  # of some fifty shingles
