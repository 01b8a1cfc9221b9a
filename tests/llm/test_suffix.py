import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pairlens.llm import suffix

SF = "/root/testdata/sf0.001"


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        runs = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(b)])) if len(b) else 0
        out.append((len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("class", F.lit("x"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_against_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab é\n") for _ in range(n))
    p, q, line = text(230), text(700), text(199)
    texts = [None, "", "short", text(2000), text(500) + p + text(400), p, "x" + p + text(300) + p[:210], q[:650] + text(50), text(9) + q + text(9), q, q]
    texts += [text(300) + line + text(300), line, line + "z", "a" * 900, "ab" * 450, "a" * 199, "b" * 200, text(100) + q[100:330] + "!" + q[331:600]]
    texts += [q[:300] + str(i) + q[301:] for i in range(6)]
    check(spark, texts)


def test_hot_anchors_are_split(spark, monkeypatch):
    """Passages in ever new contexts: no group that is sorted is larger than HOT, and the result is the same."""
    hot, inner = 4000, suffix._sort
    monkeypatch.setattr(suffix, "HOT", hot, raising=False)

    def watched(length):
        sort = inner(length)

        def run(batches):
            batches, most = list(batches), {}
            for b in batches:
                for anchor, size in zip(b["anchor"].to_pylist(), b["size"].to_pylist(), strict=True):
                    most[anchor] = most.get(anchor, 0) + size
            assert max(most.values(), default=0) <= hot
            yield from sort(iter(batches))

        return run

    monkeypatch.setattr(suffix, "_sort", watched)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    lines = [text(80), text(150), text(180), "x" * 199]
    tails = [text(300) for _ in range(3)]
    texts = [text(250) + line + text(250) for line in lines for _ in range(60)]
    texts += [text(30) + lines[i % 3] + tails[i % 3][: 40 * i] + text(20) for i in range(12)]
    texts += [lines[1] + tails[0], tails[0][-40:] + lines[1] + text(80), "x" * 420, texts[0], lines[2] + text(300) + lines[2]]
    check(spark, texts)


def test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect()}
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows])


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_cover_all_windows():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8) % 3
    _, place, first, last = suffix.anchors(data, 200)
    assert first[0] == 0 and last[-1] == 4800 and (first[1:] == last[:-1] + 1).all()
    assert (place >= last).all() and (place + suffix.GRAM <= first + 200).all()


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(4)
    for _ in range(200):
        s = rng.integers(1, rng.integers(2, 6), rng.integers(0, 60))
        assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_periodic_texts(spark):
    """Long periodic texts: few windows are sorted, alone, beside others of their period, and inside other text."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    word = text(100)
    texts = ["a" * 3000, "xyz" * 700, text(300) + "xyz" * 100 + text(300), word * 30, text(50) + word * 4 + text(90), "-" * 150 + text(200), ("q" * 70 + "r") * 40, text(400)]
    check(spark, texts)
    data = np.frombuffer(b"abcdefg" * 150_000, np.uint8)
    keep, settled = suffix.collapsed(data, 200, *suffix.anchors(data, 200))
    assert keep.sum() < 20 and (settled[:, 1] - settled[:, 0]).sum() > 1_000_000
    docs = spark.createDataFrame([(1, "a" * 1_000_000), (2, "ab" * 500_000 + text(500)), (3, "ba" * 150)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes - r.n_removed, r.n_spans) for r in suffix.remove_repeats(docs).collect()}
    assert got == {1: (0, 1), 2: (len(docs.where("doc_id = 2").first().text.encode()) - 1_000_000, 1), 3: (0, 1)}


def test_rows_without_an_id(spark):
    """Texts of null ids are cut like all others, each by its own class."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    p = text(260)
    texts = [p + text(150), text(90) + p, text(400), text(50) + p + text(50), *[text(300)] * 2]
    docs = spark.createDataFrame([(None if i else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect())
    assert got == Counter(brute(texts))
