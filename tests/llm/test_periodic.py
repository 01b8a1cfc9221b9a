import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from pairlens.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def runs(x):
    """All runs, by looking at every lag and every shorter one."""
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q) and not any(all(x[k] == x[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(4)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    yield from ([], [0], [0] * 11, [0] * 12, [0] * 400, fib[-1], list(range(50)) * 4 + [7])
    thue = [0]
    while len(thue) < 256:
        thue += [1 - v for v in thue]
    yield thue + thue[:100]
    for _ in range(150):
        u = [rng.randrange(rng.choice((2, 3, 40))) for _ in range(rng.randrange(1, 80))]
        x = [rng.randrange(40) for _ in range(rng.randrange(30))] + u * rng.randrange(1, 5) + u[: rng.randrange(len(u) + 1)] + [rng.randrange(40) for _ in range(9)]
        yield x if rng.random() < 0.7 else x * 2
        block = [0] * rng.randrange(1, 60) + [1] * rng.randrange(30)
        yield block * rng.randrange(2, 4)


def test_runs_against_every_lag():
    for x in texts():
        assert [(a, b - a, q) for a, b, q in periodic.find_runs(np.array(x, np.int64)).tolist()] == runs(x), x


def test_long_periods_and_long_texts():
    rng = np.random.default_rng(1)
    u = rng.integers(0, 10**6, 30_000)
    assert periodic.find_runs(np.concatenate([u, u, u[:7]])).tolist() == [[0, 60_007, 30_000]]
    assert periodic.find_runs(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]
    x = np.tile(np.r_[np.zeros(50, np.int64), 1], 2000)
    got = periodic.find_runs(x).tolist()
    assert [0, len(x), 51] in got and len(got) == 2001


def test_wrong_hashes_are_mended(monkeypatch):
    """Where hashes of all stretches are equal, words decide."""
    rng = np.random.default_rng(2)
    u = rng.integers(0, 30, 40)
    x = np.concatenate([rng.integers(0, 30, 20), u, u, rng.integers(0, 30, 20)])
    true = periodic._extended
    monkeypatch.setattr(periodic, "_extended", lambda *a: tuple(v + d for v, d in zip(true(*a), (-1, 2), strict=True)))
    assert [(a, b - a, q) for a, b, q in periodic.find_runs(x).tolist()] == runs(x.tolist())


def want(doc_id, text, turn):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if turn and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found, gone = runs(w), set()
    for s, n, q in found:
        gone.update(range(s + q, s + n))
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    said = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(said.encode()), sha(kept)), found, kept.decode()


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").collect()
    expected = {d.doc_id: want(d.doc_id, d.text, True)[0] for d in docs}
    got = queries.op12_periodic_runs(spark, SF).where(F.col("doc_id").isin(list(expected))).collect()
    assert len(got) == len(docs) and sum(r.n_runs for r in got) > 5
    for r in got:
        assert (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected[r.doc_id]


def test_edges(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a " * 12), (4, "a " * 12), (None, "x y " * 9), (5, "a b\x1c " * 6 + "é " * 13), (6, "w " * 5000), (7, " ".join(map(str, [*range(400)] * 2)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("x"))
    for together in (1 << 18, 1):
        monkeypatch.setattr(periodic, "TOGETHER", together)
        for turn in (False, True):
            expected = sorted((want(*r, turn) for r in rows), key=str)
            got = sorted(((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")), [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in periodic.detect_runs(docs, turn).collect()), key=str)
            assert got == expected
    assert periodic.detect_runs(docs.limit(0)).count() == 0
