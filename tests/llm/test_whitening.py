from collections import defaultdict
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def model(vectors):
    """The fit list's rows, sums and covariance, in fractions."""
    fit = sorted({tuple(floor(Fraction(c) * 256) for c in v) for v in vectors})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    y = [[n * x[i] - s[i] for i in range(d)] for x in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    return n, s, v


def check(rows, vectors, most=4):
    n, s, v = model(list(vectors.values()))
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    by = defaultdict(list)
    for r in rows:
        by[r.vec_id].append(r)
    assert set(by) == set(vectors)
    signs = {}
    for ident, got in by.items():
        assert sorted(r.component for r in got) == list(range(1, min(most, len(s)) + 1))
        x = [floor(Fraction(c) * 256) for c in vectors[ident]]
        far = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        for r in got:
            k = r.component - 1
            w = sum(float(Fraction(n * a - b, n)) * u[i, k] for i, (a, b) in enumerate(zip(x, s, strict=True))) / e[k] ** 0.5
            if abs(w) > 1e-3:
                signs.setdefault(k, np.sign(w * r.whitened))
                assert r.whitened == pytest.approx(signs[k] * w, rel=1e-6, abs=1e-7)
            assert (r.n, int(r.deviation)) == (n, far) and r.explained == pytest.approx(e[k] / np.trace(v), rel=1e-9) and 0 <= r.identity_error < 1e-9


def test_query_against_fractions(spark):
    e = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = queries.op13_whitening(spark, SF).collect()
    check(rows, {i: v for i, v in e.items()})
    assert len({r.identity_error for r in rows}) == 1


def test_polarisation_gives_the_covariance():
    rng = np.random.default_rng(3)
    for scale, limbs in ((50, 2), (10**6, 3)):
        x = rng.integers(-scale, scale, (300, 5))
        n, s = len(x), x.sum(axis=0)
        y = n * x - s
        squares = []
        for i in range(5):
            for j in range(i, 5):
                parts = whitening._limbs(y[:, i] if i == j else y[:, i] + y[:, j], limbs)
                squares += [(i, j, k, sum(int(p) * int(q) for p, q in zip(parts[a], parts[b], strict=True))) for k, (a, b) in enumerate((a, b) for a in range(limbs) for b in range(a, limbs))]
        want = [[sum(int(p) * int(q) for p, q in zip(y[:, i], y[:, j], strict=True)) / n**3 for j in range(5)] for i in range(5)]
        assert whitening.covariance(squares, 5, n, limbs).tolist() == want


def test_dropped_rows_copies_and_large_values(spark):
    rng = np.random.default_rng(1)
    for scale in (1.0, 3e9, 1e14):
        e = {i: (rng.normal(size=5) * scale).tolist() for i in range(60)}
        e |= {100 + i: e[0] for i in range(40)} | {200: [0.001 * scale / 300] * 5, 201: [-0.0] * 5}
        bad = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [1.0, float("nan"), 0.0, 0.0, 0.0]), (303, [float("inf")] * 5), (304, [1e300] * 5), (305, [])]
        docs = spark.createDataFrame([*e.items(), *bad], "vec_id long, embedding array<double>").withColumn("x", F.lit("a"))
        check(whitening.whiten(docs).collect(), e)


def test_widths_flat_lists_and_empty_tables(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, -1.0]), (2, [7.0, 0.0]), (3, [1.0]), (4, [1.0]), (5, [0.1, 0.2, 0.3])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten(docs).collect()
    assert len(got) == 2 * 4 + 1 * 2 + 3 and all(r.whitened is None or isfinite(r.whitened) for r in got)
    two = [r for r in got if r.n == 3]
    assert len(two) == 8 and sum(r.explained for r in two if r.vec_id == 2) == pytest.approx(1) and all(r.whitened is not None and r.identity_error < 1e-9 for r in two)
    flat = [r for r in got if r.vec_id in (3, 4, 5)]
    assert all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in flat)
    assert whitening.whiten(docs.limit(0)).count() == 0


def test_copies_and_batches_change_nothing(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    more = e.unionByName(e.where("vec_id % 7 = 0").select((F.col("vec_id") + 10_000).alias("vec_id"), "embedding")).repartition(7)
    one, two = ({(r.vec_id, r.component): r for r in whitening.whiten(d).collect()} for d in (e, more))
    assert len(two) > len(one) and all(two[k].deviation == r.deviation and abs(abs(two[k].whitened) - abs(r.whitened)) < 1e-9 for k, r in one.items())
