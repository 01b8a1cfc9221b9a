"""Whitening of embeddings by polarisation: exact variances of dimensions and of sums of two give every covariance.

For centred values y of a fit list, 2 cov(i, j) = var(i + j) - var(i) - var(j). Tasks sum the squares of y_i and of
y_i + y_j as whole numbers, in limbs of 24 bits, so that the sums are exact at any size; the driver puts the matrix together
and takes its eigenvectors.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize

#: Parts that a unit of an embedding is cut into; bits of a limb; vectors that are squared together.
PARTS, LIMB, ROWS = 256, 24, 2048


def _whole(batches):
    """Rows whose vector is sound, with its values as whole numbers."""
    for batch in batches:
        lists = batch["embedding"]
        flat = lists.flatten()
        null = flat.is_null().to_numpy(zero_copy_only=False)
        value = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(PARTS * value)
        sound = ~null & np.isfinite(value) & (x >= -(2.0**63)) & (x < 2.0**63)
        wide = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.cumsum(wide)
        bad = np.concatenate([[0], np.cumsum(~sound)])
        keep = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - wide])
        x = np.where(sound, x, 0).astype(np.int64)[np.repeat(keep, wide)]
        offsets = np.concatenate([[0], np.cumsum(wide[keep])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch["vec_id"].filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], ["vec_id", "x"])


def _by_width(batches, rows: int = ROWS):
    """Index ranges of each batch by width: width, row numbers, and the matrix of their values (a row for each vector)."""
    for batch in batches:
        flat, wide = batch["x"].flatten().to_numpy(), batch["x"].value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(wide) - wide
        for d in np.unique(wide[wide > 0]).tolist():
            own = np.flatnonzero(wide == d)
            for low in range(0, len(own), rows):
                at = own[low : low + rows]
                yield batch, d, at, flat[starts[at][:, None] + np.arange(d)]


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(batches):
    """Of each width: rows, sums and largest magnitudes of the dimensions."""
    total: dict[int, list] = {}
    for _, d, at, x in _by_width(batches):
        high, low = (x >> 32).sum(axis=0).astype(object), (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        n, s, most = total.get(d, (0, 0, 0))
        total[d] = [n + len(at), s + high * 2**32 + low, np.maximum(most, np.maximum(-(x.min(axis=0).astype(object)), x.max(axis=0).astype(object)))]
    for d, (n, s, most) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), _decimals(s), _decimals(most)], ["width", "i", "n", "s", "most"])


def _centred(x: np.ndarray, n: int, s: list[int], bits: int) -> np.ndarray:
    """n x - S of each dimension, exact: in 64 bits where ``bits`` suffice, else as Python's whole numbers."""
    if bits < 62:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def _limbs(y: np.ndarray, many: int) -> list[np.ndarray]:
    mask = (1 << LIMB) - 1
    return [((y >> LIMB * k) & mask).astype(np.int64) for k in range(many - 1)] + [(y >> LIMB * (many - 1)).astype(np.int64)]


def _squares(fits: dict):
    """Of each width, dimension i and partner j (itself: the dimension alone): sums of products of limbs of y_i + y_j."""

    def add(batches):
        total: dict[tuple[int, int], list] = {}
        for _, d, _, x in _by_width(batches):
            n, s, bits = fits[d]
            y, many = np.ascontiguousarray(_centred(x, n, s, bits).T), -(-(bits + 2) // LIMB)
            for i in range(d):
                parts = _limbs(np.concatenate([y[i : i + 1], y[i + 1 :] + y[i]]), many)
                got = [np.einsum("ir,ir->i", parts[a], parts[b]).astype(object) for a in range(many) for b in range(a, many)]
                total[d, i] = [t + g for t, g in zip(total[d, i], got, strict=True)] if (d, i) in total else got
        for (d, i), sums in total.items():
            m, k = len(sums[0]), len(sums)
            columns = [pa.array(np.full(m * k, d, np.int32)), pa.array(np.full(m * k, i, np.int32)), pa.array(np.tile(np.arange(i, i + m, dtype=np.int32), k)), pa.array(np.repeat(np.arange(k, dtype=np.int32), m))]
            yield pa.RecordBatch.from_arrays([*columns, _decimals(np.concatenate(sums))], ["width", "i", "j", "part", "total"])

    return add


def covariance(squares: list[tuple[int, int, int, int]], d: int, n: int, limbs: int) -> np.ndarray:
    """The covariance matrix from ``squares`` (i, j, part, total) by polarisation; exact up to the last rounding."""
    scale = [(1 if a == b else 2) << LIMB * (a + b) for a in range(limbs) for b in range(a, limbs)]
    var: dict[tuple[int, int], int] = {}
    for i, j, part, total in squares:
        var[i, j] = var.get((i, j), 0) + scale[part] * total
    out = np.zeros((d, d))
    for (i, j), v in var.items():
        out[i, j] = out[j, i] = (v if i == j else (v - var[i, i] - var[j, j]) // 2) / n**3  # the difference is even
    return out


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of ``v``, their unit eigenvectors as rows, and their parts of the trace."""
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    trace = float(np.trace(v))
    return e[order], u[:, order].T, e[order] / trace if trace > 0 else np.full(len(order), np.nan)


def _whitened(y: np.ndarray, n: int, e: np.ndarray, u: np.ndarray, solid: np.ndarray) -> np.ndarray:
    out = np.full((len(y), len(e)), np.nan)
    out[:, solid] = (y.astype(np.float64) / n) @ u[solid].T / np.sqrt(e[solid])
    return out


def _products(models: dict):
    """Of each width: sums of the whitened components and of their products."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for _, d, _, x in _by_width(batches):
            n, s, bits, e, u, solid = models[d][:6]
            w = np.column_stack([np.ones(len(x)), _whitened(_centred(x, n, s, bits), n, e, u, solid)[:, solid]])
            total[d] = total.get(d, 0) + w.T @ w
        for d, t in total.items():
            k = t.size
            yield pa.RecordBatch.from_arrays([pa.array([d] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(t.ravel())], ["width", "at", "total"])

    return add


def _applied(models: dict, errors: dict):
    def apply(batches):
        for batch, d, at, x in _by_width(batches):
            n, s, bits, e, u, solid, part = models[d]
            y, k = _centred(x, n, s, bits), len(e)
            w = _whitened(y, n, e, u, solid)
            far = (y * y).sum(axis=1) if 2 * bits + d.bit_length() < 63 else (y.astype(object) ** 2).sum(axis=1)
            far = pa.array([Decimal(int(f)) if f < 10**38 else None for f in far], pa.decimal128(38, 0))
            rows = pa.array(np.repeat(np.arange(len(at)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(at)).take(rows),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(rows), n, np.int64)),
                    far.take(rows),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(part, len(at)), from_pandas=True),
                    pa.array(np.full(len(rows), errors[d]), from_pandas=True),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return apply


def whiten(vectors: DataFrame, most: int = 4) -> DataFrame:
    """Whitened components of embeddings (vec_id long, embedding): a row for each sound vector and component 1 to ``most``.

    Entries become whole numbers x = floor(256 c). The fit list is each distinct x vector once; ``n`` are its vectors,
    ``deviation`` (decimal) is the sum over dimensions of (n x - S)^2 with S the list's sums, ``whitened`` the centred vector on a unit
    eigenvector of the list's covariance over the root of its eigenvalue, ``explained`` the eigenvalue's part of the trace,
    ``identity_error`` the largest entry of the whitened list's covariance minus the identity.
    A null vector, or one with an entry that is null, not finite, or too large for a long as x, is dropped; an empty one
    has no components. Vectors of each width are a family of their own. Where an eigenvalue is 0 but for rounding (equal
    vectors, fewer vectors than dimensions), ``whitened`` is null and the identity is held against the others; ``explained``
    is null where nothing varies. A deviation of over 38 digits is null. Repeated rows each give their rows, and null
    ids are kept; an empty table gives none. Other columns are ignored.
    Squares of d (d + 1) / 2 sums are added up by tasks; the driver gets these totals, one for each pair of dimensions.
    """
    spark = vectors.sparkSession
    rows = materialize(vectors.select("vec_id", "embedding").mapInArrow(_whole, "vec_id long, x array<long>"))
    fit = materialize(rows.select("x").distinct())
    sums = fit.mapInArrow(_sums, "width int, i int, n long, s decimal(38,0), most decimal(38,0)").groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("string").alias("s"), F.max("most").cast("string").alias("most"))
    fits: dict[int, tuple] = {}
    for r in sums.orderBy("width", "i").collect():
        n, s, most_of = fits.get(r.width, (r.n, [], 0))
        fits[r.width] = (r.n, [*s, int(r.s)], max(most_of, int(r.most)))
    fits = {d: (n, s, (2 * n * m).bit_length()) for d, (n, s, m) in fits.items()}
    models, errors = {}, {}
    if fits:
        squares = fit.mapInArrow(_squares(fits), "width int, i int, j int, part int, total decimal(38,0)")
        got = squares.groupBy("width", "i", "j", "part").agg(F.sum("total").alias("total")).toArrow()
        columns = [got[c].to_pylist() for c in ("width", "i", "j", "part", "total")]
        own: dict[int, list] = {}
        for d, i, j, part, total in zip(*columns, strict=True):
            own.setdefault(d, []).append((i, j, part, int(total)))
        for d, (n, s, bits) in fits.items():
            e, u, part = components(covariance(own[d], d, n, -(-(bits + 2) // LIMB)), most)
            solid = e > max(e.max(initial=0), 0) * d * np.finfo(float).eps * 8
            models[d] = (n, s, bits, e, u, solid, part)
        products = fit.mapInArrow(_products(models), "width int, at int, total double").groupBy("width", "at").agg(F.sum("total").alias("total")).collect()
        for d, (n, *_, solid, _) in models.items():
            k = int(solid.sum()) + 1
            t = np.zeros(k * k)
            for r in products:
                if r.width == d:
                    t[r.at] = r.total
            t = t.reshape(k, k) / n
            errors[d] = float(np.abs(t[1:, 1:] - np.outer(t[0, 1:], t[0, 1:]) - np.eye(k - 1)).max()) if k > 1 else None
    kinds = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return rows.mapInArrow(_applied(models, {d: np.nan if e is None else e for d, e in errors.items()}), kinds)
