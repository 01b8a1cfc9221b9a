"""Logistic regression over hashed words of texts, whose counts lie in blocks, ordered by column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

#: Words and runs of words of a block, about, and rows of one at most: a row's place takes two bytes.
GRAMS, ROWS = 1 << 22, 1 << 16
#: Entries of a piece of a block, about (its arrays fit a core's cache), and sums that go to a task together.
ENTRIES, SLICE = 1 << 17, 1 << 16
#: Arrow batches of rows of hashes and of pieces: large ones cost more to make than to send.
BATCH, ONE = 200, 1
REGULAR, TOLERANCE, HISTORY = 1e-4, 1e-6, 10


def _block(hashes: np.ndarray, sizes: np.ndarray, features: int) -> list[tuple]:
    """Counts of rows of hashes by column, cut into pieces of whole columns: each entry's row and count, the columns and how many
    entries each has."""
    rows = len(sizes)
    kind = np.uint32 if features * rows < 1 << 32 else np.uint64
    key = (hashes.view(np.uint32) % np.uint32(features)).astype(kind) * kind(rows) + np.repeat(np.arange(rows, dtype=kind), sizes)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: key.size])
    n = np.diff(first, append=key.size)
    cols, at = np.divmod(key[first], kind(max(rows, 1)))
    starts = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]][: cols.size])
    at, n, ends = at.astype(np.uint16), n.astype(np.min_scalar_type(n.max(initial=0))), np.append(starts[1:], cols.size)
    cols, found, a, low = cols[starts].astype(np.int32), [], 0, 0
    while a < len(starts):
        b = max(int(np.searchsorted(ends, low + max(ENTRIES, 2 * rows), "right")), a + 1)
        found.append((at[low : ends[b - 1]], n[low : ends[b - 1]], cols[a:b], np.diff(ends[a:b], prepend=low).astype(np.int32)))
        a, low = b, int(ends[b - 1])
    return found


def _ranges(lists: pa.Array, grams: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``grams`` values, of ``ROWS`` rows at most."""
    ends, at = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)), 0
    while at < len(ends):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + grams, "right"))
        upto = min(max(upto, at + 1), at + ROWS)
        yield at, upto
        at = upto


def blocks(rows: DataFrame, names: list[str], features: int, grams: int = GRAMS) -> DataFrame:
    """Blocks of the rows (label, hashes), a row for each piece; labels, their places in ``names``, stand in the last one."""

    def write(batches):
        held, size, count = [], 0, 0

        def made():
            y = np.concatenate([h[0] for h in held]).astype(np.int32)
            none = tuple(np.zeros(0, kind) for kind in (np.uint16, np.uint8, np.int32, np.int32))
            for piece in [*_block(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), features), none]:
                cells = [y.tobytes() if piece is none else None, *(x.tobytes() for x in piece)]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in cells] + [pa.array([piece[1].itemsize], pa.int32())], ["y", "at", "n", "cols", "sizes", "width"])

        for batch in batches:
            y = pc.index_in(batch.column(0), value_set=pa.array(names)).to_numpy(zero_copy_only=False)
            for a, b in _ranges(batch.column(1), grams):
                lists = batch.column(1).slice(a, b - a)
                values = lists.flatten().to_numpy(zero_copy_only=False)
                if held and (size + len(values) > grams or count + b - a > ROWS):
                    yield from made()
                    held, size, count = [], 0, 0
                held.append((y[a:b], values.copy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
                size, count = size + len(values), count + b - a
        if held:
            yield from made()

    return rows.mapInArrow(write, "y binary, at binary, n binary, cols binary, sizes binary, width int")


def _summed(table: DataFrame, each: Callable, size: int) -> np.ndarray:
    """The sum of ``size`` numbers that ``each`` adds for a block: by partition, then in slices, in the order of partitions."""

    def part(batches):
        total, any_, pieces = np.zeros(size), False, []
        for batch in batches:
            for i in range(batch.num_rows):
                y, *cells = (batch.column(j)[i].as_buffer() for j in range(5))
                if y is None:
                    kinds = (np.uint16, f"u{batch.column(5)[i].as_py()}", np.int32, np.int32)
                    pieces.append(tuple(np.frombuffer(x, kind) for x, kind in zip(cells, kinds, strict=True)))
                else:
                    each(np.frombuffer(y, np.int32), pieces, total)
                    any_, pieces = True, []
        for k in range(0, size if any_ else 0, SLICE):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k // SLICE], pa.int32()), "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "sums": pa.array([total[k : k + SLICE].tobytes()], pa.binary())})

    def together(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("part")
        total = sum(np.frombuffer(x.as_buffer()) for x in parts.column("sums"))
        return pa.table({"slice": parts.column("slice")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size)
    for row in table.mapInArrow(part, "slice int, part int, sums binary").groupBy("slice").applyInArrow(together, "slice int, sums binary").collect():
        out[row.slice * SLICE : (row.slice + 1) * SLICE] = np.frombuffer(row.sums)
    return out


def _entries(pieces: list[tuple], idf: np.ndarray) -> Iterator[tuple]:
    """Of each piece: columns, their sizes and where each begins, each entry's row and its count times the column's rarity."""
    for at, n, cols, sizes in pieces:
        yield cols, sizes, np.cumsum(sizes) - sizes, at.astype(np.intp), np.repeat(idf[cols], sizes) * n


def _units(rows: int, pieces: list[tuple], idf: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What makes rows unit vectors, and the products of these with ``weights`` by direction and row."""
    length, scores = np.zeros(rows), np.zeros((len(weights), rows))
    for cols, sizes, _, at, z in _entries(pieces, idf):
        length += np.bincount(at, z * z, rows)
        for score, w in zip(scores, weights, strict=True):
            score += np.bincount(at, np.repeat(w[cols], sizes) * z, rows)
    unit = np.divide(1, np.sqrt(length), out=np.zeros(rows), where=length > 0)
    return unit, scores * unit


def contrasts(k: int) -> np.ndarray:
    """``k - 1`` directions in which scores of ``k`` classes that add up to nought can differ: at right angles and of length 1, so
    that steps and penalties are those of ``k`` weights; of two classes the difference itself, as Spark has it."""
    if k == 2:
        return np.array([[-0.5, 0.5]])
    i = np.arange(1, k)[:, None]
    return np.where(np.arange(k) < i, 1.0, np.where(np.arange(k) == i, -i, 0)) / np.sqrt(i * (i + 1))


def _chances(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the classes by row, and their logarithms, from scores by direction."""
    logs = contrasts(len(scores) + 1).T @ scores
    logs -= logs.max(0)
    logs -= np.log(np.exp(logs).sum(0))
    return np.exp(logs), logs


def _add(x: np.ndarray, times: float, y: np.ndarray) -> None:
    for a in range(0, len(x), SLICE):  # no second array of that size
        x[a : a + SLICE] += times * y[a : a + SLICE]


def _minimum(value: Callable, x: np.ndarray, iterations: int) -> np.ndarray:
    """Where ``value``, a function's value and gradient, is least: L-BFGS with steps that meet the strong Wolfe conditions."""

    def step(f0: float, slope: float, t: float, d: np.ndarray):
        low, high = (0.0, f0, slope, None), None
        for i in range(20):
            if high is not None:  # the cubic's minimum between the two, not too near either
                left, right = sorted((low, high), key=lambda p: p[0])
                span = right[0] - left[0]
                a = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0])
                b = np.sqrt(max(a * a - left[2] * right[2], 0.0))
                over = right[2] - left[2] + 2 * b
                t = right[0] - span * (right[2] + b - a) / over if over else left[0] + span / 2
                t = min(max(t, left[0] + 0.1 * span), left[0] + 0.9 * span)
            f, g = value(x + t * d)
            now = (t, f, float(g @ d), g)
            if not np.isfinite(f):
                t /= 2
            elif f > f0 + 1e-4 * t * slope or (f >= low[1] and (i > 0 or high is not None)):
                high = now
            elif abs(now[2]) <= 0.9 * abs(slope):
                return now
            else:
                if now[2] * ((high[0] if high else np.inf) - low[0]) >= 0:
                    high = low
                low, t = now, t * 1.5
        return low if low[3] is not None else None

    f, g = value(x)
    past, values, first = [], [f], abs(f)
    for i in range(iterations):
        if np.linalg.norm(g) <= max(TOLERANCE * abs(f), 1e-8):
            break
        d, used = -g, []
        for s, y, r in reversed(past):
            used.append(r * (s @ d))
            _add(d, -used[-1], y)
        if past:
            s, y, r = past[-1]
            d *= (s @ y) / (y @ y)
        for s, y, r in past:
            _add(d, used.pop() - r * (y @ d), s)
        found = step(f, float(g @ d), 1.0 if i else 1 / np.linalg.norm(d), d)
        if found is None:
            break
        s, y = found[0] * d, found[3] - g
        x, f, g = x + s, found[1], found[3]
        if s @ y > 0:
            past = [*past, (s, y, 1 / (s @ y))][-HISTORY:]
        values = [*values, f][-20:]
        if abs(f - max(values)) <= TOLERANCE * first:
            break
    return x


def fit(rows: DataFrame, counts: dict[str, int], iterations: int, features: int, grams: int = GRAMS) -> tuple:
    """Weights by direction of ``contrasts`` and column, a number for each direction and the columns' rarity, learnt from rows
    (label, hashes).

    Rows are unit vectors of counts times rarity, columns are brought to one deviation and classes weighted to be equal. Each
    step of the search reads the blocks once; the driver holds weights and gradients alone.
    """
    spark, names, n = rows.sparkSession, sorted(counts), sum(counts.values())
    weight = np.array([n / (len(names) * counts[name]) for name in names])
    turn, k = contrasts(len(names)), len(names) - 1

    def documents(y, pieces, total):
        for _, _, cols, sizes in pieces:
            total[cols] += sizes

    def moments(y, pieces, total):
        unit, w = _units(len(y), pieces, rarity.value, weight[:0])[0], weight[y]
        for cols, _, starts, at, z in _entries(pieces, rarity.value):
            z *= unit[at]
            total[cols] += np.add.reduceat(w[at] * z, starts)
            total[features + cols] += np.add.reduceat(w[at] * z * z, starts)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        beta, bias = x[: k * features].reshape(k, features), x[k * features :]
        sent = spark.sparkContext.broadcast((beta * inverse, bias - beta @ (mean * inverse)))

        def slope(y, pieces, total):
            weights, bias = sent.value
            unit, scores = _units(len(y), pieces, rarity.value, weights)
            p, logs = _chances(scores + bias[:, None])
            w, row = weight[y] / n, np.arange(len(y))
            total[-1] -= w @ logs[y, row]
            p[y, row] -= 1
            p = turn @ (p * w)
            total[k * features : -1] += p.sum(1)
            p *= unit
            for cols, _, starts, at, z in _entries(pieces, rarity.value):
                for c in range(k):
                    total[c * features + cols] += np.add.reduceat(p[c][at] * z, starts)

        sums = _summed(table, slope, k * features + k + 1)
        sent.destroy()
        turned = sums[k * features : -1]
        g = sums[: k * features].reshape(k, features)
        for i in range(k):
            g[i] = g[i] * inverse - turned[i] * mean * inverse + REGULAR * beta[i]
        return float(sums[-1] + REGULAR / 2 * (x[: k * features] @ x[: k * features])), sums[:-1]

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, min(int(before), BATCH))
    kept = blocks(rows, names, features, grams).persist()
    try:
        kept.count()
        spark.conf.set(setting, ONE)
        table = kept.coalesce(2 * spark.sparkContext.defaultParallelism)  # each partition makes a whole array of sums
        idf = np.log((n + 1) / (_summed(table, documents, features) + 1))
        rarity = spark.sparkContext.broadcast(idf)
        sums = _summed(table, moments, 2 * features)
        mean = sums[:features] / n
        squares = sum(w * w * counts[name] for w, name in zip(weight, names, strict=True))
        spread = np.maximum(sums[features:] - n * mean**2, 0) / max(n - squares / n, 1e-300)  # weights of rows, not their number
        inverse = np.divide(1, np.sqrt(spread), out=np.zeros(features), where=spread > 0)
        x = _minimum(value, np.zeros(k * features + k), iterations)  # classes weigh the same, so all begin at nought
        rarity.destroy()
    finally:
        kept.unpersist()
        spark.conf.set(setting, before)
    beta = x[: k * features].reshape(k, features)
    return beta * inverse, x[k * features :] - beta @ (mean * inverse), idf


def chances(df: DataFrame, hashes: Column, fitted: tuple) -> Column:
    """Probabilities of the classes of rows of hashes, as an array, by what ``fit`` returned."""
    sent, features = df.sparkSession.sparkContext.broadcast(fitted), len(fitted[2])

    @F.arrow_udf("array<double>")
    def each(lists: pa.Array) -> pa.Array:
        weights, bias, idf = sent.value
        found = []
        for a, b in _ranges(lists, GRAMS):
            part = lists.slice(a, b - a)
            pieces = _block(part.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(part).to_numpy(zero_copy_only=False), features)
            found.append(_chances(_units(b - a, pieces, idf, weights)[1] + bias[:, None])[0].T)
        flat = np.concatenate(found) if found else np.zeros((0, len(bias) + 1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * (len(bias) + 1)), pa.array(flat.ravel()))

    return each(hashes)
