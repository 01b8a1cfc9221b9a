"""Periodic runs of words: minimizers of several scales seed them, direct lag scans find those of short period.

A scale has the periods from P to 2P - 1. Its windows span P/2 words and its grams P/4. Of a run of period q, a window in
the first q words and the one q words on hold the same words, so the least gram of either (leftmost of equal ones) lies at
the same place in it: two equal minimizers q apart, which the words around them extend to the run. Grams that occur once
in their text can't be in a run and are no minimizers; where they cut a window, there is none.

Equal minimizers at most half a gram apart form a cluster: the text over it has the gram's own short period, so two of
one cluster are no seed of a longer one (by Fine and Wilf's theorem). Seeds of two clusters lie a whole number of these
short periods apart, so they are as many as the clusters' minimizers together, not as their pairs; and of clusters of
one gram, some sixteen at most begin within a scale's reach. So the work is n log n for a text of any kind.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Periods below this are scanned lag by lag; a run has this many words at least; words of texts that are scanned together.
SHORT, LEAST, TOGETHER = 16, 12, 1 << 18
_PRIMES, _BASES = (2147483647, 2147483629), (1103515245, 1566083941)
_powers: list[list[np.ndarray]] = [[np.ones(1, np.int64)] * 2, [np.ones(1, np.int64)] * 2]


def _power(n: int) -> None:
    """Make the bases' powers below ``n`` and their inverses modulo the primes known."""
    if len(_powers[0][0]) < n:
        size = 1 << n.bit_length()
        for k, (p, b) in enumerate(zip(_PRIMES, _BASES, strict=True)):
            for way, step in enumerate((b, pow(b, -1, p))):
                out = np.ones(1, np.int64)
                while len(out) < size:
                    out = np.concatenate([out, out * pow(step, len(out), p) % p])
                _powers[way][k] = out


class Grams:
    """Hashes of stretches of ``x`` from sums of its prefixes, modulo two primes of 31 bits."""

    def __init__(self, x: np.ndarray):
        _power(len(x) + 1)
        self.sums = []
        for k, p in enumerate(_PRIMES):
            value = (x * 0x9E3779B1 + 0x7F4A7C15 * (k + 1)) % p
            self.sums.append(np.concatenate([[0], np.cumsum(value * _powers[0][k][: len(x)] % p)]))

    def __call__(self, at: np.ndarray, n: int) -> np.ndarray:
        a, b = ((s[at + n] - s[at]) % p * _powers[1][k][at] % p for k, (s, p) in enumerate(zip(self.sums, _PRIMES, strict=True)))
        return a << 31 | b


def _scattered(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def _stretches(x: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all maximal stretches of period ``q`` and of ``least`` words or more."""
    at = np.flatnonzero(x[:-q] == x[q:]) if q < len(x) else np.zeros(0, np.int64)
    if not len(at):
        return at, at
    turn = np.flatnonzero(np.diff(at) > 1) + 1
    low, high = at[np.concatenate([[0], turn])], at[np.concatenate([turn - 1, [len(at) - 1]])] + 1 + q
    long = high - low >= least
    return low[long], high[long]


def _repeated(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places whose hash occurs again, in order."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return at[again]


def _minimizers(at: np.ndarray, h: np.ndarray, w: int) -> np.ndarray:
    """Indexes into ``at`` of the least hash of each ``w`` places in a row, the leftmost of equal ones; w - 1 is a power of two."""
    if len(at) < w:
        return np.zeros(0, np.int64)
    value = _scattered(h)

    def lesser(a: np.ndarray, by: int) -> np.ndarray:
        left, right = a[:-by], a[by:]
        return np.where(value[left] <= value[right], left, right)

    best, size = np.arange(len(at)), 1
    while size < w - 1:
        best, size = lesser(best, size), 2 * size
    best = lesser(best, 1)
    return np.unique(best[at[w - 1 :] - at[: len(at) - w + 1] == w - 1])


def _seeds(at: np.ndarray, h: np.ndarray, gram: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods from ``low`` to below ``high`` at which equal minimizers of two clusters lie apart."""
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    gap = np.diff(at)
    new_group = np.concatenate([[True], h[1:] != h[:-1]])
    new_cluster = new_group | np.concatenate([[True], gap > gram // 2])
    start = np.flatnonzero(new_cluster)
    first, last = at[start], at[np.concatenate([start[1:] - 1, [len(at) - 1]])]
    group = np.cumsum(new_group)[start] - 1
    inner = np.where(new_cluster, 0, np.concatenate([[0], gap]))
    step = np.gcd.reduceat(inner, np.flatnonzero(new_group))
    places, periods = [], []
    for off in range(1, len(first)):
        a = np.flatnonzero((group[off:] == group[:-off]) & (first[off:] - last[:-off] < high))
        if not len(a):
            break
        b, g = a + off, np.maximum(step[group[a]], 1)
        base, most = first[b] - last[a], np.minimum(last[b] - first[a], high - 1)
        least = base + -(-np.maximum(low - base, 0) // g) * g
        many = np.maximum((most - least) // g + 1, 0)
        pick = np.repeat(np.arange(len(a)), many)
        q = least[pick] + (np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many)) * g[pick]
        places.append(np.maximum(first[a][pick], first[b][pick] - q))
        periods.append(q)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *periods])


def _extended(grams: Grams, n: int, top: int, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of period ``q`` around ``at``, by steps of falling powers of two up to ``top``."""
    low, high = at.copy(), at.copy()
    size = top
    while size:
        to = np.flatnonzero(high + q + size <= n)
        to = to[grams(high[to], size) == grams(high[to] + q[to], size)]
        high[to] += size
        to = np.flatnonzero(low >= size)
        to = to[grams(low[to] - size, size) == grams(low[to] - size + q[to], size)]
        low[to] -= size
        size //= 2
    return low, high + q


def find_runs(x: np.ndarray, longest: int | None = None) -> np.ndarray:
    """All runs of ``x`` (integers): rows of start, end, smallest period, by start, then period.

    A run is a stretch whose smallest period is q, of max(12, 2 q) words or more, which no neighbour extends with period q.
    ``longest``: the words of the longest text, where ``x`` is several texts that share no integer. Each run that hashes
    give is compared word by word; a lag at which they erred is scanned.
    """
    n = len(x)
    longest, found = longest or n, []
    for q in range(1, min(SHORT, longest // 2 + 1)):
        found.append((*_stretches(x, q, max(LEAST, 2 * q)), q))
    low = SHORT
    if 2 * low <= longest:
        grams, at, gram = Grams(x), np.arange(n), 1
        top, wrong = 1 << longest.bit_length() - 1, set()
    while 2 * low <= longest:
        while gram < low // 4:
            at, gram = at[at + 2 * gram <= n], 2 * gram
            at = _repeated(at, grams(at, gram))
        if not len(at):
            break
        h = grams(at, gram)
        m = _minimizers(at, h, low // 4 + 1)
        place, q = _seeds(at[m], h[m], gram, low, 2 * low) if len(m) else (m, m)
        start, end = _extended(grams, n, top, place, q)
        whole = end - start >= 2 * q
        some = np.unique(np.stack([start[whole], end[whole], q[whole]], axis=1), axis=0)
        for a, b, p in some.tolist():
            if (x[a : b - p] == x[a + p : b]).all():
                found.append((np.array([a]), np.array([b]), p))
            else:
                wrong.add(p)
        low *= 2
    if 2 * SHORT <= longest:
        found += [(*_stretches(x, q, 2 * q), q) for q in wrong]
    start, end = (np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in (0, 1))
    period = np.concatenate([np.zeros(0, np.int64), *[np.full(len(f[0]), f[2], np.int64) for f in found]])
    order = np.lexsort((period, end, start))  # of one stretch the smallest period
    out = np.stack([start, end, period], axis=1)[order]
    if len(out):
        out = out[np.concatenate([[True], (out[1:, :2] != out[:-1, :2]).any(axis=1)])]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def turned(n: int, doc_id: int | None) -> np.ndarray:
    """The places whose words a document has, by the checksum of its id: every tenth repeats its end with some period."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def _runs_of(texts: list[list[bytes]]):
    """The runs of each text, of which no word equals one of another, scanned together."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes, known = pd.factorize(np.array([w for t in texts for w in t] + [None], object)[:-1])
    ends = np.cumsum(sizes)
    x = np.repeat(np.arange(len(texts)), sizes) * max(1, len(known)) + codes
    runs = find_runs(x, int(sizes.max(initial=0)))
    of = np.searchsorted(ends, runs[:, 0], side="right")
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        yield runs[cuts[k] : cuts[k + 1]] - np.array([1, 1, 0]) * (ends[k] - sizes[k])


_KINDS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_FULL = f"{_KINDS}, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _detect(turn: bool, full: bool):
    def row(doc, words: list[bytes], runs: np.ndarray) -> tuple:
        start, length, period = runs[:, 0], runs[:, 1] - runs[:, 0], runs[:, 2]
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, runs[:, 1], -1)
        kept = words if not len(runs) else [w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if not d]
        said, text = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)), b" ".join(kept)
        best = [None] * 4
        if len(runs):
            k = np.lexsort((period, start, -length))[0]
            best = [int(start[k]), int(length[k]), int(period[k]), 1000 * int(length[k]) // int(period[k])]
        out = doc, len(words), len(runs), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text).hexdigest()
        return (*out, [{"start": a, "length": b, "period": c} for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)], text.decode()) if full else out

    schema = pa.schema([(k, pa.string() if v == "string" else pa.int64()) for k, v in (c.split() for c in _KINDS.split(", "))])
    if full:
        schema = schema.append(pa.field("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))).append(pa.field("collapsed", pa.string()))

    def flush(ids: list, texts: list[list[bytes]]):
        rows = [row(d, t, r) for d, t, r in zip(ids, texts, _runs_of(texts), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def detect(batches):
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = (text.as_py() or "").encode().split()  # bytes split at blank, tab, LF, VT, FF, CR alone
                if turn:
                    words = [words[i] for i in turned(len(words), doc).tolist()]
                ids.append(doc)
                texts.append(words)
                held += len(words)
                if held > TOGETHER:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield flush(ids, texts)

    return detect


def detect_runs(docs: DataFrame, turn: bool = False, full: bool = True) -> DataFrame:
    """The periodic runs of the words of each document (doc_id long, text), and its text without their repeats.

    Words are maximal runs of other bytes than blank, tab, LF, VT, FF, CR; see ``find_runs`` for what a run is. ``collapsed``
    leaves out each word that a run contains after that run's first period; its words are joined by one blank. ``start``,
    ``length`` (both in words), ``period`` and ``exponent_milli`` (1000 length / period) are of the longest run, of equal ones
    the first, then that of smaller period. With ``turn`` the words are first those of ``turned``. Without ``full``
    the lists of runs and the collapsed texts are left out, their digests stay.
    Each document is judged alone, in one pass without a shuffle: texts of a task are scanned about ``TOGETHER`` words at
    a time, a longer one by itself, in memory of its own size. A null, empty or blank text has no words and no runs (four
    nulls, digests of nothing); a null doc_id is kept and its words are not turned; repeated rows have equal results;
    an empty table gives no rows. Other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_detect(turn, full), _FULL if full else _KINDS)
