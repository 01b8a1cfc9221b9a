"""Packing by best fit and a local search that swaps documents between underfull bins until bins empty."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, releasing, shuffle_partitions
from .packing import best_fit_decreasing, encoder

WINDOW, END = 1024, 2
#: Pieces that one task packs together, about; pairs of a bin that are offered for one document; rounds over the bins.
BUCKET, PAIRS, ROUNDS = 16_384, 32, 12


def least_bins(lengths, window: int) -> int:
    """No packing has fewer bins: for each k, those of over window - k are alone, and what is from k on has to fit beside them."""
    counts = np.bincount(np.asarray(lengths, np.int64), minlength=window + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * np.arange(window + 1))
    half, best = window // 2, -(-int(volume[-1]) // window)
    for k in range(half + 1):
        alone, large = int(number[-1] - number[window - k]), int(number[window - k] - number[half])
        small = int(volume[half] - (volume[k - 1] if k else 0))
        best = max(best, alone + large + max(0, -(-(small - large * window + int(volume[window - k] - volume[half])) // window)))
    return best


class _Search:
    """Underfull bins and what each offers: every length of its documents, and the sums of two.

    ``singles`` and ``pairs`` are bit sets of the lengths and sums on offer; ``offers`` has for each a heap of bins by load, of
    which entries of an earlier state of their bin are skipped.
    """

    def __init__(self, bins: list[list[int]], window: int):
        self.bins, self.window = bins, window
        self.load = [sum(b) for b in bins]
        self.state = [0] * len(bins)
        self.offers: tuple[dict, dict] = ({}, {})
        self.many = ([0] * (window + 1), [0] * (window + 1))
        self.mask = [0, 0]
        self.listed: list[tuple | None] = [None] * len(bins)

    def bundles(self, b: int) -> tuple[list[int], list[int]]:
        one = sorted(set(self.bins[b]))
        twice = [n for n in one if self.bins[b].count(n) > 1]
        two = {2 * n for n in twice}
        for i, x in enumerate(one):
            if len(two) >= PAIRS:
                break
            two.update(x + y for y in one[i + 1 :])
        return one, [n for n in two if n <= self.window]

    def put(self, b: int) -> None:
        if 0 < self.load[b] < self.window:
            self.listed[b] = self.bundles(b)
            for kind, values in enumerate(self.listed[b]):
                for v in values:
                    heapq.heappush(self.offers[kind].setdefault(v, []), (self.load[b], b, self.state[b]))
                    self.many[kind][v] += 1
                    self.mask[kind] |= 1 << v

    def take(self, b: int) -> None:
        if self.listed[b]:
            for kind, values in enumerate(self.listed[b]):
                for v in values:
                    self.many[kind][v] -= 1
                    if not self.many[kind][v]:
                        self.mask[kind] ^= 1 << v
            self.listed[b] = None
            self.state[b] += 1

    def emptiest(self, kind: int, v: int) -> int:
        heap = self.offers[kind][v]
        while heap[0][2] != self.state[heap[0][1]] or not self.listed[heap[0][1]]:
            heapq.heappop(heap)
        return heap[0][1]

    def split(self, b: int, kind: int, v: int) -> list[int]:
        """The documents of bin ``b`` that are the bundle of ``v``."""
        if kind == 0:
            return [v]
        rest = self.bins[b]
        return next([x, v - x] for x in rest if v - x in rest and (v != 2 * x or rest.count(x) > 1))

    def better(self, b: int) -> bool:
        """Fill bin ``b``, which is not listed, by the exchange that leaves the least room; it has to raise the squared fill."""
        room, load, best = self.window - self.load[b], self.load[b], None
        one, two = self.bundles(b)
        for mine, values in ((-1, [0]), (0, one), (1, two)):
            for y in values:
                for kind in (0, 1) if mine == 0 else (0,):  # a move, one for one, two for one, one for two
                    below = self.mask[kind] & ((2 << min(self.window, y + room)) - 1)
                    x = below.bit_length() - 1
                    if x > y and (best is None or x - y > best[0]):
                        a = self.emptiest(kind, x)
                        if load + x - y > self.load[a]:  # (load + d)^2 + (a - d)^2 > load^2 + a^2
                            best = x - y, a, kind, x, mine, y
                if best and best[0] == room:
                    break
            if best and best[0] == room:
                break
        if not best:
            return False
        _, a, kind, x, mine, y = best
        come = self.split(a, kind, x)
        go = [] if mine < 0 else self.split(b, mine, y)
        self.take(a)
        for n in come:
            self.bins[a].remove(n)
        for n in go:
            self.bins[b].remove(n)
        self.bins[a] += go
        self.bins[b] += come
        self.load[a] += y - x
        self.load[b] += x - y
        self.put(a)
        return True


def swap_search(bins: list[list[int]], window: int, goal: int = 0, rounds: int = ROUNDS) -> list[list[int]]:
    """Exchange documents between bins (lists of lengths) as long as that raises the sum of squared loads; empty bins go.

    The fullest underfull bin comes first and gets, from the emptiest bin that has it, a document (move), one for one of
    its own, two for one, or one for two of its own: what fills it best. It ends when a round over all bins changes
    nothing, after ``rounds`` rounds, or at ``goal`` bins. No document is lost or cut; bins never become more.
    """
    s = _Search(bins, window)
    for b in range(len(bins)):
        s.put(b)
    left = sum(1 for n in s.load if n)
    for _ in range(rounds):
        changed = False
        for b in sorted((b for b in range(len(bins)) if 0 < s.load[b] < window), key=lambda b: -s.load[b]):
            if left <= goal:
                break
            if not 0 < s.load[b] < window:
                continue
            s.take(b)
            while s.load[b] < window and s.better(b):
                changed = True
            s.put(b)
        left = sum(1 for n in s.load if n)
        if not changed or left <= goal:
            break
    return [b for b in s.bins if b]


def pack_lengths(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Bins and offsets for ``lengths``, which descend: best fit, then ``swap_search`` where a lower bound allows fewer bins."""
    where, offsets = best_fit_decreasing(lengths, window)
    goal, used = least_bins(lengths, window), max(where, default=-1) + 1
    if used <= goal:
        return where, offsets
    bins: list[list[int]] = [[] for _ in range(used)]
    for n, b in zip(lengths, where, strict=True):
        bins[b].append(n)
    free: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        free.setdefault(lengths[i], []).append(i)
    for b, held in enumerate(swap_search(bins, window, goal)):
        at = 0
        for n in held:
            i = free[n].pop()
            where[i], offsets[i] = b, at
            at += n
    return where, offsets


def _pieces(tokenizer: str, window: int, end: int):
    def cut(batches):
        encode, k = encoder(tokenizer), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part, out = batch.slice(low, 64), []
                for doc, ids in zip(part["doc_id"].to_pylist(), encode([t or "" for t in part["text"].to_pylist()]), strict=True):
                    ids += end.to_bytes(4, "little")
                    n = len(ids) // 4
                    at = 0
                    for piece, upto in enumerate(range((n - 1) % window + 1, n + 1, window)):
                        out.append((doc, piece, at, upto - at, zlib.crc32(ids[4 * at : 4 * upto]), n, k))
                        at = upto
                    k += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "salt"])
        encode.forget()

    return cut


def _packed(window: int):
    def pack(batches):
        bucket, lengths, held = None, [], []

        def done():
            if held:
                bins, offsets = pack_lengths(lengths, window)
                whole = pa.Table.from_batches(held)
                yield from whole.append_column("bin", pa.array(bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).to_batches()

        for batch in batches:
            b = batch["bucket"].to_numpy()
            edges = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for low, high in zip(edges, edges[1:], strict=False):
                if low < high:
                    if b[low] != bucket:
                        yield from done()
                        bucket, lengths, held = b[low], [], []
                    held.append(batch.slice(low, high - low))
                    lengths += held[-1]["length"].to_pylist()
        yield from done()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pack all documents (doc_id long, text) into few sequences of at most ``window`` tokens by best fit and local search.

    A document is its text's ids by the file ``tokenizer`` of `tokenizers`, then ``end``; a null or empty text is ``end``
    alone. Only a longer one is cut: its first piece takes what the pieces of full length after it leave. Full pieces are
    sequences of their own; the rest are dealt by hash to buckets of about ``BUCKET`` pieces, so that no task sees all.
    A bucket is packed by best fit decreasing, then ``swap_search`` exchanges documents between underfull bins, unless
    a lower bound shows that no fewer bins will do. Equal lengths go by doc_id and start; repeated rows are documents of their
    own, and a row's place in its task deals them to different buckets. An empty table gives no rows; other columns are ignored.
    Returns doc_id, piece int, start, length, ids_crc32, doc_tokens, sequence_id, offset, all others long; the
    sequence_id of a full piece is negative, else its bucket times 2^40 plus a number in it.
    """
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(releasing(_pieces(tokenizer, window, end), keep=True), f"{kinds}, salt long"))
    names = [c.split()[0] for c in kinds.split(", ")]
    short = pieces.where(F.col("length") < window)
    buckets = max(1, short.count() // BUCKET)
    tasks = min(buckets, shuffle_partitions(docs.sparkSession))
    short = short.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(buckets)))
    dealt = short.repartitionById(tasks, F.pmod(F.col("bucket"), F.lit(tasks)).cast("int")).sortWithinPartitions("bucket", F.desc("length"), "doc_id", "start", "ids_crc32", "salt")
    packed = dealt.mapInArrow(releasing(_packed(window), keep=True), f"{kinds}, salt long, bucket long, bin long, offset long")
    packed = packed.select(*names, (F.col("bucket") * F.lit(2**40) + F.col("bin")).alias("sequence_id"), "offset")
    full = pieces.where(F.col("length") == window).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
