"""Repeated passages by suffix sorting with difference covers, spread over tasks by content.

1. Anchors: of every window of ``length`` bytes, the first place whose ``GRAM`` bytes hash lowest. Equal windows have
   equal anchors at equal places, so a window can only repeat where its anchor's hash does. Anchors are counted over
   the corpus; a window whose anchor occurs once is settled.
2. The windows of each repeated anchor are cut out as one segment (first window to end of last). Equal segments are
   one, with a count. Segments go to tasks by their anchor's hash: all suffixes that could share ``length`` bytes meet.
   A window holds half of the bytes that it has beyond its anchor on one side of it, so where an anchor's segments are
   more than ``HOT`` bytes, their windows are halved by that side, and anchors grow by these bytes. What they are then is
   counted again: those that occur once are settled, those still hot are halved again, to whole windows at last. So no
   group is larger than ``HOT``.
3. A task builds the suffix array of its segments by difference cover: suffixes at places 1 and 2 modulo 3 are the
   sample; their triples are sorted and named, and where names repeat, the string of names is sorted the same way. The
   remaining suffixes sort by their own character and the name of the suffix after it, and are merged with the sample.
   Then neighbours among the suffixes that begin a window are compared: where their first ``length`` bytes are equal, the
   windows are repeated.
Of a periodic stretch only its first windows are sorted: the others repeat them.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, releasing, shuffle_partitions
from .ngram_join import _grouped, _parts
from .wordhash import mixed, powers, running

#: Bytes of an anchor, bytes that a task sorts at a time, bytes of a group beyond which it is split, bytes of a text read at
#: a time, rows up to which a table is broadcast.
GRAM, BATCH, HOT, SLICE, SMALL = 64, 1 << 19, 1 << 18, 1 << 22, 3_000_000


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    sums, (_, back) = running(data), powers(len(data) + 1)
    h = mixed((sums[GRAM:] - sums[:-GRAM]) * back[: len(data) - GRAM + 1])
    # 40 bits of the hash over 24 of the place: least values fall on the first of equal hashes.
    h = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span = length - GRAM + 1
    grid = np.full((-(-len(h) // span), span), 2**64 - 1, np.uint64)
    grid.ravel()[: len(h)] = h
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    left = np.minimum.accumulate(grid, axis=1).ravel()
    windows = len(data) - length + 1
    place = (np.minimum(right[:windows], left[span - 1 : span - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    place = place[first]
    value = mixed((sums[place + GRAM] - sums[place]) * back[place] + np.uint64(1))
    return value.view(np.int64), place, first, np.concatenate([first[1:], [windows]]) - 1


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``length`` bytes with one anchor: its hash and place, first window, last window."""
    found = [np.zeros((4, 0), np.int64)]
    for low in range(0, len(data) - length + 1, SLICE):
        value, *places = _anchors(data[low : low + SLICE + length - 1], length)
        found.append(np.stack([value, *[p + low for p in places]]))
    return tuple(np.concatenate(found, axis=1))


def collapsed(data: np.ndarray, length: int, value, place, first, last) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of ``anchors`` to sort, and stretches (starts and ends) of windows that are repeated as they lie.

    Runs with one anchor hash at equal steps come from periodic text. If the bytes do have that period, the windows of
    the second and third run are those of all that follow but the last: these are settled.
    """
    keep, settled = np.ones(len(value), bool), []
    step = np.diff(place)
    more = (value[1:] == value[:-1]) & (step > 0)
    more[1:] &= more[:-1] & (step[1:] == step[:-1]) | ~more[:-1]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], more, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= 4:
            d, low, high = int(step[a]), int(first[a + 1]), int(last[b - 1]) + length
            if (step[a:b] == d).all() and (data[low + d : high] == data[low : high - d]).all():
                keep[a + 3 : b] = False
                settled.append((int(first[a + 3]), high))
    return keep, np.array(settled, np.int64).reshape(-1, 2)


def _data(text: str | None) -> tuple[bytes, np.ndarray]:
    b = (text or "").encode("utf-8", "replace")
    return b, np.frombuffer(b, np.uint8)


def _key(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


def _values(length: int):
    def read(batches):
        for part in _parts(batches):
            data = [_data(t) for t in part["text"].to_pylist()]
            found = [anchors(a, length) for _, a in data]
            found = [f[0][collapsed(a, length, *f)[0]] for (_, a), f in zip(data, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([_key(b) for b, _ in data], pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "class", "anchors"],
            )

    return read


def _segments(length: int):
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def cut(batches):
        seen: set[bytes] = set()
        for part in _parts(batches):
            rows = []
            for want, text, values in zip(part["of"].to_pylist(), part["text"].to_pylist(), part["repeated"].to_pylist(), strict=True):
                b, a = _data(text)
                if _key(b) != want:
                    continue
                value, place, first, last = anchors(a, length)
                keep, settled = collapsed(a, length, value, place, first, last)
                rows += [(want, None, None, low, None, high - low, None) for low, high in settled.tolist()]
                for k in np.flatnonzero(keep & np.isin(value, np.array(values, np.int64))).tolist():
                    low, high = int(first[k]), int(last[k]) + length
                    segment, at = b[low:high], int(place[k]) - low
                    same = hashlib.blake2b(segment, digest_size=16, salt=at.to_bytes(4, "little")).digest()
                    rows.append((want, int(value[k]), same, low, at, high - low, None if same in seen else segment))
                    seen.add(same)
                if len(seen) > 100_000:
                    seen.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["of", "anchor", "same", "low", "place", "size", "bytes"])

    return cut


def _named(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of ``columns`` (non-negative integers, the first weighing most), and each row's name: its rank
    among the different rows, from 1."""
    bits = [max(1, int(c.max()).bit_length()) for c in columns]
    if sum(bits) <= 63:
        key = columns[0].astype(np.int64)
        for c, n in zip(columns[1:], bits[1:], strict=True):
            key = key << n | c
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order) - 1, bool)
        for c in columns:
            c = c[order]
            new |= c[1:] != c[:-1]
    name = np.empty(len(order), np.int64)
    name[order] = np.concatenate([[1], 1 + np.cumsum(new)])
    return order, name


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of ``s`` (integers above 0) in their order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    wide = np.zeros(n + 4, np.int64)
    wide[:n] = s
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    order, name = _named([wide[sample], wide[sample + 1], wide[sample + 2]])
    if name[order[-1]] < len(sample):  # names repeat: their string's suffixes are those of the sample
        order = suffix_array(name)
        name[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name
    sample = sample[order]
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    rest = rest[_named([wide[rest], rank[rest + 1]])[0]]
    # A remaining suffix comes after all suffixes of either part of the sample that are less: character and name decide.
    base = np.int64(len(name) + 2)
    first = wide[rest] * base + rank[rest + 1]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    less = np.searchsorted(wide[one] * base + rank[one + 1], first)
    top = np.int64(wide.max() + 1)
    if int(top) ** 2 * int(base) < 2**63:
        less += np.searchsorted((wide[two] * top + wide[two + 1]) * base + rank[two + 2], (wide[rest] * top + wide[rest + 1]) * base + rank[rest + 2])
    else:
        _, both = _named([np.concatenate([wide[two], wide[rest]]), np.concatenate([wide[two + 1], wide[rest + 1]]), np.concatenate([rank[two + 2], rank[rest + 2]])])
        less += np.searchsorted(both[: len(two)], both[len(two) :])
    out = np.empty(n, np.int64)
    at = less + np.arange(len(rest))
    out[at] = rest
    taken = np.zeros(n, bool)
    taken[at] = True
    out[~taken] = sample
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows of ``length`` bytes at ``starts`` equal another one of ``starts``: a boolean for each."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.full(len(data), -1, np.int64)
    at[starts] = np.arange(len(starts))
    order = at[suffix_array(data.astype(np.int64) + 1)]
    order = order[order >= 0]
    sorted_starts = np.asarray(starts, np.int64)[order]
    # Eight bytes at a time, of those neighbours that were equal so far.
    same, pair = np.zeros(len(order) + 1, bool), np.arange(1, len(order))
    word = np.zeros(len(data), np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | wide[k : k + len(data)]
    for k in [*range(0, length - 8, 8), length - 8]:
        pair = pair[word[sorted_starts[pair] + k] == word[sorted_starts[pair - 1] + k]]
    same[pair] = True
    out = np.zeros(len(starts), bool)
    out[order] = same[:-1] | same[1:]
    return out


def _sort(length: int):
    def sort(batches):
        for t in _grouped(batches, ["anchor"]):
            group, size, many = (t[c].to_numpy() for c in ("anchor", "size", "many"))
            held = t["bytes"].to_pylist()
            edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            low, total, rows = 0, np.concatenate([[0], np.cumsum(size)]), []
            while low < len(group):
                # Whole groups of about BATCH bytes, one group at least; one has HOT bytes at most.
                k = np.searchsorted(edges, low, "right")
                high = max(edges[k], edges[np.searchsorted(total[edges], total[low] + BATCH, "right") - 1])
                offsets, chunks = total[low:high] - total[low], held[low:high]
                windows = size[low:high] - length + 1
                which = np.repeat(np.arange(high - low), windows)
                within = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
                starts = offsets[which] + within
                hit = repeated_windows(np.frombuffer(b"".join(chunks), np.uint8), starts, length) | (many[low:high] > 1)[which]
                edge = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (which[1:] != which[:-1])]))
                stop = np.flatnonzero(hit & np.concatenate([~hit[1:] | (which[1:] != which[:-1]), [True]]))
                spans: list[list[int]] = [[] for _ in range(high - low)]
                for i, a, z in zip(which[edge].tolist(), within[edge].tolist(), within[stop].tolist(), strict=True):
                    spans[i] += [a, z + length]
                rows += spans
                low = high
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.int64()), pa.array(t["same"].to_pylist(), pa.binary()), pa.array(rows, pa.list_(pa.int32()))],
                ["anchor", "same", "spans"],
            )

    return sort


def _halves(length: int):
    names = ["anchor", "same", "many", "shift", "place", "core", "node", "size", "bytes", "key", "own"]
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 2, *[pa.int32()] * 4, pa.binary(), pa.int64(), pa.binary()]

    def halve(batches):
        for part in _parts(batches):
            rows = []
            for anchor, same, many, shift, place, core, node, size, held in zip(*[part[c].to_pylist() for c in names[:9]], strict=True):
                beyond = length - core
                left = (beyond + 1) // 2
                right = beyond - left + 1
                # A window from place - left or before holds the core and `left` bytes before it, any other `right` after it.
                cuts = ((0, min(size - length, place - left), place - left, core + left), (max(0, place - left + 1), size - length, place, core + right))
                for side, (first, last, low, wide) in enumerate(cuts):
                    if beyond and first <= last:
                        b, at, mark = held[first : last + length], low - first, 2 * node + side
                        key = hashlib.blake2b(b[at : at + wide], digest_size=8, salt=mark.to_bytes(4, "little")).digest()
                        own = hashlib.blake2b(b, digest_size=16, salt=at.to_bytes(4, "little")).digest()
                        rows.append((anchor, same, many, shift + first, at, wide, mark, len(b), b, int.from_bytes(key, "little", signed=True), own))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return halve


def _sorted(rows: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows (anchor, same, spans) of segments (anchor, same, many, place, size, bytes)."""
    segments = rows.groupBy("anchor", "same").agg(F.sum("many").alias("many"), F.max("place").alias("place"), F.max("size").alias("size"), F.max("bytes").alias("bytes"))
    ordered = segments.repartition(shuffle_partitions(rows.sparkSession), "anchor").sortWithinPartitions("anchor", "same")
    return ordered.select("anchor", "same", "many", "place", "size", "bytes").mapInArrow(releasing(_sort(length)), "anchor long, same binary, spans array<int>").where(F.size("spans") > 0)


def _sides(keys: DataFrame) -> DataFrame:
    """A table of keys, to be broadcast where it is small."""
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def _volumes(rows: DataFrame, key: str, own: str) -> DataFrame:
    """For each ``key``: occurrences ``n`` of its segments, and bytes ``volume`` of the distinct ones."""
    each = rows.groupBy(key, own).agg(F.sum("many").alias("many"), F.max("size").alias("size"))
    return each.groupBy(key).agg(F.sum("many").alias("n"), F.sum("size").alias("volume"))


def _hot_spans(rows: DataFrame, length: int) -> DataFrame:
    """Like ``_sorted``, where segments of one anchor can be any number: they are halved until no group is hot."""
    now = rows.groupBy("anchor", "same").agg(F.sum("many").alias("many"), F.max("place").alias("place"), F.max("size").alias("size"), F.max("bytes").alias("bytes"))
    now = now.withColumn("shift", F.lit(0).cast("long")).withColumn("core", F.lit(GRAM)).withColumn("node", F.lit(1))
    columns = ["anchor", "same", "many", "shift", "place", "core", "node", "size", "bytes"]
    settled = []
    while True:
        parts = materialize(now.select(*columns).mapInArrow(releasing(_halves(length)), "anchor long, same binary, many long, shift long, place int, core int, node int, size int, bytes binary, key long, own binary"))
        keys = materialize(_volumes(parts, "key", "own").where("n > 1").select("key", (F.col("volume") > max(HOT, length)).alias("hot")))
        settled.append(parts.join(_sides(keys.where("NOT hot")), "key"))
        hot = keys.where("hot")
        if not hot.limit(1).count():
            break
        now = parts.join(_sides(hot), "key")
    left = reduce(DataFrame.unionByName, settled)
    spans = _sorted(left.select(F.col("key").alias("anchor"), F.col("own").alias("same"), "many", "place", "size", "bytes"), length)
    spans = spans.select(F.col("anchor").alias("key"), F.col("same").alias("own"), "spans")
    found = left.select("anchor", "same", "shift", "key", "own").join(spans, ["key", "own"])
    found = found.select("anchor", "same", F.transform("spans", lambda x: (x + F.col("shift")).cast("int")).alias("spans"))
    return found.groupBy("anchor", "same").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _merged(flat: list[int] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(zip(flat[::2], flat[1::2], strict=True)) if flat else ():
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _joined(batches):
    for batch in batches:
        spans = [None if s is None else [x for span in _merged(s) for x in span] for s in batch["spans"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["of"], batch["copies"], pa.array(spans, pa.list_(pa.int32()))], ["of", "copies", "spans"])


def _kept(length: int, keep: list[str]):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]

    def cut(batches):
        for part in _parts(batches):
            rows = []
            for text, copies, flat in zip(*[part[c].to_pylist() for c in ("text", "copies", "spans")], strict=True):
                b = (text or "").encode("utf-8", "replace")
                spans = _merged(flat)
                if (copies or 1) > 1 and len(b) >= length:
                    spans = [(0, len(b))]
                left, at = [], 0
                for low, high in [*spans, (len(b), len(b))]:
                    left.append(b[at:low])
                    at = high
                kept = b"".join(left)
                rows.append((len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [x for s in spans for x in s], None if text is None else kept.decode("utf-8", "ignore")))
            found = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[part[c] for c in keep], *found], [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return cut


def repeated_spans(docs: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts of documents (doc_id, text) and their spans of repeated windows of ``length`` bytes.

    Returns a table (class, copies, id) of texts that have a window, and a table (of, spans): for each such class
    with a repeated window, a flat list of starts and ends (bytes), not merged.
    """
    if length < GRAM + 16:
        raise ValueError(f"length has to be {GRAM + 16} or more")
    docs = docs.select("doc_id", "text")
    read = materialize(docs.mapInArrow(releasing(_values(length)), "doc_id long, class binary, anchors array<long>"))
    classes = read.where(F.size("anchors") > 0).groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("id"), F.first("anchors").alias("anchors"))
    classes = materialize(classes)
    found = classes.select(F.col("class").alias("of"), "id", F.explode("anchors").alias("anchor"))
    # A table of its own: what is joined with it has an exchange of its own, which Spark can split at hot anchors.
    repeated = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    wanted = materialize(found.join(repeated, "anchor").groupBy("of", "id").agg(F.collect_set("anchor").alias("repeated")))
    few = wanted.agg(F.coalesce(F.sum(F.size("repeated")), F.lit(0))).first()[0] <= SMALL
    # One document of each class is cut; where its row is repeated, its class goes whole anyway.
    cut = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("id")).select("of", "text", "repeated")
    if wanted.where("id IS NULL").limit(1).count():  # rows without an id are found by the digest of their text
        keyed = docs.where("doc_id IS NULL").mapInArrow(releasing(_keyed), "doc_id long, text string, _class binary")
        cut = cut.unionByName(keyed.join(wanted.where("id IS NULL"), F.col("_class") == F.col("of")).select("of", "text", "repeated"))
    cut = materialize(cut.mapInArrow(releasing(_segments(length)), "of binary, anchor long, same binary, low long, place int, size int, bytes binary"))
    rows = cut.where("anchor IS NOT NULL").withColumn("many", F.lit(1).cast("long"))
    hot = materialize(_volumes(rows, "anchor", "same").where(F.col("volume") > max(HOT, length)).select("anchor"))
    if hot.limit(1).count():
        side = _sides(hot)
        spans = materialize(_sorted(rows.join(side, "anchor", "left_anti"), length).unionByName(_hot_spans(rows.join(side, "anchor", "left_semi"), length)))
    else:
        spans = _sorted(rows, length)
    hits = cut.select("of", "anchor", "same", "low").join(spans, ["anchor", "same"])
    hits = hits.select("of", F.transform("spans", lambda x: (x + F.col("low")).cast("int")).alias("spans"))
    hits = hits.unionByName(cut.where("anchor IS NULL").select("of", F.array(F.col("low").cast("int"), (F.col("low") + F.col("size")).cast("int")).alias("spans")))
    return classes, hits.groupBy("of").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove each byte of documents (doc_id, text) that a repeated window of ``length`` bytes covers.

    A window is repeated if its bytes also start anywhere else, in another document or its own; they are judged on
    the input and do not cross documents. A null text is empty here (its ``kept`` stays null). Texts below ``length``
    bytes stay. Repeated rows remove each other; rows without a doc_id are judged like all others. Whole texts of any length are read. Other columns are
    ignored, but for those of ``keep``. Returns doc_id, what ``keep`` names, n_bytes, n_removed, n_spans (all long), kept_sha256, spans array<long> (merged, flat starts and
    ends in bytes) and kept (the remaining text; a character that a cut splits is dropped from it).
    """
    classes, spans = repeated_spans(docs, length)
    marks = classes.where("copies > 1").select(F.col("class").alias("of"), "copies").join(spans, "of", "full")
    marks = marks.select("of", F.coalesce("copies", F.lit(1)).alias("copies"), F.when(F.coalesce("copies", F.lit(1)) == 1, F.col("spans")).alias("spans"))
    marks = materialize(marks.mapInArrow(releasing(_joined), "of binary, copies long, spans array<int>"))
    few = marks.agg(F.coalesce(F.sum(F.coalesce(F.size("spans"), F.lit(0)) + 4), F.lit(0))).first()[0] <= SMALL
    rows = docs.select("doc_id", *keep, "text")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]
    keyed = rows.mapInArrow(releasing(_keyed), ", ".join([*kinds, "_class binary"]))
    joined = keyed.join(F.broadcast(marks) if few else marks, F.col("_class") == F.col("of"), "left")
    kinds[-1] = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept string"
    return joined.mapInArrow(releasing(_kept(length, rows.columns[:-1])), ", ".join(kinds))


def _keyed(batches):
    for part in _parts(batches):
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_key(_data(t)[0]) for t in part["text"].to_pylist()], pa.binary())], [*part.schema.names, "_class"])
