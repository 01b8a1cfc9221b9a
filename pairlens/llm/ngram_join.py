"""N-gram Jaccard self-join with prefixes and prefix trees.

1. A table of fixed size counts, over all documents, how many sets hold a shingle of each slot. Shingles are ordered
   by that count, then by hash: one global order for the whole corpus.
2. Texts of equal words are one class. A long set is cut by hash range into parts of bounded size: if two sets link, so
   do their parts in one range at least. Of a part only the rarest shingles are needed to find partners. Parts that
   share one, are of fitting size, and whose parity sketches differ by no more bits than linked parts differ in
   shingles, are candidates. No linked pair is lost here.
3. The sets of each group of candidates are joined by a trie: sorted by global order with frequent shingles first,
   sets share their beginnings; a traversal counts the overlap of shared beginnings once, and leaves out subtrees
   that sizes or the remaining lengths rule out, and those that are in the probe's component already.
A group too large for a task is joined in blocks first, then one representative of each component that was found is
joined with the others, until none are left to join; only then are the smaller components compared with all blocks. So
a group of copies costs little more than its sets, and none is capped or sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import connected_components, materialize, releasing, spanning
from .wordhash import shingles, words

#: Slots of the count table, bits of a part's sketch, rows of a block of candidates, shingles of a block of sets, and rows
#: up to which ids are broadcast; rounds in which a large group's rows are dealt to blocks.
SLOTS, BITS, BLOCK, VOLUME, SMALL, DEALS = 1 << 20, 1024, 4096, 200_000, 1_000_000, 3
_CHUNK = 1 << 14


def _words(text: str | None) -> np.ndarray:
    return words((text or "").encode("utf-8", "replace").lower())


def _class(w: np.ndarray) -> bytes:
    """The class of a text: a digest of its words in order."""
    return hashlib.blake2b(w.tobytes(), digest_size=16).digest()


def _parts(batches, rows: int = 512):
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _count(n: int):
    kinds = [pa.int64(), pa.binary(), pa.int32()]

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for part in _parts(batches):
            found = [_words(t) for t in part["text"].to_pylist()]
            sets = [shingles(w, n) for w in found]
            total += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            rows = [part["doc_id"], pa.array([_class(w) for w in found], pa.binary()), pa.array([len(s) for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary())], ["doc_id", "class", "n", "chunk", "counts"])
        chunks = total.reshape(-1, _CHUNK)
        held = [pa.array(range(len(chunks)), pa.int32()), pa.array([c.astype("<u4").tobytes() for c in chunks], pa.binary())]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(chunks), k) for k in kinds], *held], ["doc_id", "class", "n", "chunk", "counts"])

    return count


def _add(pdf):
    total = sum(np.frombuffer(c, "<u4").astype(np.int64) for c in pdf["counts"])
    return pdf.head(1).assign(counts=[np.minimum(total, 2**32 - 1).astype("<u4").tobytes()])


def counted(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """The class and set size of each document, and how many documents' sets have a shingle in each slot.

    The slots are ``SLOTS`` numbers, whatever the size of the corpus.
    """
    read = materialize(docs.mapInArrow(releasing(_count(n)), "doc_id long, class binary, n int, chunk int, counts binary"))
    sums = read.where("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInPandas(_add, "chunk int, counts binary")
    out = np.zeros(SLOTS, np.uint32)
    for r in sums.collect():
        out[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.counts, "<u4")
    return read.where("chunk IS NULL").select("doc_id", "class", "n"), out


def _ordered(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set in global order, the rarest first."""
    return s[np.argsort(counts[(s & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")]


def _levels(m: int, num: int, den: int) -> list[int]:
    """How often a set of ``m`` shingles is halved by hash range: so that sketches tell unlinked parts apart. Sets that
    link have one level in common, that of the smaller: one near the limit has two."""
    level = lambda n: max(0, int(np.ceil(np.log2(max(1, 5 * n * (den - num) / den / BITS)))))
    return list(range(level(-(-num * m // den)), level(m) + 1))


def _sketch(s: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each of BITS bits."""
    return np.packbits(np.bincount((s >> np.uint64(20) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def _prefixes(n: int, num: int, den: int, counts):
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def read(batches):
        table = counts.value
        for part in _parts(batches):
            rows = []
            for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                w = _words(text)
                s = shingles(w, n)  # ascending, so that a range of hashes is a slice
                same = _class(w)
                for level in _levels(len(s), num, den) if len(s) else ():
                    edges = np.searchsorted(s, np.arange(1, 1 << level, dtype=np.uint64) << np.uint64(64 - level)) if level else []
                    for k, sub in enumerate(np.split(s, edges)):
                        m = len(sub)
                        if m:
                            rows.append((doc, same, len(s), level, k, m, _sketch(sub), _ordered(sub, table)[: m - -(-num * m // den) + 1].view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "class", "n", "level", "part", "m", "sketch", "first"])

    return read


def _grouped(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of ``keys`` from batches that are sorted by them; small groups come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch[k].to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
            new[0] |= not held or held[-1][k][-1].as_py() != batch[k][0].as_py()
        edges = np.flatnonzero(new)
        if held and len(edges):
            yield pa.Table.from_batches([*held, batch.slice(0, edges[-1])]) if edges[-1] else pa.Table.from_batches(held)
            held = [batch.slice(edges[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _candidates(num: int, den: int):
    """Edges that span the candidates of each shingle's (or pair of blocks') group."""

    def find(batches):
        for t in _grouped(batches, ["shingle", "tile"]):
            ids, n, m = t["id"].to_numpy(), t["n"].to_numpy().astype(np.int64), t["m"].to_numpy().astype(np.int64)
            shingle, tile = t["shingle"].to_numpy(), t["tile"].to_numpy()
            bits = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
            first = np.concatenate([[0], np.flatnonzero((shingle[1:] != shingle[:-1]) | (tile[1:] != tile[:-1])) + 1])
            group = np.repeat(np.arange(len(first)), np.diff([*first, len(ids)]))

            def fitting(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                ok = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (den * np.minimum(m[i], m[j]) >= num * np.maximum(m[i], m[j]))
                at = np.flatnonzero(ok)
                both = m[i[at]] + m[j[at]]
                ok[at] = np.bitwise_count(bits[i[at]] ^ bits[j[at]]).sum(axis=1) <= both - 2 * -(-num * both // (num + den))
                return ok

            if "label" in t.schema.names:  # those of one label are linked already
                label = t["label"].to_numpy()
                a, b = [ids[:0]], [ids[:0]]
            else:  # those that fit with the first of their group need no comparison among themselves
                lead = first[group]
                label = np.arange(len(ids))
                joins = np.flatnonzero(lead < label)
                joins = joins[fitting(lead[joins], joins)]
                label[joins] = lead[joins]
                a, b = [ids[lead[joins]]], [ids[joins]]
            alive = np.arange(len(ids) - 1)
            d, pending = 1, 0
            while len(alive):
                alive = alive[alive + d < len(ids)]
                alive = alive[group[alive] == group[alive + d]]
                i = alive[label[alive] != label[alive + d]]
                i = i[fitting(i, i + d)]
                a.append(ids[i])
                b.append(ids[i + d])
                pending += len(i)
                if pending > 1_000_000:
                    a, b = ([x] for x in spanning(np.concatenate(a), np.concatenate(b)))
                    pending = 0
                d += 1
            a, b = np.concatenate(a), np.concatenate(b)
            a, b = spanning(a[a != b], b[a != b])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return find


class Trie:
    """Sets of numbers as paths from a root, each sorted with the number that most sets hold first.

    ``held`` tells how many sets of the corpus hold the numbers that are asked for; without it, these sets are counted.
    A node stands for the numbers from ``depth`` to ``end`` of its sets ``low`` to ``high`` (in sorted order).
    """

    def __init__(self, sets: list[np.ndarray], held: Callable[[np.ndarray], np.ndarray] | None = None):
        flat = np.concatenate(sets)
        numbers, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        if held:
            counts = held(numbers).astype(np.int64)
        rank = np.empty(len(counts), np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        paths = [np.sort(p) for p in np.split(rank[inverse], cuts)]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">i4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes = np.array([len(p) for p in self.paths])
        self.width = len(counts)
        self.shared = [self._shared(p, q) for p, q in zip(self.paths, self.paths[1:], strict=False)]
        self.root = self._node(0, len(self.paths), 0)

    @staticmethod
    def _shared(p: np.ndarray, q: np.ndarray) -> int:
        m = min(len(p), len(q))
        off = p[:m] != q[:m]
        return int(off.argmax()) if off.any() else m

    def _node(self, low: int, high: int, depth: int) -> list:
        """[low, high, depth, end, least size, largest size, children, component]; built without recursion."""
        root = [low, high, depth, 0, 0, 0, [], -1]
        todo = [root]
        while todo:
            node = todo.pop()
            low, high, depth = node[:3]
            inner = self.shared[low : high - 1]
            node[3] = end = min(inner) if inner else len(self.paths[low])
            node[4], node[5] = int(self.sizes[low:high].min()), int(self.sizes[low:high].max())
            if high - low > 1:
                cuts = [low, *[low + 1 + i for i, s in enumerate(inner) if s == end], high]
                node[6] = [[a, b, end, 0, 0, 0, [], -1] for a, b in zip(cuts, cuts[1:], strict=False)]
                todo += node[6]
        return root

    def colour(self, label: np.ndarray) -> None:
        """Note on each node the component that all its sets are in, or -1."""
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        todo = [self.root]
        while todo:
            node = todo.pop()
            node[7] = int(label[node[0]]) if change[node[0]] == change[node[1] - 1] else -1
            todo += node[6]

    def probe(self, i: int, num: int, den: int, label: np.ndarray) -> list[int]:
        """Sets after the i-th, of other components, whose Jaccard similarity with it is num / den or more."""
        own, size = self.paths[i], len(self.paths[i])
        held = np.zeros(self.width, bool)
        held[own] = True
        upto = np.concatenate([[0], np.cumsum(held)])
        found, todo = [], [(self.root, 0)]
        while todo:
            (low, high, depth, end, least, most, children, colour), overlap = todo.pop()
            if high <= i + 1 or colour == label[i] or den * most < num * size or num * least > den * size:
                continue
            edge = self.paths[low][depth:end]
            overlap += int(held[edge].sum())
            need = -(-num * (size + max(least, -(-num * size // den))) // (num + den))
            left = size - int(upto[self.paths[low][end - 1] + 1]) if end else size
            if overlap + min(left, most - end) < need:
                continue
            if children:
                todo += [(c, overlap) for c in children]
            else:
                found += [j for j in range(max(low, i + 1), high) if (num + den) * overlap >= num * (size + int(self.sizes[j])) and label[j] != label[i]]
        return found


def trie_links(sets: list[np.ndarray], num: int, den: int, held: Callable | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of ``sets`` (no one empty) that link: enough to connect whatever links connect. Those that ``known`` gives
    one label are connected already."""
    trie = Trie(sets, held)
    m = len(sets)
    label, links = np.arange(m) if known is None else np.unique(known[trie.order], return_inverse=True)[1], []

    def join(i: int, j: int) -> None:
        links.append((trie.order[i], trie.order[j]))
        label[label == label[j]] = label[i]

    for i, shared in enumerate(trie.shared):
        size = len(trie.paths[i]) + len(trie.paths[i + 1])
        if label[i] != label[i + 1] and (num + den) * min(len(trie.paths[i]), len(trie.paths[i + 1])) >= num * size:
            overlap = shared + len(np.intersect1d(trie.paths[i][shared:], trie.paths[i + 1][shared:], assume_unique=True))
            if (num + den) * overlap >= num * size:
                join(i, i + 1)
    if len(np.unique(label)) > 1:
        trie.colour(label)
        for i in range(m - 1):
            for j in trie.probe(i, num, den, label):
                if label[j] != label[i]:
                    join(i, j)
    return links


def _sets(n: int):
    def read(batches):
        for part in _parts(batches):
            found = [_words(t) for t in part["text"].to_pylist()]
            own = pa.array([_class(w) == c for w, c in zip(found, part["of"].to_pylist(), strict=True)], pa.bool_())
            sets = pa.array([shingles(w, n).view(np.int64) for w in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part["id"], part["component"], part["label"], part["tiles"], sets], ["id", "component", "label", "tiles", "shingles"]).filter(own)

    return read


def _links(num: int, den: int, slots):
    def find(batches):
        table = slots.value
        held = lambda s: table[(s.view(np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64)]
        for t in _grouped(batches, ["component", "tile"]):
            ids, label, group, tile = (t[c].to_numpy() for c in ("id", "label", "component", "tile"))
            lists = t["shingles"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            flat, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            cuts = cuts - cuts[0]
            new = np.flatnonzero((group[1:] != group[:-1]) | (tile[1:] != tile[:-1])) + 1
            edges = [0, *new.tolist(), len(ids)]
            out = []
            del t, lists
            for low, high in zip(edges, edges[1:], strict=False):
                if (label[low:high] != label[low]).any():
                    out += [(ids[low + i], ids[low + j]) for i, j in trie_links([flat[cuts[k] : cuts[k + 1]] for k in range(low, high)], num, den, held, label[low:high])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return find


def _few(rows: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast where it is small: by its rows and the entries of its tiles."""
    size = F.count(F.lit(1)) if "tiles" not in rows.columns else F.sum(F.size("tiles") + 1)
    return F.broadcast(rows) if (rows.agg(size).first()[0] or 0) <= SMALL else rows


def _minor_tiles(rows: DataFrame, key: str, weight: Column, block: int) -> DataFrame:
    """For groups of ``key`` whose rows have more than one label: blocks (of ``block`` by ``weight``) of the largest label's
    rows, and of the others'. Each two of the latter meet in a tile, and each of them meets each of the former. Others have
    no tiles. Adds tiles."""
    sums = rows.groupBy(key, "label").agg(F.sum(weight).alias("volume"))
    most = sums.groupBy(key).agg(F.max_by("label", F.struct("volume", "label")).alias("major"), F.max("volume").alias("large"), F.sum("volume").alias("all"))
    most = most.where("large < all").select(F.col(key).alias("_key"), "major", F.ceil(F.col("large") / block).alias("large"), F.ceil((F.col("all") - F.col("large")) / block).alias("small"))
    d = rows.join(most, F.col(key) == F.col("_key"))
    width = F.col("large") + F.col("small")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("label") == F.col("major"), F.col("large")).otherwise(F.col("small")))
    to_all = F.transform(upto(F.col("small")), lambda i: i * width + F.col("small") + own)
    among = F.transform(upto(F.col("small")), lambda j: F.least(own, j) * width + F.greatest(own, j))
    beyond = F.transform(upto(F.col("large")), lambda j: own * width + F.col("small") + j)
    return d.select(*rows.columns, F.when(F.col("label") == F.col("major"), to_all).otherwise(F.concat(among, beyond)).alias("tiles"))


def _candidate_edges(found: DataFrame, num: int, den: int, largest: int) -> DataFrame:
    """Edges (a, b) that span the candidates of each shingle's group of rows (shingle, size, id, n, m, sketch).

    Groups of over ``BLOCK`` rows are dealt to blocks anew in each of ``DEALS`` rounds: what fits anything in its block is
    linked to it, so a group of near copies, however large, comes together in a few rounds over its rows. Only rows that then are in no
    component with most of their group are compared with all of it.
    """
    partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(partitions, "shingle", "tile").sortWithinPartitions("shingle", "tile", "id")
        return dealt.mapInArrow(releasing(_candidates(num, den)), "a long, b long")

    whole = F.lit(0).cast("long")
    if largest <= BLOCK:
        return compared(found.withColumn("tile", whole))
    small, large = found.where(F.col("size") <= BLOCK), materialize(found.where(F.col("size") > BLOCK))
    edges = materialize(compared(small.withColumn("tile", whole)))
    for k in range(DEALS):
        tile = F.pmod(F.xxhash64("id", F.lit(k)), F.ceil(F.col("size") / BLOCK))
        edges = edges.unionByName(materialize(compared(large.withColumn("tile", tile))))
    named = connected_components(edges).select(F.col("id").alias("_id"), F.col("component").alias("label"))
    named = materialize(large.join(named, F.col("id") == F.col("_id"), "left").select(*large.columns, F.coalesce("label", "id").alias("label")))
    rest = _minor_tiles(named, "shingle", F.lit(1), BLOCK).withColumn("tile", F.explode("tiles")).drop("tiles")
    return edges.unionByName(compared(rest))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of documents (doc_id, text) that link when their sets' Jaccard similarity is num / den or more.

    A-Z are lower-cased; words are runs of other bytes than blanks. A document's set is its distinct ``n``-word
    shingles; with fewer words, the whole sequence as one; without words (null, empty, blank), the empty set, which
    links with nothing. Whole texts of any length are read. Rows with one doc_id are one document for links. A null
    doc_id links with nothing and its component is null. Rows come back one for one; other columns are ignored.
    Returns doc_id, n_shingles long, component_id long (the smallest doc_id that links reach).
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    rows, slots = counted(docs, n)
    counts = spark.sparkContext.broadcast(slots)
    parts = docs.where("doc_id IS NOT NULL").mapInArrow(releasing(_prefixes(n, num, den, counts)), "doc_id long, class binary, n int, level int, part int, m int, sketch binary, first array<long>")
    parts = materialize(parts.groupBy("class", "level", "part").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("n", "m", "sketch", "first")]))
    found = parts.select("id", "level", "part", "n", "m", F.explode("first").alias("shingle")).withColumn("shingle", F.xxhash64("shingle", "level"))
    shared = materialize(found.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    found = found.join(_few(shared), "shingle").join(parts.select("id", "level", "part", "sketch"), ["id", "level", "part"]).select("shingle", "size", "id", "n", "m", "sketch")
    groups = connected_components(_candidate_edges(found, num, den, shared.agg(F.max("size")).first()[0] or 0))
    classes = parts.groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    groups = materialize(groups.join(classes.select("id", "n", F.col("class").alias("of")), "id"))
    groups = materialize(groups.join(groups.groupBy("component").agg(F.sum("n").alias("size")), "component").select("id", "of", "component", "size", "n"))

    def joined(members: DataFrame) -> DataFrame:
        """Links of sets (id, of, component, label, tiles) in the tiles of each component."""
        texts = docs.join(_few(members), F.col("doc_id") == F.col("id")).select("id", "of", "component", "label", "tiles", "text")
        sets = texts.mapInArrow(releasing(_sets(n)), "id long, component long, label long, tiles array<long>, shingles array<long>")
        sets = sets.select("component", F.explode("tiles").alias("tile"), "id", "label", "shingles").repartition(partitions, "component", "tile")
        return sets.sortWithinPartitions("component", "tile", "id").mapInArrow(releasing(_links(num, den, counts)), "a long, b long")

    def labelled(links: DataFrame) -> DataFrame:
        named = connected_components(links).select(F.col("id").alias("_id"), F.col("component").alias("label"))
        return materialize(large.join(named, F.col("id") == F.col("_id"), "left").select("id", "of", "component", "n", F.coalesce("label", "id").alias("label")))

    whole = F.array(F.lit(0).cast("long")).alias("tiles")
    links = materialize(joined(groups.where(F.col("size") <= VOLUME).select("id", "of", "component", F.col("id").alias("label"), whole)))
    large = groups.where(F.col("size") > VOLUME)
    if large.limit(1).count():
        now, last = large.withColumn("label", F.col("id")), None
        while True:
            # One set of each label meets the others of its block.
            members = now.where("id = label")
            blocks = members.groupBy("component").agg(F.ceil(F.sum("n") / VOLUME).alias("blocks"), F.count(F.lit(1)).alias("labels"))
            left = blocks.agg(F.sum("labels"), F.max("blocks")).first()
            if last is not None and (left[0] > 0.9 * last[0] or last[1] == 1):
                break
            members = members.join(blocks, "component").withColumn("tiles", F.array(F.pmod(F.xxhash64("id", F.lit(left[0])), F.col("blocks"))))
            links = materialize(links.unionByName(joined(members.select("id", "of", "component", "label", "tiles"))))
            now, last = labelled(links), left
        links = links.unionByName(joined(materialize(_minor_tiles(now, "component", F.col("n"), VOLUME).select("id", "of", "component", "label", "tiles"))))
    linked = connected_components(links).withColumnRenamed("component", "reached")
    named = classes.select("class", "id").join(linked, "id", "left").select(F.col("class").alias("of"), F.coalesce("reached", "id").alias("component_id"))
    own = rows.select("doc_id", "class", "n").join(named, (F.col("class") == F.col("of")) & F.col("doc_id").isNotNull(), "left")
    return own.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
