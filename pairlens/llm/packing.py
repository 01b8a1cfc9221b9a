"""Packing by best-fit decreasing: a segment tree over remaining capacities finds the tightest open window."""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import hold, materialize, releasing, shuffle_partitions

WINDOW, END = 2048, 1
#: Pieces that one task packs, about; a task's leftover room is that of one window in some hundreds.
BUCKET = 16_384
#: Characters that no version of Unicode takes for white space, and a blank between two of them.
_SOLID = r"[^\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff]"
_BLANK = re.compile(" (?<={0} )(?={0})".format(_SOLID))
_WORD = re.compile(f"{_SOLID}+")


class Encoder:
    """Ids of texts by a file of `tokenizers`, as little-endian 32-bit bytes.

    A byte-level tokenizer starts a new part at each ``_BLANK``, so the ids of a text are those of its words, one after
    the other; the ids of words of up to ``kept`` characters together are kept (beyond it, and between tasks, those of the
    first eighth: see ``forget``), and a long text is cut into stretches of about ``stretch`` characters. New words are
    coded as one text, of which a word begins at each token that begins with a blank. A text that holds the string of a
    special token is coded whole, and so is every text where the tokenizer is of another kind.
    """

    def __init__(self, path: str, kept: int = 1 << 22, stretch: int = 1 << 18):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        t = self.tokenizer = Tokenizer.from_file(path)
        plain = t.normalizer is None and t.truncation is None and t.padding is None
        cut = t.pre_tokenizer
        self.by_words = plain and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
        vocabulary = t.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that begin with a blank
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.special = [token.content for token in t.get_added_tokens_decoder().values()]
        self.known, self.held, self.kept, self.stretch = {}, 0, kept, stretch

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for coded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = array("I", coded.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            out.append(ids.tobytes())
        return out

    def stretches(self, text: str):
        low = 0
        while len(text) - low > self.stretch and (cut := _BLANK.search(text, low + self.stretch)):
            yield text[low : cut.start()]
            low = cut.start()  # the next stretch begins with the blank
        yield text[low:]

    def forget(self) -> None:
        """Keep the ids of the words that came first, of up to an eighth of ``kept`` characters together: common words come early."""
        known, held = {}, 0
        for word, ids in self.known.items():
            if held + len(word) > self.kept // 8:
                break
            held += len(word)
            known[word] = ids
        self.known, self.held = known, held

    def learn(self, words: list[str]) -> None:
        solid = [w for w in words if _WORD.fullmatch(w)]
        ids = self.whole([f" {' '.join(solid)}"])[0] if solid else b""
        starts = (4 * np.flatnonzero(self.opens[np.frombuffer(ids, "<u4")])).tolist()
        if len(starts) == len(solid):
            self.known.update(zip(solid, map(ids.__getitem__, map(slice, starts, [*starts[1:], len(ids)])), strict=True))
            words = [w for w in words if w not in self.known]
        self.known.update(zip(words, self.whole([f" {w}" for w in words]), strict=True))

    def words(self, text: str) -> bytes:
        head, *words = _BLANK.split(text)
        new = set(words).difference(self.known)
        if self.held > self.kept:
            self.forget()
            new = set(words).difference(self.known)
        self.held += sum(map(len, new))
        self.learn(list(new))
        return self.whole([head])[0] + b"".join(map(self.known.__getitem__, words))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.words, self.stretches(t))) if self.by_words and not any(s in t for s in self.special) else self.whole([t])[0] for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process: a function of the module, so that its tasks share it until others run here."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        hold(_encoders.clear)
    return _encoders[path]


def _pieces(tokenizer: str, window: int, end: int):
    def cut(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part, out = batch.slice(low, 64), []
                for doc, ids in zip(part["doc_id"].to_pylist(), encode([t or "" for t in part["text"].to_pylist()]), strict=True):
                    ids += end.to_bytes(4, "little")
                    n = len(ids) // 4
                    out += [(doc, at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        encode.forget()  # an executor has more workers than cores, and tasks go round all of them

    return cut


def best_fit_decreasing(lengths, window: int) -> tuple[list[int], list[int]]:
    """Windows and offsets for ``lengths``, which descend: each goes to the open window with the least room that fits.

    A segment tree over capacities 0..window counts the open windows of each; the descent finds the smallest
    capacity at or above a length that has one.
    """
    size = 1 << window.bit_length()
    tree, stacks = [0] * (2 * size), [[] for _ in range(window + 1)]
    used: list[int] = []

    def add(room: int, by: int) -> None:
        i = room + size
        while i:
            tree[i] += by
            i >>= 1

    bins, offsets = [], []
    for n in lengths:
        i = n + size
        while not tree[i]:  # up to the first subtree to the right that has a window
            while i & 1 and i > 1:
                i >>= 1
            if i <= 1:
                break
            i += 1
        if i > 1 and tree[i]:
            while i < size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
            room = i - size
            b = stacks[room].pop()
            add(room, -1)
        else:
            b, room = len(used), window
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if room - n:
            stacks[room - n].append(b)
            add(room - n, 1)
    return bins, offsets


def _pack(window: int):
    def pack(batches):
        bucket, lengths, held = None, [], []

        def packed():
            if held:
                whole = pa.Table.from_batches(held)
                bins, offsets = best_fit_decreasing(lengths, window)
                whole = whole.append_column("bin", pa.array(bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
                yield from whole.to_batches()

        for batch in batches:
            b = batch["bucket"].to_numpy()
            edges = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for low, high in zip(edges, edges[1:], strict=False):
                if low < high:
                    if b[low] != bucket:
                        yield from packed()
                        bucket, lengths, held = b[low], [], []
                    part = batch.slice(low, high - low)
                    held.append(part)
                    lengths += part["length"].to_pylist()
        yield from packed()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``window`` tokens by best-fit decreasing.

    A document is its text's ids by the file ``tokenizer`` of `tokenizers`, then ``end``; a null text is empty, so its
    one token is ``end``. What exceeds a window is first cut into full windows, which are sequences of their own. The
    rest are dealt by hash to buckets of about ``BUCKET`` pieces, and each bucket is packed alone, so no task sees
    all; a task packs one bucket after another. Ties go by doc_id; repeated rows are documents of their own. Reruns agree. Other columns are ignored.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, all long; a sequence_id is its
    bucket times 2^40 plus a number in it.
    """
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(releasing(_pieces(tokenizer, window, end), keep=True), kinds))
    buckets = max(1, pieces.count() // BUCKET)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    tasks = min(buckets, shuffle_partitions(docs.sparkSession))
    dealt = pieces.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket", F.desc("length"), "doc_id", "start", "ids_crc32")
    packed = dealt.mapInArrow(releasing(_pack(window), keep=True), f"{kinds}, bucket long, bin long, offset long")
    return packed.select(*[c.split()[0] for c in kinds.split(", ")], (F.col("bucket") * F.lit(2**40) + F.col("bin")).alias("sequence_id"), "offset")
