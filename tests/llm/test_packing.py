import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairlens.llm import packing, swap_packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_codes_are_those_of_the_file():
    t, e, rng = Tokenizer.from_file(PATH), packing.Encoder(PATH), random.Random(2)
    parts = ["a", " ", "\n", "'s", ".", ", ", ". ", ",", "1", "é", "　", "日", "\t", "_", "\x01", "\x85", "\xa0", "²", "ª", "<|endoftext|>", "Word", " the", "\r\n", "\x1c"]
    texts = ["", " ", "a ", "x\n\ny", "x" * 100_000, " " * 5000, "!" * 5000] + [a + b + c for a in "a1 !" for b in map(chr, [*range(0x250), *range(0x2010, 0x2028)]) for c in " b"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["".join(map(chr, rng.choices(range(0x250), k=40))) for _ in range(2000)]
    texts += [" ".join(rng.choice(parts) + rng.choice(["", "word", "日本", "x\u0301", "\U0001f600"]) for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts += [chr(p) + " " + chr(q) for p in range(0x3100) for q in (p, 97)]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert e.by_words and [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == want
    e.opens[:] = False  # beginnings that can't be told: each word by itself
    e.known = {}
    assert [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == want
    small = packing.Encoder(PATH, kept=50, stretch=10)  # forgets often, cuts nearly every text
    assert [np.frombuffer(x, "<u4").tolist() for x in small(texts)] == want


def test_tasks_leave_few_words():
    words = lambda p: " ".join(f"{p}{i}" for i in range(120_000))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [words("ab"), words("cd")]})
    for pieces in (packing._pieces(PATH, 2048, 1), swap_packing._pieces(PATH, 1024, 2)):
        first = [r.to_pylist() for r in pieces(iter([batch]))]
        e = packing.encoder(PATH)
        assert 0 < sum(map(len, e.known)) == e.held <= e.kept // 8 <= 1 << 19
        assert [r.to_pylist() for r in pieces(iter([batch]))] == first


def test_other_tokenizers_code_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, e, texts = Tokenizer.from_file(path), packing.Encoder(path), ["A b  c", "", "Word word's"]
    assert not e.by_words and [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_best_fit_against_scan():
    rng = random.Random(4)
    lengths = sorted((rng.randrange(1, 65) for _ in range(400)), reverse=True)
    bins, offsets = packing.best_fit_decreasing(lengths, 64)
    room = []
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[b] == min(fits) and o == 64 - room[b]
            room[b] -= n
        else:
            assert b == len(room) and o == 0
            room.append(64 - n)


def check(docs, rows):
    t = Tokenizer.from_file(PATH)
    left = defaultdict(int)
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            left[(r.doc_id, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids))] += 1
    got = packing.pack_documents(docs, PATH).collect()
    sequences = defaultdict(list)
    for r in got:
        left[(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] -= 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert not any(left.values())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(r.length for r in got), len(sequences)


def test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokens, sequences = check(docs.withColumn("length", F.lit("x")), docs.collect())
    assert sequences <= 1.03 * tokens / 2048 + 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 5000)], "doc_id long, text string")
    check(docs, docs.collect())
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
