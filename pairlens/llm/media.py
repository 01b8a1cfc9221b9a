"""Media columns: payloads stored as FLAC streams, read back as PCM blocks with seekable sample offsets."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import flac

#: A payload is padded with zero bytes to a positive multiple of this; bytes of payloads that are coded at a time.
UNIT, BATCH = 64, 2_000_000


def payload(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 bytes of a text, their number, and the padding."""
    b = (text or "").encode("utf-8", "replace")
    return len(b), b + b"\0" * (-len(b) % UNIT if b else UNIT)


def _portions(batches, columns: list[str], size: str):
    """Rows of ``columns`` as lists, about BATCH bytes of column ``size`` at a time."""
    for batch in batches:
        rows, total = [], 0
        for row in zip(*[batch[c].to_pylist() for c in columns], strict=True):
            rows.append(row)
            total += len(row[columns.index(size)] or b"")
            if total > BATCH:
                yield list(zip(*rows, strict=True))
                rows, total = [], 0
        if rows:
            yield list(zip(*rows, strict=True))


def _store(batches):
    for docs, texts in _portions(batches, ["doc_id", "text"], "text"):
        sizes, payloads = zip(*map(payload, texts), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(flac.encode(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """Store the whole text of each document (doc_id, text) as an 8-bit FLAC stream; one pass, no shuffle.

    A null text is empty; an empty payload is one unit of zeros. Rows come back one for one, equal texts as equal
    streams; other columns are ignored. Returns doc_id, n_bytes long, media binary.
    """
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _blocks(batches):
    for docs, media in _portions(batches, ["doc_id", "media"], "media"):
        rows, held = [], [(d, m) for d, m in zip(docs, media, strict=True) if m is not None]
        if not held:
            continue
        for (doc, m), blocks in zip(held, flac.decode([m for _, m in held]), strict=True):
            at, points = 0, {p[0]: p[1] for p in flac.Stream(m).points}
            for k, b in enumerate(blocks):
                rows.append((doc, k, at, len(b), points.get(at), b))
                at += len(b)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "block", "sample_offset", "n_samples", "frame_offset", "pcm"])


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """Decode streams (doc_id, media) into PCM blocks; checksums that do not hold raise ValueError.

    ``sample_offset`` is a block's first sample and ``frame_offset`` where its frame lies after the metadata, so a
    reader can seek. A null stream has no blocks. Returns doc_id, block int, sample_offset long, n_samples int, frame_offset long, pcm binary.
    """
    return stored.select("doc_id", "media").mapInArrow(_blocks, "doc_id long, block int, sample_offset long, n_samples int, frame_offset long, pcm binary")


def features(pcm: bytes) -> str:
    """Peak, mean square and zero crossings of samples around 128, in thousandths where not whole."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"peak={int(np.abs(x).max())};mean={int(x.sum()) * 1000 // len(x)};square={int((x * x).sum()) * 1000 // len(x)};crossings={crossings}"


def _digests(batches):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for docs, sizes, media in _portions(batches, ["doc_id", "n_bytes", "media"], "media"):
        rows = []
        read = iter(flac.decode([m for m in media if m is not None]))
        for doc, n, m in zip(docs, sizes, media, strict=True):
            if m is None:
                rows.append((doc, n, *[None] * 6))
                continue
            blocks = next(read)
            pcm = b"".join(blocks)
            rows.append((doc, n, len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), features(pcm)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def digests(stored: DataFrame) -> DataFrame:
    """Digests and features of what streams (doc_id, n_bytes, media) read back as; the same checks as ``pcm_blocks``.

    A null stream has nulls.
    """
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_digests, kinds)
