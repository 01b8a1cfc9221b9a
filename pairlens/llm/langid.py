"""Language identification with string kernels: n-gram presence, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the number of n-grams (blended over lengths) present in both, over the root of the product
of how many each has. N-grams are counted in hashed slots, so a text's presence is a vector of fixed size; kernels with
the landmarks, the Nyström map and the one-versus-rest ridge regressions are matrix products over batches of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import materialize, releasing

#: Lengths of n-grams, and slots for each length.
LENGTHS, SLOTS = (1, 2, 3), 1 << 12
WIDTH = SLOTS * len(LENGTHS)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_PART = 256


def presence(text: str, out: np.ndarray) -> None:
    """Set in ``out`` (zeros, of WIDTH) the slots of all n-grams of the whole text, lower-cased."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    # A letter is as it is; all that is no letter is one character (most of it is below "A" or between cases).
    points = np.where((points < 97) | ((points > 122) & (points < 170)), np.uint32(32), points)
    h = np.zeros(len(points), np.uint32)
    for k, n in enumerate(LENGTHS):
        m = len(points) - n + 1
        if m <= 0:
            return
        h = h[:m] * np.uint32(31) + points[n - 1 :] * _FACTORS[k]
        g = h ^ (h >> np.uint32(15))
        out[k * SLOTS + ((g * np.uint32(0x2C1B3C6D)) >> np.uint32(20)).astype(np.int64)] = 1


def presences(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH), np.uint8)
    for row, text in zip(out, texts, strict=True):
        presence(text, row)
    return out


@dataclass
class Model:
    """Languages, landmarks (unit rows of n-gram presence) and weights from kernels with them to scores."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One-versus-rest scores, as shares of 1, for rows of presence."""
        f = x.astype(np.float32)
        f /= np.sqrt(np.maximum(f.sum(axis=1, keepdims=True), 1))
        s = np.clip(((f @ self.landmarks.T) @ self.weights + 1) / 2, 1e-3, None).astype(np.float64) ** 4
        return s / s.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: list[str], landmarks: int = 192, ridge: float = 1e-2, seed: int = 11) -> Model:
    """Fit on rows ``x`` of presence with languages ``y``; as many landmarks of each language as its rows allow."""
    languages = sorted(set(y))
    f = x.astype(np.float32)
    f /= np.sqrt(np.maximum(f.sum(axis=1, keepdims=True), 1))
    rng, label = np.random.default_rng(seed), np.array([languages.index(v) for v in y])
    each = -(-landmarks // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(label == k))[:each] for k in range(len(languages))])
    marks = f[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-4 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])  # K^(-1/2) of the landmarks
    phi = (f @ marks.T).astype(np.float64) @ root
    goal = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = 1 / np.maximum(np.bincount(label, minlength=len(languages)), 1)
    w = share[label] / share[label].sum()  # each language weighs the same
    a = (phi * w[:, None]).T @ phi + ridge / len(phi) * np.eye(phi.shape[1])
    return Model(languages, marks, (root @ np.linalg.solve(a, (phi * w[:, None]).T @ goal)).astype(np.float32))


def _packed(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, _PART):
            part = batch.slice(low, _PART)
            bits = np.packbits(presences(part["text"].to_pylist()), axis=1)
            yield pa.RecordBatch.from_arrays([part["lang"], pa.array([b.tobytes() for b in bits], pa.binary())], ["lang", "bits"])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(labelled: DataFrame, rows: int = 4096, seed: int = 11) -> Model | None:
    """A model from labelled texts (text, lang), of which at most ``rows`` are fitted; None if there are none.

    Each language has the same number of distinct texts in the sample, or all that it has, however often they are
    repeated; a hash of the text draws them. Every language has one at least, so of more than ``rows`` languages one
    text each is fitted. The sample is bounded whatever the corpus, and the driver gets its n-gram presence (1.5 KB a
    text) and one count for each language, not its texts.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("text", "lang", F.xxhash64(F.lit(seed), "text").alias("draw"))
    sizes = known.select("lang", "draw").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return None
    each = max(1, rows // len(sizes))
    # Draws are even over 64 bits: below this, a language has its part and some more, of which the lowest are taken.
    most = [(r.lang, min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, (1.25 * each + 40) / r.n)))) for r in sizes]
    drawn = known.join(F.broadcast(spark.createDataFrame(most, "lang string, most long")), "lang").where("draw <= most")
    sample = drawn.groupBy("draw", "lang").agg(F.first("text").alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    sample = materialize(sample.withColumn("place", place).where(F.col("place") <= each))
    drawn = sample.select("text", "lang").mapInArrow(releasing(_packed), "lang string, bits binary").collect()
    pairs = sorted((r.lang, r.bits) for r in drawn)
    return fit(np.unpackbits(np.array([np.frombuffer(b, np.uint8) for _, b in pairs]), axis=1), [lang for lang, _ in pairs], seed=seed)


def _predicted(model, keep):
    def predict(batches):
        m: Model | None = model.value
        for batch in batches:
            for low in range(0, batch.num_rows, _PART):
                part = batch.slice(low, _PART)
                ok = np.array(part["_lettered"].to_pylist(), bool)
                lang, score = np.full(len(ok), "und", object), np.zeros(len(ok))
                if ok.any() and m is not None:
                    texts = [t for t, k in zip(part["text"].to_pylist(), ok, strict=True) if k]
                    s = m.scores(presences(texts))
                    lang[ok], score[ok] = np.array(m.languages, object)[s.argmax(axis=1)], s.max(axis=1)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in keep], pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of the whole text of documents (doc_id, text); one pass, no shuffle.

    A null text, one without a letter, and any text where there is no model get ``und`` and score 0. Rows come back
    one for one; other columns are ignored, but for those of ``keep``. Returns doc_id, text, what ``keep`` names,
    lang_pred, score double (0 to 1).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", *keep, has_letter(F.col("text")).alias("_lettered"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(releasing(_predicted(shared, rows.columns[:-1])), f"{kinds}, lang_pred string, score double")


def fold(doc_id: Column) -> Column:
    """The fold, 0 to 3, of a document: crc32 of its doc_id as text; a null doc_id is fold 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4, F.lit(0))
