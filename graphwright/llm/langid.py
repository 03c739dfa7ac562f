"""Language identification by string kernels.

The kernel of two texts is the number of n-grams (n = 1 to 4, blended) present
in both, over the geometric mean of the numbers present in each. N-grams are
hashed to buckets. Landmark texts give a Nyström map of the kernel; one ridge
regression against the rest for each language is solved in that space. Scoring
is two matrix products for each batch: presences by landmarks, kernels by
coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that n-grams are hashed to.
BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
#: Labelled documents of each language that the model is fitted on, at most.
SAMPLE = 300
#: Landmark documents of each language, at most.
LANDMARKS = 24
#: What a text without letters is.
UNKNOWN = "und"

_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def presences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x buckets presence matrix, whether each text has a letter).

    Characters are lower-cased; all but letters count as spaces.
    """
    codes = np.frombuffer((" " + "  ".join(t.lower() for t in texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    # lower-casing can change lengths, so the bounds come from the parts that were joined
    sizes = np.array([len(t.lower()) + 2 for t in texts], np.int64)
    letter = _LETTER[codes]
    codes = np.where(letter, codes, 32).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, sizes)
    present = np.zeros(len(texts) * BUCKETS, np.float32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        # h[i]: hash of the n characters from i; n-grams over a text's end fall on its spaces
        h = (h[: len(codes) - n + 1] + codes[n - 1 :]) * _MULTIPLIERS[n - 1]
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            present[row[: len(h)] + (h >> shift)] = 1
    has = np.add.reduceat(letter, np.cumsum(sizes) - sizes) > 0 if len(texts) else np.zeros(0, bool)
    return present.reshape(len(texts), BUCKETS), has


@dataclass
class Model:
    """Landmarks (landmarks x buckets) and coefficients (landmarks x languages)."""

    languages: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray
    bias: np.ndarray
    sharpness: float = 6.0

    def kernel(self, present: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
        own = np.sqrt(np.maximum(self.landmarks.sum(1), 1))
        return (present @ self.landmarks.T) / (norm * own)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text; ``und`` and 0 without letters."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        present, has = presences(texts)
        margin = self.kernel(present) @ self.coefficients + self.bias
        e = np.exp(self.sharpness * (margin - margin.max(1, keepdims=True)))
        best, score = margin.argmax(1), (e / e.sum(1, keepdims=True)).max(1)
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
        return names, np.where(has, score, 0.0)


def _batches(texts: list[str], rows: int = 64, chars: int = 1_000_000) -> Iterator[list[str]]:
    """Lists of texts small enough for one presence matrix."""
    held, size = [], 0
    for t in texts:
        if held and (len(held) == rows or size + len(t) > chars):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def fit(rows: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Model:
    """Fit on labelled rows (text, lang), at most ``sample`` for each language.

    The sample is the rows with the least hashes of their texts. Executors
    reduce each sampled text, whole, to the bits of its presences, so what the
    driver gets is bounded by the sample. Null texts and languages are left out.
    """
    rows = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).where(
        "text is not null and lang is not null"
    )
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, 0)), np.zeros(0))
    # twice the sample by hash first: the ordered window then sees few rows of each language
    part = F.shiftrightunsigned(F.xxhash64("text"), 12)
    enough = F.lit(False)
    for lang, n in counts.items():
        upto = min(1.0, 2 * sample / n) if n > 4 * sample else 1.0
        enough = enough | ((F.col("lang") == lang) & (F.col("h") < int(upto * (1 << 52))))
    some = rows.withColumn("h", part).where(enough)
    order = Window.partitionBy("lang").orderBy("h", "text")
    some = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for part_ in _batches(batch.column(0).to_pylist()):
                packed += [x.tobytes() for x in np.packbits(presences(part_)[0].astype(bool), axis=1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed, pa.binary()), batch.column(1), batch.column(2)], ["bits", "lang", "k"]
            )

    got = some.select("text", "lang", "k").mapInArrow(bits, "bits binary, lang string, k int").collect()
    got.sort(key=lambda r: (r.lang, r.k))
    languages = sorted(counts)
    present = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in got]).astype(np.float32)
    marks = present[[i for i, r in enumerate(got) if r.k <= landmarks]]
    model = Model(languages, marks, np.zeros((len(marks), len(languages))), np.zeros(len(languages)))
    # Nyström: K_nm K_mm^(-1/2) are the features of the rows
    values, vectors = np.linalg.eigh(model.kernel(marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = model.kernel(present).astype(np.float64) @ root
    mean = features.mean(0)
    x = features - mean
    y = np.array([[1.0 if r.lang == lang else -1.0 for lang in languages] for r in got])
    w = np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(x.shape[1]), x.T @ (y - y.mean(0)))
    model.coefficients = root @ w
    model.bias = y.mean(0) - mean @ w
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced.

    A null text, or one without a letter, is ``und`` with score 0. The whole
    text is read; no other column is. Nothing is shuffled.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by landmarks x buckets

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            names, scores = [], []
            for some in _batches([t or "" for t in texts]):
                lang, score = shared.value.predict(some)
                names += lang
                scores += list(score)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    said = docs.withColumn("__said", run(F.col("text").cast("string")))
    return said.select(*columns, "__said.lang_pred", "__said.score")


def held_out(doc_id: str = "doc_id"):
    """Whether a document serves for testing only: crc32(doc_id as text) mod 3 is 1."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, lang_pred and score, learned from the rows not held out.

    Rows with a null doc_id are not held out. An empty table gives no rows; a
    table without labels gives ``und`` for all.
    """
    marked = docs.withColumn("held_out", held_out())
    return predict(marked, fit(marked.where("not held_out"), sample))
