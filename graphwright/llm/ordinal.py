"""Quality grades by ordinal cumulative-link regression.

One vector of weights over hashed text features gives a text's score; ordered
thresholds cut the line of scores into grades: P(grade <= k) is the logistic
function of threshold k minus the score. The expected grade ranks texts, and
the probability of a grade or better selects them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets that features are hashed to.
BUCKETS = 1 << 17
#: Graded documents that the model is fitted on, at most (about; by hash).
GRADED = 20_000
#: Lengths of word beginnings that are features, for inflected and joined words.
PREFIXES = (5, 6, 7)
#: Sampled documents that must have a feature for it to get a weight.
SUPPORT = 5
#: Chi-squared, against the grade, that a feature needs for a weight. Chance
#: alone gives about one of a million features this much.
DEPENDENCE = 25
_PARTS = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


class _Features(dict):
    """Buckets of a word: its letters, beginnings, the marks around it, and its case."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        before, core, after = _PARTS.match(word).groups()
        own = [_bucket("w " + core.lower())] if core else []
        own += [_bucket("m " + mark) for mark in (before, after) if mark]
        own += [_bucket("p " + core[:n].lower()) for n in PREFIXES if len(core) > n]
        if len(core) > 1 and core.isupper():
            own.append(_bucket("u"))
        if len(self) >= 300_000:
            self.clear()
        if len(word) <= 64:
            self[word] = tuple(own)
        return tuple(own)


_features = _Features()


def presences(text: str) -> np.ndarray:
    """Buckets present in the whole text, each once, in order."""
    words = text.split()
    found: set[int] = set().union(*map(_features.__getitem__, set(words)))
    if words:
        # how much is repeated, in steps of a quarter of the words
        found.add(_bucket(f"r {sum(map(eq, words, words[1:])) * 4 // len(words)}"))
        found.add(_bucket(f"n {len(words).bit_length()}"))
    return np.array(sorted(found), np.int64)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than the grades

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """rows x grades"""
        z = np.clip(self.thresholds - score[:, None], -30, 30)
        upto = np.concatenate([np.zeros((len(score), 1)), 1 / (1 + np.exp(-z)), np.ones((len(score), 1))], 1)
        return np.diff(upto, axis=1)


def _train(
    rows: list[np.ndarray], grades: np.ndarray, count: int, rounds: int = 60, ridge: float = 3e-4
) -> Model:
    """Minimise the penalised mean negative log-likelihood over all sampled rows."""
    telling = _telling(rows, grades, count)
    rows = [r[telling[r]] for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate([*rows, np.zeros(0, np.int64)])
    share = np.clip(np.cumsum(np.bincount(grades, minlength=count))[:-1] / len(grades), 0.02, 0.98)
    start = np.log(share / (1 - share))
    # thresholds as a first one and the logarithms of the steps, so they stay in order
    at = np.concatenate([np.zeros(BUCKETS), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        w, steps = at[:BUCKETS], np.exp(np.clip(at[BUCKETS + 1 :], -10, 10))
        bounds = np.r_[-np.inf, at[BUCKETS] + np.r_[0, np.cumsum(steps)], np.inf]
        score = np.bincount(row, w[flat], len(rows))
        high, low = (
            1 / (1 + np.exp(-np.clip(bounds[grades + k] - score, -30, 30))) for k in (1, 0)
        )
        high, low = np.where(grades == count - 1, 1.0, high), np.where(grades == 0, 0.0, low)
        p = np.maximum(high - low, 1e-12)
        dhigh, dlow = high * (1 - high) / p / len(rows), low * (1 - low) / p / len(rows)
        slope = np.empty_like(at)
        slope[:BUCKETS] = np.bincount(flat, (dhigh - dlow)[row], BUCKETS) + ridge * w
        cut = np.bincount(grades, dlow, count + 1) - np.bincount(grades + 1, dhigh, count + 1)
        cut = cut[1:count]
        slope[BUCKETS] = cut.sum()
        slope[BUCKETS + 1 :] = np.cumsum(cut[::-1])[::-1][1:] * steps
        return -np.log(p).mean() + ridge / 2 * float(w @ w), slope

    at = _minimum(loss, at, rounds)
    steps = np.exp(np.clip(at[BUCKETS + 1 :], -10, 10))
    return Model(at[:BUCKETS], at[BUCKETS] + np.r_[0, np.cumsum(steps)])


def _telling(rows: list[np.ndarray], grades: np.ndarray, count: int) -> np.ndarray:
    """Which buckets depend on the grade: a chi-squared of at least ``DEPENDENCE``."""
    seen = np.stack(
        [
            np.bincount(np.concatenate([*(r for r, g in zip(rows, grades, strict=True) if g == k), np.zeros(0, np.int64)]), minlength=BUCKETS)
            for k in range(count)
        ]
    ).astype(float)
    size = np.bincount(grades, minlength=count)[:, None]
    support = seen.sum(0)
    expected = size * support / len(rows)
    absent = np.maximum(size - expected, 1e-9)
    chi = ((seen - expected) ** 2 * (1 / np.maximum(expected, 1e-9) + 1 / absent)).sum(0)
    return (support >= SUPPORT) & (chi >= DEPENDENCE)


def _minimum(loss, at: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    value, slope = loss(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, kept = slope.copy(), []
        for s, y in reversed(past):
            a = (s @ way) / (s @ y)
            way -= a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        step, fall = 1.0, slope @ way
        while True:
            following = at - step * way
            new, new_slope = loss(following)
            if new <= value - 1e-4 * step * fall or step < 1e-8:
                break
            step /= 2
        s, y = following - at, new_slope - slope
        if s @ y > 1e-14:
            past = [*past, (s, y)][-memory:]
        done = value - new < 1e-7
        at, value, slope = following, new, new_slope
        if done:
            break
    return at


def fit(docs: DataFrame, graded: DataFrame, sample: int = GRADED) -> Model:
    """Fit on the texts of about ``sample`` graded rows (doc_id, grade), by hash.

    Grades are integers from 0. The sampled doc_ids are broadcast, bounded by
    the parameter; executors reduce each whole text to its features. Null
    grades, doc_ids and texts are left out; a doc_id's least grade counts.
    """
    rows = (
        graded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
        .where("doc_id is not null and grade >= 0")
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
    )
    total = rows.count()
    if total > sample:
        upto = int(sample / total * (1 << 53))
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < upto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [presences(t.as_py()).astype("<u4").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.binary()), batch.column(1), batch.column(2)], ["features", "doc_id", "grade"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = (
        texts.where("text is not null")
        .join(F.broadcast(rows), "doc_id")
        .select("text", "doc_id", "grade")
        .mapInArrow(run, "features binary, doc_id long, grade int")
        .collect()
    )
    if not got:
        return Model(np.zeros(BUCKETS), np.zeros(0))
    got.sort(key=lambda r: (r.doc_id, r.features))
    grades = np.array([r.grade for r in got])
    count = max(int(grades.max()) + 1, 2)
    return _train([np.frombuffer(r.features, "<u4").astype(np.int64) for r in got], grades, count)


def grade(docs: DataFrame, model: Model, least: int | None = None) -> DataFrame:
    """docs with score, expected_grade and p_tail: the probability of ``least`` or better.

    ``least`` is the best grade unless given. A null text is an empty one.
    Columns of these names are replaced. Whole texts are read and nothing is
    shuffled. Without a fitted model the grade is 0 and p_tail 1 for all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the buckets

    @F.pandas_udf("score double, expected_grade double, p_tail double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        top = len(own.thresholds) if least is None else least
        for texts in parts:
            score = np.array([own.weights[presences(t or "")].sum() for t in texts])
            p = own.probabilities(score)
            yield pd.DataFrame(
                {"score": score, "expected_grade": p @ np.arange(p.shape[1]), "p_tail": p[:, top:].sum(1)}
            )

    columns = [c for c in docs.columns if c not in ("score", "expected_grade", "p_tail")]
    said = docs.withColumn("__said", run(F.col("text").cast("string")))
    return said.select(*columns, "__said.score", "__said.expected_grade", "__said.p_tail")


def grade_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 low quality, 1 good but toxic, 2 good."""
    good = F.col("quality").cast("int") == 1
    return labels.select(
        "doc_id", F.when(~good, 0).when(good & (F.col("toxic") == 1), 1).when(good, 2).alias("grade")
    )
