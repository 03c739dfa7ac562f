"""Embedding near-duplicates, quality rules and quality grades."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphwright.llm import embedding, ordinal, quality
from graphwright.llm.common import merged


def brute(rows, least=0.9):
    n = len(rows)
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = np.arange(n), np.zeros(n, int)
    for p, i in enumerate(ok):
        for j in ok[p + 1 :]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links[[i, j]] += 1
                root = merged(root, np.array([i]), np.array([j]))
    for i, (k, _) in enumerate(rows):
        for j in ok:
            if rows[j][0] == k and i in ok:  # rows with one id are one vertex
                root = merged(root, np.array([i]), np.array([j]))
    least_id = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least_id[root[i]] = min(k, least_id.get(root[i], k))
    return Counter((k, links[i], None if k is None else least_id[root[i]], k is not None and least_id[root[i]] == k) for i, (k, _) in enumerate(rows))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 24))
    rows = []
    for i in range(150):
        v = centres[i % 12] + rng.normal(size=24) * 0.28 * (i % 4)
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(200 + i, rows[5][1]) for i in range(20)]
    rows += [(300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [None] * 24), (304, [1.0, 2.0]), (305, [2.0, 4.0]), (306, []), (None, rows[5][1]), (307, [float("inf")] * 24)]
    return rows


@pytest.mark.parametrize("piece", [6, 1500])
def test_embedding(spark, vectors, piece):
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in vectors], "vec_id long, embedding array<float>, label int, n int")
    got = embedding.near_duplicates(df, piece=piece).collect()
    assert Counter(map(tuple, got)) == brute(vectors)


def test_embedding_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding.near_duplicates(df).collect() == []


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(embedding.hadamard(x), axis=1), 4 * np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("hashes", [2, 3, 4])
def test_recall(hashes):
    """Pairs at the least cosine meet in some table in at least 98 of 100 cases, sketches too."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(0.19) * g / np.linalg.norm(g, axis=1, keepdims=True)
    (a, sa), (b, sb) = (embedding.coded(v, embedding.tables_for(hashes), hashes) for v in (x, y))
    met = ((a[:, :, :1] == b) | False).any(2) | (b[:, :, :1] == a).any(2)
    near = np.bitwise_count(sa ^ sb).sum(1) <= embedding.sketch_budget(64, 0.9)
    assert (met.any(1) & near).mean() >= 0.98


def test_hashes_grow_with_the_table():
    assert [embedding.hashes_for(n, 64) for n in (0, 100_000, 1_000_000, 1_000_000_000)] == [2, 2, 3, 4]


@pytest.mark.parametrize("piece", [8, 1500])
def test_embedding_ties(spark, piece):
    """Binary, one-hot, small-integer and scaled vectors, and rows that share an id."""
    rng = np.random.default_rng(5)
    rows = []
    for v in rng.choice([-1.0, 1.0], (40, 24)):
        flipped = v.copy()
        flipped[rng.integers(24)] *= -1
        rows += [v, 3 * v, 0.1 * v, flipped]
    rows += [s * np.eye(24)[i] for i in range(24) for s in (1.0, 5.0, 1e200, 1e-200)]
    rows += [u + (k == 2) * rng.integers(-9, 10, 24) for u in rng.integers(-127, 128, (20, 24)) for k in range(3)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    rows += [(5, rows[1][1]), (0, rows[200][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(map(tuple, embedding.near_duplicates(df, piece=piece).collect()))
    unit = [(k, list(np.array(v) / np.abs(v).max())) for k, v in rows]
    assert got == brute(unit)


def stats(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update(range(i, i + 8))
    own = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(own) - len(set(own)),
        len(covered),
    )


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_statistics(which, request):
    docs = request.getfixturevalue(which)
    got = quality.statistics(docs).collect()
    want = Counter((r.doc_id, *stats(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_rules_learn(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(("".join(rng.choice(list("abcdef"), 5)) + ("%%" if bad else "")) for _ in range(40))
        rows.append((i, text, 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out, rules = quality.quality_rules(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert rules and all("%" not in str(r) for r in rules)
    assert {(r.doc_id % 4 == 0, r.kept) for r in out.collect()} == {(True, False), (False, True)}
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_odd(odd, empty, spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 0), (5, 1)], "doc_id long, quality int")
    out, rules = quality.quality_rules(odd, labels)
    assert rules == []
    assert Counter((r.doc_id, r.base_failed, r.kept) for r in out.collect())[5, False, True] == 1
    assert quality.quality_rules(empty, labels)[0].collect() == []
    assert quality.quality_rules(odd, labels.limit(0))[1] == []


def test_grades(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        words = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(30)]
        grade = i % 3
        if grade == 0:
            words = [w + "!!" for w in words]
        if grade == 1:
            words[7] = "horrid"
        rows.append((i, " ".join(words), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = ordinal.fit(df, df.where("doc_id < 600").select("doc_id", "grade"))
    assert (np.diff(model.thresholds) > 0).all()
    out = ordinal.grade(df.withColumn("score", F.lit(1)), model).where("doc_id >= 600").collect()
    right = sum(round(r.expected_grade) == r.grade for r in out) / len(out)
    assert right > 0.9 and all((r.p_tail >= 0.5) == (r.grade == 2) for r in out if round(r.expected_grade) == r.grade)


def test_grade_gradient():
    """The loss falls to a point where small steps do not lower it."""
    rows = [np.array([1, 2]), np.array([2, 3]), np.array([3])] * 40
    grades = np.array([0, 1, 2] * 40)
    model = ordinal._train(rows, grades, 3)
    p = model.probabilities(np.array([model.weights[r].sum() for r in rows[:3]]))
    assert p.argmax(1).tolist() == [0, 1, 2] and np.allclose(p.sum(1), 1)


def test_grades_odd(odd, empty, spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, grade int")
    model = ordinal.fit(odd, none)
    assert {(r.expected_grade, r.p_tail) for r in ordinal.grade(odd, model).collect()} == {(0.0, 1.0)}
    assert ordinal.grade(empty, model).collect() == []
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (8, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.grade) for r in ordinal.grade_of_labels(labels).collect()} == {(1, 2), (5, 0), (8, 1), (9, None)}
    model = ordinal.fit(odd, ordinal.grade_of_labels(labels))
    assert ordinal.grade(odd, model).count() == odd.count()


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_rules_decide_as_written(labelled):
    """kept of each document, by the learned rules in plain Python."""
    docs, labels = labelled
    out, rules = quality.quality_rules(docs, labels)
    kept = {r.doc_id: (r.kept, r.base_failed) for r in out.collect()}
    assert rules
    for r in quality.with_features(quality.statistics(docs)).collect():
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        low = any(
            all(r[c.feature] is not None and ((r[c.feature] > c.threshold) == c.above) for c in rule.conditions) for rule in rules
        )
        assert kept[r.doc_id] == (not failed and not low, failed)


def test_grades_of_labels_held_out(labelled):
    """Fitted on one half of the labels, the other half is told apart."""
    docs, labels = labelled
    grades = ordinal.grade_of_labels(labels)
    model = ordinal.fit(docs.where("doc_id % 2 = 0"), grades.where("doc_id % 2 = 0"))
    said = {r.doc_id: r.p_tail >= 0.5 for r in ordinal.grade(docs.select("doc_id", "text"), model).collect()}
    own = [r for r in labels.collect() if r.doc_id % 2 and r.doc_id in said]
    good = [said[r.doc_id] for r in own if r.quality == 1 and not r.toxic]
    low = [not said[r.doc_id] for r in own if r.quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(low) >= 0.9 * len(low)
