"""Patterns that are wrong, gated or met by hand-built rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphwright.operators import patterns
from graphwright.operators.detect import RuleError

NODES = {"a": {"kind": "n"}, "b": {"kind": "n"}, "c": {"kind": "n"}, "d": {"kind": "n"}}


@pytest.mark.parametrize(
    "edges",
    [
        {"x": {"kind": "k", "from": "a", "to": "z"}},
        {"x": {"kind": "k", "from": "a", "to": "b"}, "y": {"kind": "k", "from": "c", "to": "d"}},
    ],
)
def test_validate(edges):
    with pytest.raises(RuleError):
        patterns.validate({"nodes": NODES, "edges": edges})


def test_gate(spark):
    p = {"nodes": NODES, "edges": {}, "inputs": ["telemetry"]}
    assert patterns.matches(p, None, None, None) == (None, "input not observed: telemetry")


@pytest.mark.parametrize(
    ("spec", "hit"),
    [
        ({"eq": "C:\\Tools\\Run.exe -x"}, True),
        ({"ieq": "c:\\tools\\run.EXE -X"}, True),
        ({"in": ["q", "0x6"]}, True),
        ({"basename_in": ["RUN.exe -x"]}, True),
        ({"has_token": "-X"}, True),
        ({"has_token": "-"}, False),
        ({"prefix": "C:"}, True),
        ({"contains": "tools"}, False),
        ({"regex": "(?i)TOOLS"}, True),
        ({"mask_any": ["0x1", "0x4"]}, True),
        ({"mask_any": ["0x8"]}, False),
        ({"present": True}, True),
        ({"absent": True}, False),
    ],
)
def test_predicates(spark, spec, hit):
    values = F.array(F.lit("C:\\Tools\\Run.exe -x"), F.lit("0x6"))
    assert spark.range(1).select(patterns.predicate(spec, values).alias("c")).first().c is hit


def test_unknown_predicate():
    with pytest.raises(RuleError):
        patterns.predicate({"like": 1}, F.lit(None))


@pytest.mark.parametrize(
    ("name", "left", "right", "hit"),
    [("equal", "a b", "a b", True), ("ieq", "A b", "a B", True), ("has_token", "run a.exe /q", "A.EXE", True), ("contains", "abc", "bc", True), ("contains", "bc", "abc", False)],
)
def test_joins(spark, name, left, right, hit):
    rows = "struct<node: string, kind: string, attributes: map<string, array<string>>>"
    nodes = spark.createDataFrame([("1", "n", {"v": [None, left]}), ("2", "n", {"v": [right]})], rows)
    edges = spark.createDataFrame([("e", "k", "1", "2")], "edge string, kind string, src string, dst string")
    p = {"nodes": {"a": {"kind": "n"}, "b": {"kind": "n"}}, "edges": {"x": {"kind": "k", "from": "a", "to": "b"}}, "joins": [{name: ["a.v", "b.v"]}]}
    found, why = patterns.matches(p, nodes, edges, None)
    assert why is None and found.count() == hit


def test_evidence_in_long_form(spark):
    """Edges with their times, repeats included, give what edges and evidence of their own give; rows no role can hold are left out early."""
    kind = "struct<node: int, kind: string, attributes: map<string, array<string>>>"
    nodes = spark.createDataFrame([(i, "bps"[i % 3], {"v": [str(i % 4)]}) for i in range(30)], kind)
    rows = [(("placed", "supplied")[i % 2], (3 * (i // 2) + 2 * (i % 2)) % 30, 3 * (i // 3 * 7 % 10) + 1, i * 13 % 40) for i in range(120)]
    rows += rows[:40] + [("other", 0, 1, 5), ("placed", 0, None, 5), ("placed", None, 1, 5), ("placed", 0, 1, None)]
    long = spark.createDataFrame(rows, "kind string, src int, dst int, time long")
    pattern = {
        "nodes": {"b": {"kind": "b"}, "p": {"kind": "p", "where": {"v": {"in": ["0", "1", "2"]}}}, "s": {"kind": "s", "where": {"v": {"present": True}}}, "t": {"kind": "s"}},
        "edges": {"x": {"kind": "placed", "from": "b", "to": "p"}, "y": {"kind": "supplied", "from": "s", "to": "p"}, "z": {"kind": "supplied", "from": "t", "to": "p"}},
        "distinct": [["s", "t"]],
        "joins": [{"equal": ["b.v", "s.v"]}],
        "order": [{"before": ["y", "z"], "within": 20}],
    }
    keyed = long.withColumn("edge", F.struct("kind", "src", "dst"))
    want, _ = patterns.matches(pattern, nodes, keyed.select("edge", "kind", "src", "dst").distinct(), keyed.select("edge", "time").distinct())
    found, why = patterns.matches(pattern, nodes, long, None)
    assert why is None and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []
    only = patterns._possible(pattern, lambda r: nodes.where(F.col("node") == 1).select(F.col("node").alias(r)), long)
    assert {r.dst for r in only.collect()} == {1} and {r.kind for r in only.collect()} <= {"placed", "supplied"}
