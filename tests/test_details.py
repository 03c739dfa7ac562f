"""Traversal, routes, rule targets, intervals and details on hand-built rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphwright.functions import network
from graphwright.operators import details, detect, graph, joins, logsource


def test_relayed_terminals(spark):
    edges = spark.createDataFrame(
        [("e1", "ran_on", "p", "t"), ("e2", "record_names_object", "r1", "t"), ("e3", "record_names_object", "r2", "t"), ("e4", "ran_on", "q", "t"), ("e5", "other", None, "t")],
        "edge string, kind string, src string, dst string",
    )
    nodes = spark.createDataFrame([("p", "process"), ("q", "process"), ("t", "terminal"), ("r1", "record"), ("r2", "record")], "node string, node_kind string")

    def search(origin: str, depth: int):
        found, seen = graph.expanded(edges, nodes, spark.createDataFrame([(origin,)], "node string"), depth)
        return {r.edge for r in found.collect()}, {r.node: r.hops for r in seen.collect()}

    assert search("t", 1) == ({"e1", "e2", "e3", "e4"}, {"t": 0, "p": 1, "q": 1, "r1": 1, "r2": 1})
    assert search("p", 2) == ({"e1", "e4"}, {"p": 0, "t": 1, "q": 2})
    assert search("r1", 2) == ({"e1", "e2", "e4"}, {"r1": 0, "t": 1, "p": 2, "q": 2})
    assert search("p", 0) == (set(), {"p": 0})
    assert search("nowhere", 3) == (set(), {"nowhere": 0})
    with pytest.raises(ValueError, match="depth"):
        search("p", 9)


def test_earliest_route_against_enumeration(spark):
    rng = random.Random(4)
    for _ in range(3):
        steps = [(i, rng.randrange(6), rng.randrange(6), d, d + rng.randrange(3)) for i, d in ((i, rng.randrange(12)) for i in range(16))]
        steps = [s for s in steps if s[1] != s[2]]
        best: dict[int, int] = {}

        def walk(node, at, used, steps=steps, best=best):
            best[node] = min(best.get(node, at), at)
            for i, a, b, d, e in steps:
                if a == node and d >= at and i not in used:
                    walk(b, e, used | {i})

        walk(0, 0, frozenset())
        contacts = spark.createDataFrame(steps, "contact int, src int, dst int, depart int, arrive int")
        by_id = {s[0]: s for s in steps}
        for target in range(1, 6):
            route = graph.earliest_route(contacts, 0, target, 0, 100)
            assert bool(route) == (target in best)
            node, at = 0, 0
            for c in route:
                _, a, b, d, e = by_id[c]
                assert a == node and d >= at
                node, at = b, e
            if route:
                assert (node, at) == (target, best[target])
                assert graph.earliest_route(contacts, 0, target, 0, best[target] - 1) == []


def test_alternatives_are_no_way(spark):
    rows = [(1, "a", "r", 0, 1), (2, "b", "r", 0, 1), (3, "r", "b", 2, 3), (4, "r", "x", 2, 3), (5, "a", "s", 0, 1), (6, "s", "y", 2, 3)]
    contacts = spark.createDataFrame(rows, "contact int, src string, dst string, depart int, arrive int")
    sends = spark.createDataFrame([(1, "r", "a"), (2, "r", "b"), (5, "s", "a")], "contact int, record string, candidate string")
    split = graph.separated(contacts, sends, spark.createDataFrame([(3,)], "contact int"), "a", "y")
    got = {r.node for r in graph.earliest_arrivals(split, "a", 0).collect()}
    assert got == {"a", "r#a", "x", "s", "y"}


@pytest.mark.parametrize("bucket", [1, 3, 50])
def test_intervals_of_any_length(spark, bucket):
    rng = random.Random(bucket)
    points = [(i, rng.randrange(3), rng.choice([None, rng.randrange(-500, 5000)])) for i in range(150)]
    spans = []
    for i in range(120):
        lo = rng.randrange(-1000, 5000)
        hi = lo + rng.choice([0, 1, 5, 100, 700, 4000, -3])
        spans.append((i, rng.randrange(3), rng.choice([lo, lo, None]), rng.choice([hi, hi, None])))
    got = joins.interval_candidates(
        spark.createDataFrame(points, "p int, k int, at long"), spark.createDataFrame(spans, "s int, k int, lo long, hi long"), ["k"], "at", "lo", "hi", bucket
    )
    want = {
        (p, s) for p, k, at in points for s, j, lo, hi in spans
        if k == j and at is not None and (lo is None or lo <= at) and (hi is None or at <= hi)
    }
    rows = [(r.p, r.s) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_overlapping_spans(spark):
    rng = random.Random(3)
    a = [(i, rng.randrange(2), lo, lo + rng.choice([0, 3, 400])) for i, lo in ((i, rng.randrange(900)) for i in range(60))]
    b = [(i, rng.randrange(2), lo, lo + rng.choice([0, 3, 400])) for i, lo in ((i, rng.randrange(900)) for i in range(60))]
    got = joins.overlapping(
        spark.createDataFrame(a, "a int, k int, a0 long, a1 long"), spark.createDataFrame(b, "b int, k int, b0 long, b1 long"), ["k"], ("a0", "a1"), ("b0", "b1"), 4
    )
    rows = [(r.a, r.b) for r in got.select("a", "b").collect()]
    assert sorted(rows) == sorted((i, j) for i, k, x, y in a for j, m, u, v in b if k == m and x <= v and u <= y)


def test_addresses(spark):
    cases = {
        "::1": "0" * 31 + "1", "2001:DB8::ff00:42:8329": "20010db8000000000000ff0000428329", "1:2:3:4:5:6:7:8": "00010002000300040005000600070008",
        "[fe80::1]": "fe80" + "0" * 27 + "1", "1:2:3": None, "1::2::3": None, ":::": None, "12345::": None, "10.0.0.1": None, "::": "0" * 32,
        "1:2:3:4:5:6:7:8:9": None, "1:2:3:4:5:6:7:": None, "": None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", network.ipv6(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases
    assert spark.range(1).select(network.in_cidr(F.lit("::1"), "0.0.0.0/0").alias("x")).first().x is False
    assert spark.range(1).select(network.in_cidr(F.lit("10.1.2.3"), "::/0").alias("x")).first().x is False
    assert spark.range(1).select(network.in_cidr(F.lit("ff02::5"), "ff00::/8").alias("x")).first().x is True


def test_rule_targets():
    for bad in ({}, {"product": "linux"}, {"product": "windows"}, {"product": "windows", "service": "nothing"}, {"product": "windows", "category": "nothing"},
                {"product": "windows", "category": "ps_script", "service": "security"}):
        with pytest.raises(logsource.SourceError):
            logsource.targets(bad)
    both = logsource.targets({"product": "Windows", "category": "process_creation"})
    assert [(t.service, t.event_ids) for t in both] == [("sysmon", ("1",)), ("security", ("4688",))]
    assert [t.service for t in logsource.recorded(both, {"Image", "CommandLine", "EventID"})] == ["sysmon", "security"]
    assert [t.service for t in logsource.recorded(both, {"Image", "OriginalFileName"})] == ["sysmon"]
    with pytest.raises(logsource.SourceError, match="Hashes"):
        logsource.recorded(both[1:], {"Hashes"})
    with pytest.raises(detect.RuleError, match="logsource"):
        detect.targeted({"logsource": {}, "detection": {"a": {"x": 1}, "condition": "a"}}, ["x"], F.lit("s"), F.lit("1"))


def test_choices_are_checked():
    assert details.selected_conditions([("second_of_time", 3), ("destination_ip", 0)]) == {"destination_ip": 0, "second_of_time": 3}
    for bad in ([("nothing", 0)], [("process", 0), ("process", 0)], [("process", 2)], [("second_of_time", -1)]):
        with pytest.raises(ValueError, match="condition|tolerance"):
            details.selected_conditions(bad)
    details.checked_search(["a"] * 16, list(range(32)), 8)
    for bad in ((["a"] * 17, [], 0), (["a" * 1025], [], 0), ([], list(range(33)), 0), ([], [], 9)):
        with pytest.raises(ValueError, match="up to|depth"):
            details.checked_search(*bad)
    with pytest.raises(ValueError, match="outcome"):
        details.match_outcome((F.lit(True), "nothing"))


def test_outcomes_and_names(spark):
    tried = spark.createDataFrame([(1, "no_candidate_record"), (1, "matched"), (2, "own"), (2, "no_candidate_record"), (3, "own")], "origin int, outcome string")
    assert {r.origin: r.outcome for r in details.best_outcomes(tried).collect()} == {1: "matched", 2: "no_candidate_record", 3: "own"}
    names = [("a.exe", "A.dll", False), ("a.b.exe", "a.exe", True), (" ", "a", False), (None, "a", False), ("x", "y", True)]
    rows = spark.createDataFrame(names, "n string, o string, d boolean")
    assert all(r.d == r.x for r in rows.select("d", details.original_name_differs(F.col("n"), F.col("o")).alias("x")).collect())
    both = spark.createDataFrame([(c, f) for c in (True, False) for f in (True, False)], "c boolean, f boolean")
    steps = [details.step_predicate(F.col("c"), F.col("f"), only) for only in (True, False)]
    assert {tuple(r) for r in both.select("c", "f", *steps).collect()} == {(c, f, f, c and f) for c in (True, False) for f in (True, False)}


def test_headers_without_numbers(spark):
    rows = spark.createDataFrame([("a", "5"), ("a", "x"), ("b", None)], "source string, number string")
    heads = spark.createDataFrame([("a", "6"), ("b", "1"), ("c", None)], "source string, next string")
    got = {r.source: (r.highest, r.unreadable, r.comparison) for r in details.header_comparison(rows, heads).collect()}
    assert got == {"a": (5, 1, "agrees"), "b": (None, 1, "no_record_numbers"), "c": (None, 0, "unreadable")}
