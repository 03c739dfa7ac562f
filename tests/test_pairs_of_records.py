"""Pairs of what a record names: repeated rows count once, and no record is kept to be told apart."""

from __future__ import annotations

from graphwright.operators import aggregates, records

ROWS = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "c"), (None, "a"), (None, "b")]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_co_occurring(spark):
    out = records.co_occurring(spark.createDataFrame(ROWS, "record int, object string"))
    assert sorted(map(tuple, out.collect())) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    assert "count(distinct" not in _plan(out).lower()


def test_relations(spark):
    rows = [(r, o, "x", t) for t, (r, o) in enumerate(ROWS)] + [(1, "a", "y", 99)]
    out = aggregates.relations(spark.createDataFrame(rows, "record int, account string, role string, time int"))
    got = {(r.a, r.b, r.a_role): (r.records, r.first_seen, r.last_seen) for r in out.collect()}
    assert got[("a", "b", "x")] == (2, 0, 4)
    assert got[("a", "b", "y")] == (1, 99, 99)
    assert got[("b", "c", "x")] == (1, 3, 3)
    assert "count(distinct" not in _plan(out).lower()


def test_intra_record_links(spark):
    rows = [(r, kind, v) for r, v in ROWS for kind in ("process", "terminal") if (kind == "process") == (v == "a")]
    out = records.intra_record_links(spark.createDataFrame(rows, "record int, object string, value string"))
    assert sorted(map(tuple, out.collect())) == [("ran_on", "a", "b", 2), ("ran_on", "a", "c", 1)]
    assert "count(distinct" not in _plan(out).lower()
