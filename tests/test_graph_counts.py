"""Counts of edges and nodes by brute force, with repeated evidence, and how often they shuffle it."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from graphwright.operators import aggregates, details, graph, searching


def _rows(spark):
    random.seed(5)
    rows = [(random.choice("xy"), random.randrange(4), 10 + random.randrange(4), random.choice([None, *range(6)]), random.randrange(9)) for _ in range(90)]
    return rows, spark.createDataFrame(rows, "kind string, src long, dst long, record long, time long")


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_edges_are_dealt_out_once(spark):
    rows, df = _rows(spark)
    out = aggregates.edge_summaries(df)
    want = {}
    for kind, src, dst, record, time in rows:
        want.setdefault((kind, src, dst), []).append((record, time))
    got = {(r.kind, r.src, r.dst): (r.records, r.first_seen, r.last_seen) for r in out.collect()}
    assert got == {k: (len({r for r, _ in v} - {None}), min(t for _, t in v), max(t for _, t in v)) for k, v in want.items()}
    assert _exchanges(out) == 1
    by_edge = df.select(F.concat_ws("|", "kind", "src", "dst").alias("edge"), "record", (F.col("record") % 2).alias("g"), "time")
    out = details.edge_details(by_edge, ["g"])
    assert _exchanges(out) == 1
    assert {r.edge: r.groups for r in out.collect()} == {"|".join(map(str, k)): len({None if r is None else r % 2 for r, _ in v}) for k, v in want.items()}


def test_nodes_are_dealt_out_once(spark):
    rows, df = _rows(spark)
    out = aggregates.edge_counts(df)
    want, measures = {}, {}
    for kind, src, dst, record, _ in rows:
        for node, way, other in ((src, "out", dst), (dst, "in", src)):
            for key, into in (((node, kind, way), want), (node, measures)):
                others, records = into.setdefault(key, (set(), set()))
                others.add(other)
                records.add(record)
    assert {(r.node, r.kind, r.direction): (r.n_edges, r.n_records) for r in out.collect()} == {k: (len(o), len(r - {None})) for k, (o, r) in want.items()}
    assert _exchanges(out) == 1
    out = searching.investigation_measures(df)
    assert {r.node: (r.neighbours, r.records) for r in out.collect()} == {k: (len(o), len(r - {None})) for k, (o, r) in measures.items()}
    assert _exchanges(out) == 1


def test_edges_of_several_rows_count_once(spark):
    rows, df = _rows(spark)
    edges = df.select(F.concat_ws("|", "kind", "src", "dst").alias("edge"), "kind", "src", "dst")
    nodes = spark.createDataFrame([(1,), (12,)], "node long")
    near = {(k, s, d) for k, s, d, *_ in rows if s == 1 or d == 12}
    got = {r.kind: r.n for r in searching.edge_kind_counts(edges, nodes).collect()}
    assert got == {k: len({x for x in near if x[0] == k}) for k in "xy"}
    assert {r.edge for r in graph.reached_edges(edges, nodes, 1).select("edge").collect()} == {"|".join(map(str, x)) for x in near}
