"""Scalar functions and the search language on hand-built rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from graphwright.functions import network, search, times, values
from graphwright.operators import detect, graph, joins
from graphwright.sources import lines


def one(spark, column, **row):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in row.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in row.values()) or (1,)], schema).select(column.alias("c")).first().c


PAIRS = [("name", "ab C"), ("size", "1" + "0" * 41), ("low", "-7.125"), ("at", "2024-05-01T10:00:00Z"), ("x.sub", "seq"), ("none", None)]


@pytest.mark.parametrize(
    ("field", "op", "want", "hit"),
    [
        ("name", "==", "Ab c", True),
        ("name", "!=", "other", True),
        ("nothing", "!=", "other", False),
        ("none", "!=", "other", False),  # a field without a value is not held
        ("none", "<", "1", False),
        ("size", ">", "9" * 41, True),
        ("size", "<", "-5", False),
        ("low", "<", "-5", True),
        ("low", "<", "-7.2", False),
        ("low", ">=", "-7.1250000000000000000000000001", True),
        ("at", ">", "2024-01-01T00:00:00Z", True),
        ("at", ">", "5", False),
        ("NAME.sub", "contains", "Q", False),
        ("sub", "contains", "Q", True),
    ],
)
def test_search(spark, field, op, want, hit):
    own = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).cast("string").alias("value")) for n, v in PAIRS))
    columns = {n: (F.lit(v).cast("string"), "string") for n, v in PAIRS}
    row = spark.range(1).select(search.compare(own, field, op, want).alias("a"), search.term(columns, field, op, want).alias("b")).first()
    assert (row.a, row.b) == (hit, hit)


def test_search_in_any_field(spark):
    own = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).cast("string").alias("value")) for n, v in PAIRS))
    columns = {n: (F.lit(v).cast("string"), "string") for n, v in PAIRS}
    for text, hit in (("B c", True), ("zz", False)):
        row = spark.range(1).select(search.mentions(own, text).alias("a"), search.mentioned(columns, text).alias("b")).first()
        assert (row.a, row.b) == (hit, hit)
    assert one(spark, search.mentions(F.lit(None).cast("array<struct<name:string,value:string>>"), "b")) is False


def test_search_errors():
    with pytest.raises(search.SearchError):
        search.term({}, "a", "=", "b")
    with pytest.raises(search.SearchError):
        search.compare(F.lit(None), "a", "==", 5)


def test_search_reaches_the_scan(spark, sf_dir, capsys):
    lines_ = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fields = search.named_fields(lines_, l_quantity="line.quantity")
    lines_.where(search.term(fields, "quantity", ">", "45.5")).select("l_orderkey").explain()
    plan = capsys.readouterr().out
    assert "GreaterThan(l_quantity,45.5" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity" in plan


def test_values(spark):
    assert one(spark, values.logon_id(F.lit("0x00AbC"))) == "0xabc"
    assert one(spark, values.logon_id(F.lit("abc"))) is None
    assert one(spark, values.logon_guid(F.lit("{0000000A-0000-0000-0000-000000000000}"))) == "0000000a-0000-0000-0000-000000000000"
    assert one(spark, values.logon_guid(F.lit("{00000000-0000-0000-0000-000000000000}"))) is None
    assert one(spark, values.same_host(F.lit("PC1.x.org"), F.lit("pc1"))) is True
    assert one(spark, values.same_host(F.lit("pc1.x.org"), F.lit("pc1.y.org"))) is False
    assert one(spark, values.sanitized(F.lit("a\x07\u0085b"))) == "a\\x07\\xc2\\x85b"
    assert one(spark, values.rounded_significant(F.lit(123456.7890123456))) == pytest.approx(123456.7890, abs=1e-9)
    assert one(spark, values.machine_accounts(F.lit("PC7$ used ADMIN$ and PC7$"))) == ["PC7$"]
    assert one(spark, values.identity_digest(F.lit("a"), F.lit("b"))) != one(spark, values.identity_digest(F.lit("ab"), F.lit("")))


def test_network(spark):
    assert one(spark, network.in_cidr(F.lit("10.1.2.3"), "10.0.0.0/8")) is True
    assert one(spark, network.in_cidr(F.lit("x"), "10.0.0.0/8")) is False
    assert one(spark, network.is_ip(F.lit("[::1]"))) is True
    assert one(spark, network.reaches_another(F.lit("169.254.3.4"))) is False


def test_times(spark):
    assert one(spark, times.access_time(F.lit("02/Jan/2024:03:04:05 +0900")).cast("timestamp_ntz")) == dt.datetime(2024, 1, 1, 18, 4, 5)
    assert one(spark, times.access_time(F.lit("02/Jan/2024:03:04:05 +2460"))) is None
    local = F.expr("TIMESTAMP_NTZ'2024-01-01 09:00:00'")
    assert one(spark, times.interpreted(local, F.lit(540))) == dt.datetime(2024, 1, 1, 0, 0)
    assert one(spark, times.interpreted(local, F.lit(1081))) is None


def test_readers(spark):
    rows = spark.createDataFrame(
        [('::1 - - [02/Jan/2024:03:04:05 +0000] "CONNECT u@h.org:443 HTTP/1.1" 200 - "-" "-"',), ("nonsense",), (None,)], "line string"
    )
    a, b, c = lines.access_records(rows).collect()
    assert (a.failed, a.host, a.port, a.no_body, a.size) == (False, "h.org", 443, True, None)
    assert b.failed and c.failed
    err = spark.createDataFrame([("[Tue Jan 02 03:04:05.000001 2024] [core:error] [pid 7:tid 8] [client 1.2.3.4:5] AH: x",)], "line string")
    e = lines.error_records(err).first()
    assert (e.failed, e.pid, e.client, e.severity, e.local_time) == (False, 7, "1.2.3.4", "error", dt.datetime(2024, 1, 2, 3, 4, 5, 1))
    audit = [(n, f"type={t} msg=audit(1700000000.123:{s}): x=1") for n, t, s in ((1, "SYSCALL", 5), (2, "PATH", 5), (3, "CWD", 6), (300, "EOE", 5))]
    got = lines.audit_events(spark.createDataFrame(audit, "number int, line string")).orderBy("serial", "event").collect()
    assert [(r.serial[-1], r.event, list(r.types)) for r in got] == [("5", 1, ["SYSCALL", "PATH"]), ("5", 300, ["EOE"]), ("6", 3, ["CWD"])]
    assert one(spark, lines.hex_text(F.lit("6C73002D6C0000"))) == "ls -l"
    args = F.create_map(F.lit("a0"), F.lit("ls"), F.lit("a1"), F.lit("-l"))
    assert one(spark, lines.command_line(args, F.lit(2))) == "ls -l"
    assert one(spark, lines.command_line(args, F.lit(3))) is None


def test_audit_events_of_long_stretches(spark):
    """Events by brute force, where the lines of a key go on for many times the distance."""
    rng = random.Random(7)
    rows = [(n, k) for k in range(4) for n in sorted(rng.sample(range(1, 4000), (900, 200, 20, 1)[k]))]
    audit = [(n, f"node=h type=T{n} msg=audit(1700000000.123:{k}): x=1") for n, k in rows] + [(5, "no key"), (None, "type=N msg=audit(1700000000.123:9): x=1")]
    want = {}
    for k in range(4):
        first = None
        for n in (n for n, own in rows if own == k):
            first = n if first is None or n - first > 256 else first
            want.setdefault((str(k), first), []).append(f"T{n}")
    got = lines.audit_events(spark.createDataFrame(audit, "number int, line string")).collect()
    assert {(r.serial[-1], r.event): list(r.types) for r in got} == want | {("9", None): ["N"]}
    assert max(len([1 for k, _ in want if k == own]) for own in "0123") > 10
    assert lines.audit_events(spark.createDataFrame([], "number int, line string")).count() == 0


def test_rules(spark):
    with pytest.raises(detect.RuleError):
        detect.compiled({"detection": {"a": {"x": 1}, "condition": "a and ("}}, ["x"])
    with pytest.raises(detect.RuleError):
        detect.compiled({"detection": {"a": {"x|base64": 1}, "condition": "a"}}, ["x"])
    for bad in ("", "b", "a b", "a and", "1 of b*", "a == a", "a(a)", "not"):
        with pytest.raises(detect.RuleError):
            detect.condition(bad, {"a": F.lit(True)})
    true, false = F.lit(True), F.lit(False)
    some = {"sel-1": true, "sel-2": false, "_own": false, "x": true}
    for text, hit in (("1 of sel-*", True), ("all of sel-*", False), ("all of them", False), ("not (sel-2 or _own) AND x", True), ("not x or sel-1", True), ("1 of _*", False)):
        assert one(spark, detect.condition(text, some)) is hit
    rule = {"detection": {"a": {"x|windash|contains": " -enc"}, "b": {"x|re|i": "SHELL"}, "condition": "all of them"}}
    row = spark.createDataFrame([("powershell /enc",), ("shell -run",), (None,)], "x string")
    assert [r.c for r in row.select(detect.compiled(rule, ["x"]).alias("c")).collect()] == [True, False, False]


def test_joins_with_nulls_and_empty(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, None, "b"), (None, 5, "c")], "k int, t int, l string")
    right = spark.createDataFrame([(1, 10, "x"), (1, 10, "y"), (1, 11, "z"), (None, 1, "n")], "k int, u int, r string")
    got = joins.asof_latest(left, right, ["k"], "t", "u").collect()
    assert sorted((r.l, r.r) for r in got) == [("a", "x"), ("a", "y")]
    assert joins.asof_latest(left, right.limit(0), ["k"], "t", "u").count() == 0
    near = joins.band_join(left, right, ["k"], F.col("t"), F.col("u"), 1)
    assert sorted((r.l, r.r) for r in near.collect()) == [("a", "x"), ("a", "y"), ("a", "z")]
    spans = spark.createDataFrame([(1, 0, 10, 7), (1, None, 3, 8)], "k int, s int, e int, v int")
    points = spark.createDataFrame([(1, 1, 2), (2, 1, 10), (3, 1, 11), (4, 2, 1), (5, 1, None)], "id int, k int, at int")
    out = joins.resolved(points, spans, ["k"], "id", "at", "s", "e", "v", bucket=4).collect()
    assert {r.id: (r.outcome, r.v) for r in out} == {
        1: ("overlapping", None), 2: ("determined", 7), 3: ("outside_range", None), 4: ("none", None), 5: ("not_comparable", None)
    }


def test_reachability_against_enumeration(spark):
    import random

    random.seed(3)
    steps = [(i, random.randrange(5), random.randrange(5), d, d + random.randrange(3)) for i, d in ((i, random.randrange(12)) for i in range(14))]
    steps = [s for s in steps if s[1] != s[2]]
    found = set()

    def walk(node, at, path):
        if node == 1 and path:
            found.update(path)
        for i, a, b, d, e in steps:
            if a == node and d >= at and i not in path:
                walk(b, e, [*path, i])

    walk(0, 0, [])
    contacts = spark.createDataFrame(steps, "contact int, src int, dst int, depart int, arrive int")
    got = {r.contact for r in graph.path_contacts(contacts, 0, 1, 0, 100).collect()}
    assert got == found


def test_arrivals_over_many_contacts(spark):
    rows = [(i, i + 1, i, i + 1) for i in range(70)]
    contacts = spark.createDataFrame(rows, "src int, dst int, depart int, arrive int").coalesce(1)
    got = {r.node: r.arrival for r in graph.earliest_arrivals(contacts, 0, 0).collect()}
    assert got == {i: i for i in range(71)}


def test_terms_on_null_columns_and_their_negation(spark):
    from functools import reduce

    from graphwright.functions import search

    rows = [("a", 5, 1.5), ("b", None, None), (None, 7, float("nan")), (None, None, None)]
    df = spark.createDataFrame(rows, "name string, n int, x double")
    fields = search.named_fields(df)
    own = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))) for c in df.columns)))
    asked = [("name", "!=", "a"), ("name", "==", "a"), ("n", "!=", "5"), ("n", ">=", "6"), ("n", "<", "6"), ("x", ">", "1"), ("none", "!=", "a")]
    columns = [search.term(fields, *t).alias(f"c{i}") for i, t in enumerate(asked)]
    records = [search.compare(own, *t).alias(f"r{i}") for i, t in enumerate(asked)]
    got = df.select(*columns, *records, *((~c).alias(f"n{i}") for i, c in enumerate(columns))).collect()
    for r in got:
        for i in range(len(asked)):
            assert r[f"c{i}"] is not None and r[f"c{i}"] == r[f"r{i}"] and r[f"n{i}"] == (not r[f"c{i}"]), (asked[i], r)
    plan = df.where(reduce(lambda a, b: a & b, [search.term(fields, "n", ">=", "6")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce" not in plan.lower()
