"""Readers of files and sinks."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from graphwright.operators import detect, searching
from graphwright.sources import lines, structured


def test_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\r\n")
    (tmp_path / "b.log").write_bytes(b"x\ny\r\n")
    rows = {r.source.rpartition("/")[2]: r for r in lines.measured_files(spark, f"file://{tmp_path}/*.log").collect()}
    assert (rows["a.log"].ending, rows["b.log"].ending, rows["a.log"].size) == ("crlf", "mixed", 10)
    assert rows["b.log"].sha256 == hashlib.sha256(b"x\ny\r\n").hexdigest()
    got = [(r.number, r.byte_offset, r.line) for r in lines.numbered_lines(spark, f"file://{tmp_path}/a.log").orderBy("number").collect()]
    assert got == [(1, 0, "one"), (2, 5, "two")]  # a line feed at the end ends the last line
    assert lines.read_lines(spark, f"file://{tmp_path}/b.log").count() == 2


def test_numbers_over_blocks(spark, tmp_path):
    texts = [f"line {i} {'x' * (i % 37)}" + ("\r" if i % 5 == 0 else "") for i in range(500)] + ["", "é last"]
    (tmp_path / "a.log").write_bytes("\n".join(texts).encode())
    (tmp_path / "b.log").write_bytes(b"one\ntwo\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = lines.numbered_lines(spark, f"file://{tmp_path}/*.log").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want, at = [], 0
    for n, t in enumerate(texts, 1):
        want.append((n, at, t.removesuffix("\r")))
        at += len(t.encode()) + 1
    assert sorted((r.number, r.byte_offset, r.line) for r in rows if r.source.endswith("a.log")) == want
    assert sorted((r.number, r.byte_offset, r.line) for r in rows if r.source.endswith("b.log")) == [(1, 0, "one"), (2, 4, "two")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a\x01b", 1)], "t string, n int").coalesce(1)
    structured.write_json(df, f"file://{tmp_path}/j")
    (text,) = (p.read_text() for p in (tmp_path / "j").glob("part-*.json"))
    assert json.loads(text) == {"t": "a\\x01b", "n": 1}
    structured.write_csv(df, f"file://{tmp_path}/c")
    assert spark.read.csv(f"file://{tmp_path}/c", header=True).count() == 1


def test_formats(spark):
    pattern, names = structured.compiled_format("%>a [%tl] %Ss")
    assert names == ["client", "local_time", "result"]
    with pytest.raises(ValueError, match="unknown format code"):
        structured.compiled_format("%zz")
    rows = spark.createDataFrame([("1.2.3.4 [now] HIT",), ("broken",), (None,)], "line string")
    got = structured.proxy_records(rows, "%>a [%tl] %Ss").collect()
    assert [(r.failed, r.client) for r in got] == [(False, "1.2.3.4"), (True, None), (True, None)]


def test_layouts_and_times(spark):
    assert structured.compiled_format("logformat x %>a %tsabc%{X-Id}>h")[1] == ["client", "seconds", "request_header_x_id"]
    for name in structured.FORMATS:
        assert len(structured.compiled_format(name)[1]) >= 3
    squid = "1700000000.123    45 10.0.0.1 TCP_MISS/200 512 GET http://a/ u DIRECT/1.2.3.4 text/html"
    icap = "1700000000.123      3 host ICAP_MOD/200 12 REQMOD icap://s/ - -/10.0.0.2 -"
    agent = '10.0.0.1 [14/Nov/2023:22:13:20 +0900] "x y"'
    for name, line, want in (("squid", squid, ("10.0.0.1", "u")), ("icap_squid", icap, ("host", "ICAP_MOD")), ("useragent", agent, ("10.0.0.1", "x y"))):
        row = structured.proxy_records(spark.createDataFrame([(line,)], "line string"), name).first()
        assert not row.failed and set(want) <= {str(v) for v in row} and row.instant is not None
    times = {
        ("2023-11-14 22:13:20", "%F %T"): ("2023-11-14 22:13:20", False),
        ("14/Nov/2023:22:13:20 +0900", "%d/%b/%Y:%H:%M:%S %z"): ("2023-11-14 13:13:20", True),
        ("Tue Nov  4 22:13:20 2023", "%c"): ("2023-11-04 22:13:20", False),
        ("11/14/68 10:13:20 PM", "%D %r"): ("2068-11-14 22:13:20", False),
        ("1700000000", "%s"): ("2023-11-14 22:13:20", True),
        ("2023318221320", "%Y%j%H%M%S"): ("2023-11-14 22:13:20", False),
        ("2023-02-30 22:13:20", "%F %T"): (None, False),
        ("x", "%F %T"): (None, False),
    }
    for (text, fmt), want in times.items():
        time, zoned = structured.strftime_time(F.lit(text), fmt)
        got = spark.range(1).select(F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("t")).first().t
        assert (got, zoned) == want, (text, fmt)
    for bad in ("%H:%M", "%Q", "%F %I:%M:%S"):
        with pytest.raises(ValueError, match="%"):
            structured.strftime_time(F.lit(""), bad)


def test_rename(spark):
    xml = '<Event><System><Provider Name="EventLog"/><EventID>6011</EventID></System><EventData><Data Name="OldName">a</Data><Data Name="NewName">b</Data></EventData></Event>'
    events = structured.event_records(spark.createDataFrame([(xml,), ("<Event/>",)], "xml string"))
    assert [tuple(r) for r in structured.rename_of(events).collect()] == [("a", "b")]


def test_rule_folder(tmp_path, spark):
    (tmp_path / "a.yml").write_text("title: t\ndetection:\n  s: {x: 1}\n  condition: s\n")
    (tmp_path / "b.yml").write_text("title: u\n")
    rules, skipped = detect.load(str(tmp_path))
    assert [r["title"] for r in rules] == ["t"] and len(skipped) == 1
    hits, unread = detect.hits(spark.createDataFrame([(1,), (2,)], "x int"), [*rules, {"title": "v", "detection": {"s": {"y": 1}, "condition": "s"}}], ["x"])
    assert [tuple(r) for r in hits.collect()] == [(1, "t", "informational")] and unread == {"v": "field y"}


def test_diagnosis(spark):
    fields = spark.createDataFrame([("a", "X"), ("b", None)], "name string, value string")
    assert [searching.diagnosis(fields, n, t) for n, t in (("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"))] == [
        "found", "no_equal_value", "no_readable_value", "no_field"
    ]
