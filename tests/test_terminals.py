"""Imports of folders, profiles, digests of collections and knowledge of names."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphwright.operators import details, meanings, profiles, records
from graphwright.sources import imports, lines, structured

ACCESS = '10.0.0.1 - u [14/Nov/2023:22:13:20 +0000] "GET / HTTP/1.1" 200 5'


def folder(tmp_path):
    below = tmp_path / "logs" / "deep"
    below.mkdir(parents=True)
    files = {
        "a.log": (ACCESS + "\n") * 3,
        "deep/b +%41.log": ACCESS + "\nbroken\n\n" + ACCESS + "\n",
        "audit.log": "type=SYSCALL msg=audit(1700000000.123:7): x=1\n" * 5,
        "empty.log": "",
        "note.txt": "only words\nof a note\n",
        "SYSTEM": b"regf" + bytes(500),
        "SYSTEM.LOG1": b"regf" + bytes(100),
        "SYSTEM.LOG2": "",
        "deep/SAM.LOG2": b"regf" + bytes(9),
        "x.zip": b"PK\x03\x04" + bytes(30),
        "db": b"SQLite format 3\0" + bytes(30),
        "ese.dat": b"\0\0\0\0\xef\xcd\xab\x89" + bytes(30),
        "odd.bin": bytes(range(256)),
    }
    for name, text in files.items():
        (tmp_path / "logs" / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{tmp_path}/logs"


def test_import(spark, tmp_path):
    top = folder(tmp_path)
    formats = imports.registry(imports.FORMATS)
    plan = {r.source.partition("/logs/")[2]: (r.format, r.reason, r.detected) for r in imports.planned(spark, top, formats).collect()}
    assert plan == {
        "a.log": ("access", None, None),
        "deep/b +%41.log": ("access", None, None),
        "audit.log": ("audit", None, None),
        "empty.log": (None, "empty_file", None),
        "note.txt": (None, "unsupported_format", "text"),
        "SYSTEM": ("registry", "no_reader", None),
        "deep/SAM.LOG2": ("registry", "companion_without_main", None),
        "x.zip": (None, "unsupported_format", "zip"),
        "db": (None, "unsupported_format", "sqlite"),
        "ese.dat": (None, "unsupported_format", "ese"),
        "odd.bin": (None, "unsupported_format", None),
    }
    status, read = imports.imported(spark, top, formats)
    got = {r.source.partition("/logs/")[2]: (r.state, r.read, r.succeeded, r.failed, r.reason) for r in status.collect()}
    assert got["a.log"] == ("published_full", 3, 3, 0, None)
    assert got["deep/b +%41.log"] == ("published_partial", 3, 2, 1, None)
    assert got["audit.log"] == ("published_full", 5, 5, 0, None)
    assert got["note.txt"] == ("skipped", 0, 0, 0, "unsupported_format")
    assert sorted(read) == ["access", "audit"] and read["access"].where("client = '10.0.0.1'").count() == 5
    # heads of files over the limit come from their first lines, with the same result
    small = {r.source: (bytes(r.head[:4]), len(r.lines)) for r in imports.heads(spark, top, small=10).collect() if r.source.endswith(".log")}
    assert {k.rpartition("/")[2]: v for k, v in small.items()} == {"a.log": (b"10.0", 3), "b +%41.log": (b"10.0", 4), "audit.log": (b"type", 5)}


def test_registry():
    form = imports.Format("x", ".")
    for bad in ((), ((form, form),), ((imports.Format("", "."),),), ((imports.Format("y"),),)):
        with pytest.raises(ValueError):
            imports.registry(*bad)


def test_one_item_layouts(spark):
    rows = spark.createDataFrame([("a b",), ("a",), ("\x01\x02a",), ("",), (None,)], "line string")
    got = [(r.failed, r.target) for r in structured.proxy_records(rows, "%ru").collect()]
    assert got == [(True, None), (False, "a"), (True, None), (False, ""), (True, None)]
    time, _ = structured.strftime_time(F.lit("x"), "%s")
    assert spark.range(1).select(time).first()[0] is None
    parts = rows.select(lines.line_parts(F.col("line"), r"^(\w+) (\w+)?$", 2).alias("p")).collect()
    assert [r.p for r in parts] == [["a", "b"], None, None, None, None]


def tree(members, leaf, depth=0):
    if len(members) <= leaf:
        return hashlib.sha256("\n".join(sorted(members)).encode()).hexdigest()
    if len(set(members)) == 1:
        return hashlib.sha256(f"{members[0]} {len(members)}".encode()).hexdigest()
    groups = {}
    for m in members:
        groups.setdefault(m[depth : depth + 1], []).append(m)
    text = "\n".join(f"{d} {tree(own, leaf, depth + 1)}" for d, own in sorted(groups.items()))
    return hashlib.sha256(text.encode()).hexdigest()


def test_collection_digests(spark):
    rng = random.Random(31)
    some = lambda n: [hashlib.sha256(str(rng.random()).encode()).hexdigest() for _ in range(n)]
    groups = {"small": some(3), "wide": some(300), "copies": some(1) * 40 + some(2), "both": some(1) * 9 + some(60), "alike": ["ab" + x for x in some(30)] + ["ab"]}
    rows = [(c, m) for c, ms in groups.items() for m in ms]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "collection string, sha256 string")
    for leaf in (4, 16, 1000):
        got = {r.collection: r.terminal for r in records.collection_terminals(df, leaf).collect()}
        assert got == {c: tree(ms, leaf) for c, ms in groups.items()}
    assert records.collection_terminals(df.limit(0)).collect() == []


def test_profiles(spark):
    at = r"\ControlSet001\Services\Tcpip\Parameters\Interfaces\{A}"
    rows = [
        ("t", 1, r"\select", "Current", "1 (0x1)"),
        ("t", 2, at.lower(), "DhcpIPAddress", "10.0.0.5 0.0.0.0 10.0.0.6"),
        ("t", 2, at.lower(), "LeaseObtainedTime", "1000 (0x3e8)"),
        ("t", 3, at.replace("001", "002"), "IPAddress", "10.9.9.9"),
        ("t", 4, r"\Microsoft\Windows NT\CurrentVersion", "ProductName", "System"),
        ("t", 4, r"\Microsoft\Windows NT\CurrentVersion", "CurrentBuild", "19045"),
        ("t", 4, r"\Microsoft\Windows NT\CurrentVersion", "UBR", "7 (0x7)"),
        ("t", 4, r"\Microsoft\Windows NT\CurrentVersion\Sub", "ProductName", "no"),
        ("u", 5, r"\Select", "Current", "1"),
        ("u", 6, r"\Select", "Current", "2"),
        ("u", 7, at, "IPAddress", "10.0.0.7"),
        ("v", 8, r"\Select", "Current", "99999999999"),
    ]
    values = spark.createDataFrame(rows, "terminal string, record int, path string, name string, value string")
    last = spark.createDataFrame([("t", 5000)], "terminal string, last long")
    assert [tuple(r) for r in profiles.control_sets(values).collect()] == [("t", "controlset001")]
    got = {tuple(r) for r in profiles.leases(values, last).collect()}
    assert got == {("t", "{a}", 2, "DhcpIPAddress", ip, 1000, 5000) for ip in ("10.0.0.5", "10.0.0.6")}
    facts = spark.createDataFrame([("t", 1, ["x"]), ("w", 2, []), ("x", 3, ["y"])], "terminal string, record int, categories array<string>")
    assert {tuple(r) for r in profiles.summaries(values, facts).collect()} == {("t", "System 19045.7", 1, 1), ("u", "", 0, 0), ("v", "", 0, 0), ("x", "", 1, 1)}


def test_condition_trail_against_pairs(spark):
    rng = random.Random(32)
    pick = lambda n: rng.choice([*range(n), None])
    origins = [(i, pick(9), pick(3), rng.choice([None, rng.randrange(100)])) for i in range(60)]
    candidates = [(pick(5), pick(4), rng.choice([None, rng.randrange(100)])) for _ in range(200)]
    got = details.condition_trail(
        spark.createDataFrame(origins, "o int, a int, b int, t int"),
        spark.createDataFrame(candidates, "x int, y int, u int"),
        "o", [("first", "a", "x"), ("second", "b", "y")], ("t", "u"), 5,
    ).collect()
    want = set()
    for o, a, b, t in origins:
        tests = [lambda c: True, lambda c, a=a: c[0] == a and a is not None, lambda c, b=b: c[1] == b and b is not None,
                 lambda c, t=t: t is not None and c[2] is not None and abs(c[2] - t) <= 5]
        left, before, known = candidates, 1, [True, a is not None, a is not None and b is not None, None not in (a, b, t)]
        for stage, (name, test) in enumerate(zip(("all", "first", "second", "time"), tests, strict=True)):
            left = [c for c in left if test(c)]
            state = "kept" if left else "unread" if not known[stage] else "emptied" if before else "empty"
            want.add((o, stage, name, len(left), state))
            before = len(left)
    assert {tuple(r) for r in got} == want and len(got) == 4 * len(origins)
    assert set(Counter(r.state for r in got)) == {"kept", "unread", "emptied", "empty"}


def test_names():
    assert meanings.field_name("Provider_Name") == "Provider@Name" and meanings.field_name("Image") == "EventData.Image"


def test_terms_in_three_values(spark):
    rows = [(["EventData.Image"], "x", "p", 1), (["EventData.Other"], "x", "p", 1), (["EventData.Data"], meanings.RENDERED, "p", 1), (["EventData.Image"], "x", "p", None)]
    df = spark.createDataFrame(rows, "names array<string>, form string, provider string, v int")
    term = meanings.when_known("Image", F.col("v") == 1, F.col("names"), F.col("form"), F.col("provider"))
    assert [tuple(r) for r in df.select(term, ~term).collect()] == [(True, False), (False, True), (None, None), (False, True)]
