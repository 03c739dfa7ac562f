"""Formats, drive letters and meanings on hand-built rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphwright.operators import timeline
from graphwright.sources.lines import TRIALS


def test_formats(spark):
    good = "type=X msg=audit(1.0:2): a=1"
    rows = [("m", b"ElfFile\0", [good]), ("p", b"xxxxSCCA", []), ("half", b"", [good, "x"]), ("most", b"", [good, good, "x", " "]), ("bin", b"", ["\x02" + good]), ("none", b"", [])]
    files = spark.createDataFrame(rows, "source string, head binary, lines array<string>")
    found = {r.source: r.formats for r in timeline.detected_formats(files, TRIALS).collect()}
    assert found == {"m": ["event_log"], "p": ["prefetch"], "half": [], "most": ["audit"], "bin": [], "none": []}


def test_drives_need_one_root_and_one_device(spark):
    inside = r"\Windows\System32\a"
    files = spark.createDataFrame([(1, "v", inside), (1, "w", r"\x"), (2, "v", inside), (2, "w", inside), (3, "v", inside), (4, "v", None)], "collection int, device string, path string")
    roots = spark.createDataFrame([(1, "C:\\Windows\\"), (2, "C:\\Windows"), (3, "C:\\Windows"), (3, "D:\\W"), (4, None)], "collection int, root string")
    found = {(r.collection, r.device): r.drive_path for r in timeline.drive_paths(files, roots).collect()}
    assert found == {(1, "v"): "C:" + inside, (1, "w"): None, (2, "v"): None, (2, "w"): None, (3, "v"): None, (4, "v"): None}


def test_a_null_scope_falls_through(spark):
    scopes = [(F.lit(None).cast("string"), {("k", "e"): "scoped"})]
    row = spark.range(1).select(timeline.scoped_semantic(F.lit("k"), scopes, {"k": "plain"}).alias("a"), timeline.scoped_semantic(F.lit("q"), scopes, {}).alias("b")).first()
    assert tuple(row) == ("plain", None)
