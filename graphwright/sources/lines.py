"""Readers of line-oriented logs: access, error, audit and key=value lines.

Each reader takes a DataFrame with a column of lines and gives typed columns;
a line that does not parse has ``failed`` true and nulls, and stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.network import is_ip
from ..functions.times import access_time, audit_time, header_time
from ..plans.storage import written

_ACCESS = (
    r'^(\S+) (\S+) (\S+) \[([^\]]*)\] "((?:[^"\\]|\\.)*)" (\S+) (\S+)'
    r'(?: "((?:[^"\\]|\\.)*)" "((?:[^"\\]|\\.)*)")?(?: ([A-Z_]+):([A-Z_]+))?\s*$'
)
_ERROR = r"^\[([^\]]+)\] \[([^:\]]*):([^\]]+)\] \[pid (\d+)(?::tid (\d+))?\](?: \[client ([^\]]+):(\d+)\])? (.*)$"
#: Expressions that tell the formats of lines apart.
TRIALS = {"access": _ACCESS, "error": _ERROR, "audit": r"\bmsg=audit\(\d+\.\d+:\d+\)"}


#: Before the parts of a line while it is taken apart, and between them; a line that holds it fails.
_CUT = "\x01\x02"


def line_parts(line: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern for a whole line, as an array of texts; null where it fails.

    One pass of the expression over the line; groups that take no part are
    empty. A line that fails stays as it is and so begins with no mark.
    """
    marked = F.regexp_replace(line, pattern, _CUT + _CUT.join(f"${i}" for i in range(1, groups + 1)))
    parts = F.split(marked, _CUT)
    return F.when(F.startswith(marked, F.lit(_CUT)) & (F.size(parts) == groups + 1) & ~F.contains(line, F.lit(_CUT)), F.slice(parts, 2, groups))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line) of text files; the order of lines is not kept across splits."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, number, byte_offset, line) of text files of any size: for positions in a file.

    Files are read in blocks. Lines are numbered within their block, and blocks
    by the lines and bytes of those before them.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at")
    )
    size = F.octet_length("value") + 1
    in_block = Window.partitionBy("source", "block").orderBy("at")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, -1)
    own = lines.withColumns({"n": F.row_number().over(in_block), "b": F.coalesce(F.sum(size).over(so_far), F.lit(0))})
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("source", "block").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    starts = blocks.select("source", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "b")))
    return own.join(starts, ["source", "block"]).select(
        "source", (F.col("n") + F.col("n_before")).alias("number"), (F.col("b") + F.col("b_before")).alias("byte_offset"), F.regexp_replace("value", "\r$", "").alias("line")
    )


def measured_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, sha256, size, line_feeds, ending) of whole files."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "ISO-8859-1")
    lf, crlf = F.regexp_count(text, F.lit("\n")), F.regexp_count(text, F.lit("\r\n"))
    ending = F.when(lf == 0, "undetermined").when(crlf == 0, "lf").when(crlf == lf, "crlf").otherwise("mixed")
    return files.select(
        F.col("path").alias("source"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), lf.alias("line_feeds"), ending.alias("ending")
    )


def _absent(c: Column) -> Column:
    return F.when((c != "-") & (c != ""), c)


def _unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r'\\(["\\])', "$1")


def request_target(target: Column, method: Column) -> dict[str, Column]:
    """scheme, host and port of a request target; the scheme's port where none is given.

    CONNECT has host:port; error: targets and relative ones have no authority.
    User names before the last @ are left out, brackets of IPv6 hosts too.
    """
    parts = F.split(F.regexp_replace(target, r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*))?.*$", f"$1{_CUT}$2"), _CUT)
    scheme = F.lower(F.get(parts, F.lit(0)))
    authority = F.when(method == "CONNECT", target).when(scheme != "", F.get(parts, F.lit(1)))
    place = F.substring_index(authority, "@", -1)
    host = F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1)
    port = F.regexp_extract(place, r":(\d+)$", 1)
    bare = F.regexp_replace(host, r"^\[|\]$", "")
    # fixed values: ports of the two schemes
    default = F.when(scheme == "http", 80).when(scheme == "https", 443)
    return {
        "host": F.when(bare != "", F.lower(bare)),
        "port": F.coalesce(F.when(port != "", port.cast("int")), default),
        "host_kind": F.when(bare != "", F.when(is_ip(host), "address").otherwise("hostname")),
    }


def access_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Columns of combined access-log lines, with the proxy's result codes if any."""
    names = ("client", "ident", "user", "time", "request", "status", "size", "referer", "agent", "result", "hierarchy")
    lines = lines.withColumn("__parts", line_parts(F.col(line), _ACCESS, len(names)))
    part = {k: F.get("__parts", F.lit(i)) for i, k in enumerate(names)}
    lines = lines.withColumn("instant", access_time(part["time"]))
    request = _unescaped(part["request"])
    words = F.split(request, " ")
    method, target = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    out = lines.withColumns(
        {
            "failed": F.col("instant").isNull(),
            "client": _absent(part["client"]),
            "user": _absent(part["user"]),
            "method": _absent(method),
            "target": target,
            "version": F.get(words, F.lit(2)),
            "status": F.try_to_number(part["status"], F.lit("999")).cast("int"),
            "size": F.when(part["size"].rlike(r"^\d+$"), part["size"].cast("long")),
            "no_body": F.coalesce(part["size"] == "-", F.lit(False)),
            "referer": _absent(_unescaped(part["referer"])),
            "agent": _absent(_unescaped(part["agent"])),
            "result": _absent(part["result"]),
            "hierarchy": _absent(part["hierarchy"]),
        }
    )
    return out.withColumns(request_target(F.col("target"), F.col("method"))).drop("__parts")


def error_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Columns of server error-log lines; the time is local, without an offset."""
    lines = lines.withColumn("__parts", line_parts(F.col(line), _ERROR, 8))
    part = [F.get("__parts", F.lit(i)) for i in range(8)]
    local = F.try_to_timestamp(F.regexp_replace(part[0], "^[A-Za-z]{3} ", ""), F.lit("MMM dd HH:mm:ss.SSSSSS yyyy")).cast("timestamp_ntz")
    return lines.withColumns(
        {
            "failed": local.isNull(),
            "local_time": local,
            "module": _absent(part[1]),
            "severity": _absent(part[2]),
            "pid": F.when(part[3] != "", part[3].cast("long")),
            "client": _absent(part[5]),
            "client_port": F.when(part[6] != "", part[6].cast("int")),
            "message": part[7],
        }
    ).drop("__parts")


def key_values(text: Column) -> Column:
    """Map of key=value parts; quoted values double their quotes; the first of a key counts."""
    pattern = F.lit(r'([A-Za-z_]\w*)=("(?:[^"]|"")*"|[^\s"]*)')
    keys = F.regexp_extract_all(text, pattern, F.lit(1))
    values = F.regexp_extract_all(text, pattern, F.lit(2))
    clean = F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v, '^"|"$', ""), '""', '"'))
    pairs = F.arrays_zip(keys.alias("k"), clean.alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(first)


def endpoint_records(lines: DataFrame, required: list[str], line: str = "line") -> DataFrame:
    """instant, kv and missing (required keys that are absent or empty) of endpoint log lines."""
    kv = key_values(F.substr(F.col(line), F.lit(31)))
    out = lines.withColumns({"instant": header_time(F.substr(F.col(line), F.lit(1), F.lit(29))), "kv": kv})
    needed = F.array(*map(F.lit, required))
    missing = F.filter(needed, lambda k: F.coalesce(F.element_at("kv", k), F.lit("")) == "")
    return out.withColumn("missing", missing).withColumn("failed", F.col("instant").isNull() | (F.size("missing") > 0))


def _followed(opened: DataFrame, jumps: DataFrame) -> DataFrame:
    """opened (node, serial, number) and all that jumps (node, serial, at, to) lead to from there.

    Jumps double in each round, so a chain of n of them takes log n rounds.
    """
    keys = ["node", "serial"]
    jumps = written(jumps, "audit-jumps")
    while not jumps.isEmpty():
        step = jumps.withColumnRenamed("at", "number")
        opened = written(opened.unionByName(opened.join(step, [*keys, "number"]).select(*keys, F.col("to").alias("number"))).distinct(), "audit-opened")
        jumps = written(jumps.join(jumps.select(*keys, F.col("at").alias("to"), F.col("to").alias("beyond")), [*keys, "to"]).select(*keys, "at", F.col("beyond").alias("to")), "audit-jumps")
    return opened


def audit_events(lines: DataFrame, number: str = "number", line: str = "line", distance: int = 256) -> DataFrame:
    """(node, serial, event, instant, types, lines): audit records assembled from their lines.

    Lines of one event key belong together while they lie within ``distance``
    lines of the event's first one; later ones open another event. Lines without
    a key are in no event; those of a key without a number are one whose event is null.
    """
    node = F.regexp_extract(line, r"^node=(\S+) ", 1)
    stamp = F.regexp_extract(line, r"msg=audit\(([^)]*)\)", 1)
    kind = F.regexp_extract(line, r"type=(\S+)", 1)
    read = lines.select(node.alias("node"), stamp.alias("serial"), kind.alias("type"), audit_time(F.col(line)).alias("instant"), F.col(number).cast("long").alias("number"))
    # a gap wider than the distance always opens an event: the lines between two such gaps are a stretch
    by_key = Window.partitionBy("node", "serial").orderBy("number")
    opens = F.coalesce(F.col("number") - F.lag("number").over(by_key) > distance, F.lit(True))
    dealt = read.where("serial <> ''").withColumn("__opens", opens)
    dealt = dealt.withColumn("__stretch", F.sum(F.col("__opens").cast("int")).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    # were an event to open at a line, the next would open at the first line beyond its distance
    in_stretch = Window.partitionBy("node", "serial", "__stretch").orderBy("number")
    beyond = F.min("number").over(in_stretch.rangeBetween(distance + 1, 2 * distance))
    dealt = written(dealt.withColumn("__next", beyond), "audit-lines")
    jumps = dealt.where("__next is not null").select("node", "serial", F.col("number").alias("at"), F.col("__next").alias("to")).distinct()
    opened = _followed(dealt.where("__opens").select("node", "serial", "number").distinct(), jumps)
    marked = dealt.join(opened.withColumn("__first", F.col("number")), ["node", "serial", "number"], "left")
    grouped = marked.withColumn("event", F.last("__first", ignorenulls=True).over(in_stretch.rangeBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("node", "serial", "event").agg(
        F.min("instant").alias("instant"),
        F.transform(F.array_sort(F.collect_list(F.struct("number", "type"))), lambda x: x["type"]).alias("types"),
        F.count("*").alias("lines"),
    )


def hex_text(value: Column) -> Column:
    """Text of an unquoted hexadecimal value; NULs between words as spaces, those at the end dropped."""
    ok = value.rlike("^([0-9A-Fa-f]{2})+$")
    trimmed = F.regexp_replace(value, "(00)+$", "")
    return F.when(ok, F.translate(F.decode(F.unhex(trimmed), "UTF-8"), "\0", " "))


def command_line(args: Column, argc: Column) -> Column:
    """a0..aN of a map joined by spaces; null unless argc agrees with the arguments found."""
    upto = F.transform(F.sequence(F.lit(0), F.greatest(argc - 1, F.lit(0))), lambda i: F.element_at(args, F.concat(F.lit("a"), i.cast("string"))))
    return F.when((argc > 0) & F.forall(upto, lambda a: a.isNotNull()), F.array_join(upto, " "))
