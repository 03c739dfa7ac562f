"""Import of folders: which reader each file gets, and what came of it.

A registry maps formats to readers. A folder is listed in parallel without its
contents; the heads of its files tell their formats; companions of a file (logs
of a hive, say) go with it. The lines of all planned files are read once and
dealt out by format, and each reader sees its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import audit_time
from ..operators.timeline import SIGNATURES, TRIAL, detected_formats
from ..plans.storage import shared_folder, written
from . import lines as readers

#: Bytes of a file's head.
HEAD = 4096
#: Files up to this size are looked at whole; of larger ones the first block's lines are.
SMALL = 16 << 20


@dataclass(frozen=True)
class Format:
    """How to know files of a format and read their lines.

    ``trial`` is an expression that its lines match, null for formats known by
    signature; ``reader`` adds ``failed`` to rows (source, line), null if
    nothing here reads the format; files that are called like another with one
    of the suffixes ``companions`` added belong to that one.
    """

    key: str
    trial: str | None = None
    reader: Callable[[DataFrame], DataFrame] | None = None
    companions: tuple[str, ...] = ()


def _audit(lines: DataFrame) -> DataFrame:
    return lines.withColumn("failed", audit_time(F.col("line")).isNull())


def _endpoint(lines: DataFrame) -> DataFrame:
    return readers.endpoint_records(lines, [])


FORMATS = (
    Format("access", readers.TRIALS["access"], readers.access_records),
    Format("error", readers.TRIALS["error"], readers.error_records),
    Format("audit", readers.TRIALS["audit"], _audit),
    Format("endpoint", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}\.\d{3} [+-]\d{4} ", _endpoint),
    # fixed values: the logs that go with a hive
    Format("registry", companions=(".LOG1", ".LOG2")),
    Format("event_log"),
    Format("prefetch"),
)
#: fixed values: kinds of files that no format is for, by bytes at a place
KINDS = (("zip", 0, b"PK\x03\x04"), ("sqlite", 0, b"SQLite format 3\0"), ("ese", 4, b"\xef\xcd\xab\x89"))


def registry(*groups: tuple[Format, ...]) -> dict[str, Format]:
    """Formats by key; a key twice, an empty key or no format at all is an error."""
    out: dict[str, Format] = {}
    for form in (f for group in groups for f in group):
        if not form.key or form.key in out:
            raise ValueError(f"format {form.key!r} is empty or declared twice")
        if form.trial is None and form.key not in {name for name, *_ in SIGNATURES}:
            raise ValueError(f"format {form.key!r} has neither a trial nor a signature")
        out[form.key] = form
    if not out:
        raise ValueError("no format is declared")
    return out


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(source, size) of all files below a folder; contents are not read.

    Scans leave out empty files, so these come from the names that Spark's
    listing of the folder holds on the driver, names only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = files.select(_path(F.col("path")).alias("source"), F.col("length").alias("size"))
    names = spark.createDataFrame([(n,) for n in files.inputFiles()], "name string")
    empty = names.select(_decoded(F.col("name")).alias("source")).join(rows, "source", "left_anti")
    return rows.unionByName(empty.withColumn("size", F.lit(0).cast("long")))


def heads(spark: SparkSession, folder: str, small: int = SMALL) -> DataFrame:
    """(source, head, lines): the first bytes and lines of the files that are not empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    start = F.substring("content", 1, HEAD * 16)
    whole = files.where((F.col("length") > 0) & (F.col("length") <= small)).select(
        _path(F.col("path")).alias("source"),
        F.substring("content", 1, HEAD).alias("head"),
        F.slice(F.split(F.decode(start, "ISO-8859-1"), "\r?\n"), 1, TRIAL).alias("lines"),
    )
    large = listed(spark, folder).where(F.col("size") > small).select("source")
    if large.isEmpty():
        return whole
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(folder)
    first = text.where("_metadata.file_block_start = 0").select(
        _decoded(F.col("_metadata.file_path")).alias("source"), "value", F.monotonically_increasing_id().alias("at")
    )
    # a head takes few rows: the rank is cut within each task before rows move
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("at"))).where(F.col("n") <= TRIAL)
    opened = ranked.join(large, "source").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("all"))
    values = F.transform("all", lambda x: F.regexp_replace(F.substring(x["value"], 1, HEAD), "\r$", ""))
    return whole.unionByName(
        opened.select("source", F.substring(F.get("all", F.lit(0))["value"].cast("binary"), 1, HEAD).alias("head"), values.alias("lines"))
    )


def _path(c: Column) -> Column:
    """Paths as readers write them: file:/a and file:///a are one."""
    return F.regexp_replace(c, "^file:/+", "file:/")


def _decoded(c: Column) -> Column:
    """The path of a name in which odd characters are escaped."""
    return _path(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))


def planned(spark: SparkSession, folder: str, formats: dict[str, Format]) -> DataFrame:
    """(source, size, format, reason, detected): what each file of a folder is imported as.

    A null reason is a plan. Others are skipped: empty_file, unsupported_format
    (detected says zip, sqlite, ese or text if it is one), no_reader, and
    companion_without_main. Companions of a planned file are left out: they go
    with it.
    """
    files, known = listed(spark, folder), heads(spark, folder)
    trials = {k: f.trial for k, f in formats.items() if f.trial}
    found = detected_formats(known, trials).select("source", F.get(F.filter("formats", lambda x: x.isin(*formats)), F.lit(0)).alias("format"))
    kind = F.lit(None).cast("string")
    for name, at, mark in reversed(KINDS):
        kind = F.when(F.substring("head", at + 1, len(mark)) == F.lit(mark), name).otherwise(kind)
    control = F.exists("lines", lambda v: v.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    kind = F.coalesce(kind, F.when(~control & F.try_validate_utf8(F.decode("head", "UTF-8")).isNotNull(), "text"))
    marked = files.join(found, "source", "left").join(known.select("source", kind.alias("detected")), "source", "left")
    marked = written(marked, "listing")

    pairs = [(k, s) for k, f in formats.items() for s in f.companions]
    called = F.lit(False)
    for key, suffix in pairs:
        called = called | ((F.col("format") == key) & F.endswith(F.col("source"), F.lit(suffix)))
    own = marked.withColumn("companion", F.coalesce(called, F.lit(False)))
    suffixes = F.lit(None).cast("array<string>")
    for key, form in formats.items():
        if form.companions:
            suffixes = F.when(F.col("format") == key, F.array(*map(F.lit, form.companions))).otherwise(suffixes)
    beside = own.where("not companion").select("source", F.explode(suffixes).alias("suffix")).select(F.concat("source", "suffix").alias("source"))
    rest = own.join(beside, "source", "left_anti")
    unread = [k for k, f in formats.items() if f.reader is None]
    reason = (
        F.when(F.col("size") == 0, "empty_file")
        .when(F.col("format").isNull(), "unsupported_format")
        .when(F.col("companion"), "companion_without_main")
        .when(F.col("format").isin(unread) if unread else F.lit(False), "no_reader")
    )
    detected = F.when(F.col("format").isNull(), F.col("detected"))
    return rest.select("source", "size", "format", reason.alias("reason"), detected.alias("detected"))


def imported(spark: SparkSession, folder: str, formats: dict[str, Format]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What came of each file of a folder, and the records of each format.

    The first table is (source, format, state, read, succeeded, failed, reason):
    published_full, published_partial if some lines failed, withheld if none
    could be read, or skipped with the reason of ``planned``. Lines without a
    character are no records. The dictionary has a DataFrame for each format
    with planned files: source, line and what its reader gives.
    """
    plan = written(planned(spark, folder, formats), "plan")
    todo = plan.where("reason is null").select("source", "format")
    text = spark.read.option("recursiveFileLookup", True).text(folder)
    lines = text.select(_decoded(F.col("_metadata.file_path")).alias("source"), F.col("value").alias("line")).where("line <> ''")
    path = shared_folder(spark, "lines")
    lines.join(todo, "source").write.partitionBy("format").parquet(path)
    keys = [r.format for r in todo.select("format").distinct().collect()]  # formats of the registry
    records, counts = {}, None
    for key in sorted(keys):
        own = spark.read.schema("source string, line string, format string").parquet(path).where(F.col("format") == key).drop("format")
        records[key] = formats[key].reader(own)
        tally = records[key].groupBy("source").agg(F.count("*").alias("read"), F.count_if(F.coalesce("failed", F.lit(True))).alias("failed"))
        counts = tally if counts is None else counts.unionByName(tally)
    if counts is None:
        counts = spark.createDataFrame([], "source string, read long, failed long")
    out = plan.join(counts, "source", "left").na.fill(0, ["read", "failed"])
    state = (
        F.when(F.col("reason").isNotNull(), "skipped")
        .when(F.col("failed") == F.col("read"), "withheld")
        .when(F.col("failed") > 0, "published_partial")
        .otherwise("published_full")
    )
    status = out.select("source", "format", state.alias("state"), "read", (F.col("read") - F.col("failed")).alias("succeeded"), "failed", "reason")
    return status, records
