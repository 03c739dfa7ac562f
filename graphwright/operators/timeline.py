"""Records on a time line and near nodes; what names and places them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

#: Leading bytes of binary formats, as (format, offset, bytes).
SIGNATURES = (
    ("event_log", 0, b"ElfFile\0"),
    ("registry", 0, b"regf"),
    ("prefetch", 0, b"MAM\x04"),
    ("prefetch", 4, b"SCCA"),
)
#: Records that a trial reads of a file.
TRIAL = 64


def timeline(records: DataFrame) -> DataFrame:
    """(record, at, local, additional): a row for each time of records (record, at, local, more).

    more (array) holds further times of the record. A record without any time
    stays, by its local time, behind those with one.
    """
    own = F.struct(F.col("at").alias("t"), F.lit(False).alias("additional"))
    more = F.transform(F.coalesce("more", F.array().cast("array<timestamp_ntz>")), lambda t: F.struct(t.alias("t"), F.lit(True).alias("additional")))
    rows = F.filter(F.array_append(more, own), lambda r: r["t"].isNotNull() | (~r["additional"] & (F.size(more) == 0)))
    out = records.select("record", "local", F.explode(rows).alias("r")).select("record", F.col("r.t").alias("at"), "local", "r.additional")
    return out.orderBy(F.asc_nulls_last("at"), F.asc_nulls_last("local"), "record")


def source_ranges(records: DataFrame) -> DataFrame:
    """(source, low, high): the least and greatest time of a source, further times included."""
    times = F.array_append(F.coalesce("more", F.array().cast("array<timestamp_ntz>")), F.col("at"))
    return records.groupBy("source").agg(F.min(F.array_min(times)).alias("low"), F.max(F.array_max(times)).alias("high"))


def account_history(records: DataFrame, account, categories: dict[str, str]) -> DataFrame:
    """(record, category, at) of the management events that target the account, undated last.

    categories: the category of each action that manages accounts.
    """
    named = F.create_map(*(F.lit(x) for pair in categories.items() for x in pair))
    rows = records.where((F.col("target") == F.lit(account)) & F.col("action").isin(*categories))
    return rows.select("record", named[F.col("action")].alias("category"), "at").orderBy(F.asc_nulls_last("at"), "record")


def records_near(edges: DataFrame, origins: DataFrame, node_evidence: DataFrame, edge_evidence: DataFrame, depth: int) -> DataFrame:
    """(record): evidence of the origins (node) and of the edges within depth of them."""
    own = node_evidence.join(origins.select("node").distinct(), "node", "left_semi").select("record")
    met = graph.reached_edges(edges, origins, depth).select("edge")
    return own.union(edge_evidence.join(met, "edge", "left_semi").select("record")).distinct()


def accounts_beside(mentions: DataFrame, account) -> DataFrame:
    """(account, records): other accounts in the records (record, account) that name the account."""
    touched = mentions.where(F.col("account") == F.lit(account)).select("record").distinct()
    others = mentions.where(F.col("account") != F.lit(account)).select("record", "account").distinct()
    return others.join(touched, "record", "left_semi").groupBy("account").agg(F.count("*").alias("records"))


def text_hits(records: DataFrame, text: str, raw: str, values: Column) -> DataFrame:
    """Records whose raw text or converted values (array) hold the text, whatever its case."""
    want = F.lit(text.lower())
    in_raw = F.coalesce(F.contains(F.lower(raw), want), F.lit(False))
    in_values = F.coalesce(F.exists(values, lambda v: F.coalesce(F.contains(F.lower(v), want), F.lit(False))), F.lit(False))
    return records.withColumns({"in_raw": in_raw, "in_values": in_values}).where("in_raw or in_values")


def scoped_semantic(key: Column, scopes: list[tuple[Column, dict[tuple[str, str], str]]], plain: dict[str, str]) -> Column:
    """Meaning of a field: by (key, value of a scope), the first scope that has one, else by key.

    The mappings are the library's own, so they are literals of the plan and
    need no join.
    """

    def looked_up(at: Column, table: dict[str, str]) -> Column:
        return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[at] if table else F.lit(None).cast("string")

    scoped = [looked_up(F.concat_ws("\0", key, value), {f"{k}\0{v}": m for (k, v), m in table.items()}) for value, table in scopes]
    return F.coalesce(*scoped, looked_up(key, plain))


def drive_paths(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files (collection, device, path, ...) with drive_path, the path under its drive letter.

    roots (collection, root) has the installed folders that a collection
    names. A device gets the letter if its collection has one root and it
    alone holds files in the root's System32; else drive_path is null.
    """
    root = roots.where(F.col("root").rlike(r"^[A-Za-z]:(\\[^\\]+)+\\?$")).groupBy("collection")
    root = root.agg(F.count_distinct(F.lower("root")).alias("n"), F.min("root").alias("root")).where("n = 1")
    folder = F.regexp_replace(F.lower(F.substr("root", F.lit(3))), r"\\$", "")
    # one row for each device before the join, whatever its number of files
    system = F.regexp_extract(F.lower("path"), r"^(\\.+)\\system32\\", 1)
    holders = files.select("collection", "device", system.alias("folder")).where("folder <> ''").distinct()
    held = holders.join(root.select("collection", "root", folder.alias("folder")), ["collection", "folder"])
    one = held.groupBy("collection").agg(F.count_distinct("device").alias("n"), F.min("device").alias("device"), F.min("root").alias("root")).where("n = 1")
    letters = one.select("collection", "device", F.left("root", F.lit(2)).alias("__letter"))
    return files.join(letters, ["collection", "device"], "left").withColumn("drive_path", F.concat("__letter", "path")).drop("__letter")


def short_routes(edges: DataFrame, most: int = 3000) -> DataFrame:
    """The best edges (edge, earliest, length, hops): on an earliest route first, then short ones."""
    return edges.orderBy(F.desc("earliest"), "length", "hops", "edge").limit(most)


def naming_edges(records: DataFrame) -> DataFrame:
    """(kind, src, dst) from records (record, object, subject, target, process, path).

    A record names an object, a subject and a target account; a start names
    the executable of its process. A null names nothing.
    """

    def edge(kind: str, src: str, dst: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"))

    edges = F.array(
        edge("record_names_object", "record", "object"),
        edge("record_subject_account", "record", "subject"),
        edge("record_target_account", "record", "target"),
        edge("process_executable", "path", "process"),
    )
    return records.select(F.explode(edges).alias("e")).select("e.*").where("src is not null and dst is not null").distinct()


def named_terminals(evidence: DataFrame) -> DataFrame:
    """(node, terminal, first): terminals of a node's evidence (node, terminal, ord), by where each comes first."""
    return evidence.where("terminal is not null").groupBy("node", "terminal").agg(F.min("ord").alias("first"))


def record_summaries(fields: DataFrame, semantics: list[str]) -> DataFrame:
    """A row for each record with the first value of each semantic, from (record, ord, semantic, value)."""
    first = [F.min_by(F.when(F.col("semantic") == s, F.col("value")), F.when((F.col("semantic") == s) & F.col("value").isNotNull(), F.col("ord"))).alias(s) for s in semantics]
    return fields.groupBy("record").agg(*first)


def detected_formats(files: DataFrame, trials: dict[str, str]) -> DataFrame:
    """(source, formats): formats of files (source, head binary, lines array<string>), in order of name.

    A signature in the head decides. Else the head must be text, and a format
    of lines (trials: its regular expression) is one if more of the first
    lines parse than fail. No format gives an empty array.
    """
    signed = [F.when(F.substring("head", at + 1, len(mark)) == F.lit(mark), F.lit(name)) for name, at, mark in SIGNATURES]
    lines = F.filter(F.slice("lines", 1, TRIAL), lambda v: F.trim(v) != "")
    text = ~F.exists(lines, lambda v: v.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1B\x7F-\x9F]"))

    def parsed(form: str) -> Column:
        return F.size(F.filter(lines, lambda v: v.rlike(form)))

    read = [F.when(text & (2 * parsed(form) > F.size(lines)), F.lit(name)) for name, form in trials.items()]
    by_mark, by_trial = (F.array_sort(F.array_distinct(F.array_compact(F.array(*x)))) for x in (signed, read))
    return files.select("source", F.when(F.size(by_mark) > 0, by_mark).otherwise(by_trial).alias("formats"))
