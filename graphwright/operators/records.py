"""From records to objects, evidence groups, attributes and fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import fragment_alphabet
from ..plans.storage import written

#: The ends and kinds of relations between the objects of one record.
LINKS = (
    ("process", "terminal", "ran_on"),
    ("process", "file", "file_operation"),
    ("process", "registry_value", "registry_operation"),
    ("process", "ip", "process_communication"),
    ("terminal", "ip", "terminal_address"),
    ("terminal", "account", "terminal_account"),
)


def objects(fields: DataFrame, semantics: DataFrame) -> DataFrame:
    """(record, object, value): the identities that the fields of records name.

    fields (record, ord, semantic, value), semantics (semantic, object, role).
    A semantic counts where it comes first in its record.
    """
    first = fields.where("value is not null").groupBy("record", "semantic").agg(F.min_by("value", "ord").alias("value"))
    return first.join(semantics.where("role = 'identity'"), "semantic").select("record", "object", "value").distinct()


def intra_record_links(named: DataFrame) -> DataFrame:
    """(kind, src, dst, records) of relations between objects of one record.

    A record's objects are few, and the pairs of its lists are what a relation
    is; the kinds are a fixed list. A record is one row and its objects differ,
    so a relation's rows are its records.
    """
    kinds = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("kind")) for a, b, k in LINKS))
    lists = named.where("record is not null").groupBy("record").agg(F.collect_set(F.struct("object", "value")).alias("o"))
    ends = lists.select("record", "o", F.explode(kinds).alias("k"))

    def of(kind: str):
        return F.filter("o", lambda x: x["object"] == F.col(kind))

    src = ends.select("record", "k", "o", F.explode(of("k.a")).alias("s"))
    both = src.select("record", "k", "s", F.explode(of("k.b")).alias("d"))
    return both.groupBy(F.col("k.kind").alias("kind"), F.col("s.value").alias("src"), F.col("d.value").alias("dst")).agg(
        F.count("*").alias("records")
    )


def evidence_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence by a key of several parts, an absent part being a group of its own."""
    return df.groupBy(*keys).agg(F.count("*").alias("records"), F.count_distinct("account").alias("accounts"))


def grouped_attributes(df: DataFrame) -> DataFrame:
    """(node, attribute, values): attributes by semantic else name, with counted values in order."""
    counted = df.groupBy("node", F.coalesce("semantic", "name").alias("attribute"), "value").agg(F.count_distinct("record").alias("n"))
    pairs = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))), lambda x: F.concat_ws("=", x["value"], (-x["n"]).cast("string"))
    )
    return counted.groupBy("node", "attribute").agg(F.array_join(pairs, ",").alias("values"))


def co_occurring(df: DataFrame) -> DataFrame:
    """(a, b, records): unordered pairs of objects named by one record.

    A record names an object once before the join, so that pairs are counted and
    no record is kept.
    """
    own = df.select("record", "object").distinct()
    a, b = own.select("record", F.col("object").alias("a")), own.select("record", F.col("object").alias("b"))
    return a.join(b, "record").where("a < b").groupBy("a", "b").agg(F.count("*").alias("records"))


def joined_fragments(df: DataFrame) -> DataFrame:
    """Bodies sent in numbered pieces, put together: one row for each segment.

    df (stream, ord, source, number, token). A segment ends where the number
    falls or the source changes. duplicates are equal repeats of a number,
    conflicts are unequal ones, missing are numbers without a piece; the body
    takes the first piece of each number.
    """
    w = Window.partitionBy("stream").orderBy("ord")
    new = (F.col("number") < F.lag("number").over(w)) | (F.col("source") != F.lag("source").over(w))
    cut = df.withColumn("new", F.coalesce(new, F.lit(False)).cast("int"))
    cut = cut.withColumn("segment", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by_number = cut.groupBy("stream", "segment", "number").agg(
        F.min_by("token", "ord").alias("token"), F.count("*").alias("n"), F.count_distinct("token").alias("variants")
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "token"))), lambda x: x["token"]), "")
    out = by_number.groupBy("stream", "segment").agg(
        body.alias("body"),
        F.sum(F.when(F.col("variants") == 1, F.col("n") - 1).otherwise(0)).alias("duplicates"),
        F.count_if(F.col("variants") > 1).alias("conflicts"),
        (F.max("number") - F.min("number") + 1 - F.count("*")).alias("missing"),
    )
    return out.withColumn("alphabet", fragment_alphabet(F.col("body")))


def described_bytes(df: DataFrame, column: str) -> DataFrame:
    """size, sha256, first bytes and content type by its first bytes."""
    head = F.hex(F.substr(F.col(column), F.lit(1), F.lit(16)))
    # fixed values: first bytes of common formats
    kinds = (("504B0304", "application/zip"), ("25504446", "application/pdf"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("4D5A", "application/x-msdownload"), ("1F8B", "application/gzip"))
    kind = F.coalesce(*(F.when(head.startswith(m), F.lit(k)) for m, k in kinds), F.lit("application/octet-stream"))
    return df.withColumns({"size": F.octet_length(column), "sha256": F.sha2(column, 256), "head": F.lower(head), "content_type": kind})


def named_objects(df: DataFrame, command: str, most: int = 16) -> DataFrame:
    """df with kind and value of hosts and paths that a command line names, ``most`` a record.

    UNC and URL hosts in lower case, and paths with a drive letter.
    """
    c = F.col(command)
    unc = F.transform(F.regexp_extract_all(c, F.lit(r"\\\\([A-Za-z0-9._-]+)\\"), F.lit(1)), lambda x: F.struct(F.lit("host").alias("kind"), F.lower(x).alias("value")))
    url = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)https?://(?:[^/@\s]*@)?([A-Za-z0-9._-]+)"), F.lit(1)), lambda x: F.struct(F.lit("host").alias("kind"), F.lower(x).alias("value")))
    path = F.transform(F.regexp_extract_all(c, F.lit(r'(?:^|[\s"])([A-Za-z]:\\[^\s"]+)'), F.lit(1)), lambda x: F.struct(F.lit("file").alias("kind"), F.lower(x).alias("value")))
    found = F.slice(F.array_distinct(F.concat(unc, url, path)), 1, most)
    return df.withColumn("o", F.explode(found)).select(*df.columns, "o.kind", "o.value")


def latest_revisions(df: DataFrame, key: list[str], revision: str) -> DataFrame:
    """The row of the latest revision of each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), revision).alias("r")).select(*key, "r.*")


def bucketed_timeline(df: DataFrame, time: str, width: str) -> DataFrame:
    """Records per bucket of time: day, hour, minute or second, or '10 minutes' and the like."""
    start = F.date_trunc(width, time) if " " not in width else F.window(time, width)["start"]
    return df.groupBy(start.cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("records"))


def interpreted_times(records: DataFrame, offsets: DataFrame) -> DataFrame:
    """records with instant: local times read under the source's one offset.

    offsets (source, minutes); a source with two different offsets has none.
    """
    one = offsets.groupBy("source").agg(F.count_distinct("minutes").alias("n"), F.min("minutes").alias("minutes")).where("n = 1 and abs(minutes) <= 1080")
    joined = records.join(one.select("source", "minutes"), "source", "left")
    shifted = F.timestamp_add("MINUTE", -F.col("minutes"), F.col("local_time"))
    return joined.withColumn("instant", F.when(F.col("minutes").isNotNull(), shifted)).drop("minutes")


#: Member hashes that one digest takes as they are.
LEAF = 4096


def collection_terminals(df: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(collection, terminal): SHA-256 over the sorted member hashes, one a line.

    A collection of more members is a tree: they are dealt out by the next digit
    of their hashes until at most ``leaf`` are in one group, each group is
    digested as above, and a group's digest is that over its digits and their
    digests, from the last level up. One hash more than ``leaf`` times is a group
    of the hash and its count. So no task holds more than ``leaf`` hashes, and
    the digest depends on the members alone. Null hashes count as empty.
    """
    members = df.select("collection", F.coalesce("sha256", F.lit("")).alias("sha256"))
    left = written(members.groupBy("collection", "sha256").agg(F.count("*").alias("n")), "members")
    depth, levels = 0, []
    while True:
        by = ["collection", "prefix"]
        here = left.withColumn("prefix", F.substring("sha256", 1, depth))
        sizes = here.groupBy(*by).agg(F.sum("n").alias("all"), F.count("*").alias("hashes"))
        lists = here.join(sizes.where(F.col("all") <= leaf), by).withColumn("lines", F.array_repeat("sha256", F.col("n").cast("int")))
        text = F.array_join(F.array_sort(F.flatten(F.collect_list("lines"))), "\n")
        small = lists.groupBy(*by).agg(F.sha2(text, 256).alias("digest"))
        alone = (F.col("all") > leaf) & (F.col("hashes") == 1)
        one = here.join(sizes.where(alone), by).select(*by, F.sha2(F.concat_ws(" ", "sha256", F.col("n").cast("string")), 256).alias("digest"))
        levels.append(written(small.union(one), "digests"))
        big = sizes.where((F.col("all") > leaf) & ~alone).select(*by)
        left = written(here.join(big, by, "left_semi").drop("prefix"), "members")
        if left.isEmpty():
            break
        depth += 1
    digests = levels.pop()
    while levels:
        depth -= 1
        up = digests.withColumn("digit", F.substring("prefix", depth + 1, 1)).withColumn("prefix", F.substring("prefix", 1, depth))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("digit", "digest"))), lambda x: F.concat_ws(" ", x["digit"], x["digest"])), "\n")
        inner = up.groupBy("collection", "prefix").agg(F.sha2(text, 256).alias("digest"))  # a digit each: 17 rows at most
        digests = written(inner.union(levels.pop()), "digests")
    return digests.select("collection", F.col("digest").alias("terminal"))


def distinguished_names(df: DataFrame, path: str) -> DataFrame:
    """df with shown: the file name, with as much of its folder as tells it from its equals."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    two = F.array_join(F.slice(parts, -2, 2), "/")
    sized = df.withColumns({"__n": F.count("*").over(Window.partitionBy(name)), "__m": F.count("*").over(Window.partitionBy(F.when(F.size(parts) > 1, two).otherwise(name)))})
    shown = F.when(F.col("__n") == 1, name).when((F.col("__m") == 1) & (F.size(parts) > 1), two).otherwise(F.col(path))
    return sized.withColumn("shown", shown).drop("__n", "__m")
