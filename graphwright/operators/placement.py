"""Where a record is placed, and relations that come with a placement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import short_hostname
from .joins import interval_candidates


def placed(records: DataFrame, assignments: DataFrame, collections: DataFrame, bucket: int = 86_400) -> DataFrame:
    """(record, place, basis): the terminal of each record by the first rule that gives one.

    records (record, terminal, host, at, source), assignments (host, start_s,
    end_s, owner), collections (host, collection). In order: the record's own
    terminal; the one assignment that names its host at its time; the
    collection that alone owns the host's short name; the host within the
    source; the source.
    """
    named = records.where("terminal is null and host is not null").select("record", F.lower("host").alias("host"), "at")
    made = assignments.select(F.lower("host").alias("host"), "start_s", "end_s", "owner")
    held = interval_candidates(named, made, ["host"], "at", "start_s", "end_s", bucket)
    one = held.groupBy("record").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("owner")).where("n = 1").drop("n")
    owners = collections.groupBy(short_hostname(F.col("host")).alias("short")).agg(
        F.count_distinct("collection").alias("n"), F.min("collection").alias("collection")
    )
    joined = (
        records.join(one, "record", "left")
        .withColumn("short", short_hostname(F.col("host")))
        .join(owners.where("n = 1").drop("n"), "short", "left")
    )
    own = F.col("terminal").cast("string")
    by_host = F.concat_ws("|", F.col("source").cast("string"), F.lower("host"))
    place = F.coalesce(own, F.col("owner").cast("string"), F.col("collection").cast("string"), F.when(F.col("host").isNotNull(), by_host), F.col("source").cast("string"))
    basis = (
        F.when(own.isNotNull(), "own")
        .when(F.col("owner").isNotNull(), "assignment")
        .when(F.col("collection").isNotNull(), "collection")
        .when(F.col("host").isNotNull(), "host_in_source")
        .otherwise("source")
    )
    return joined.select("record", place.alias("place"), basis.alias("basis"))


def reverse_lookups(records: DataFrame) -> DataFrame:
    """(src, src_kind, domain, records): the process of a record, else the record, and the name it looked up."""
    src = F.coalesce(F.col("process"), F.col("record")).cast("string")
    kind = F.when(F.col("process").isNotNull(), "process").otherwise("record")
    rows = records.where("domain is not null").select(src.alias("src"), kind.alias("src_kind"), F.lower("domain").alias("domain"), "record")
    return rows.groupBy("src", "src_kind", "domain").agg(F.count_distinct("record").alias("records"))


def assigned_addresses(observed: DataFrame, assignments: DataFrame) -> DataFrame:
    """(terminal, address, evidence, assigned): address edges of records and assignments, merged by identity."""
    a = observed.groupBy("terminal", "address").agg(F.count_distinct("record").alias("evidence"))
    b = assignments.select("terminal", "address").distinct().withColumn("assigned", F.lit(True))
    out = a.join(b, ["terminal", "address"], "full")
    return out.select("terminal", "address", F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("assigned", F.lit(False)).alias("assigned"))
