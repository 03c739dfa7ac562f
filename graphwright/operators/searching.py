"""Searches over the derived graph and what explains their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from . import graph
from .aggregates import node_counts


def matched_nodes(node_evidence: DataFrame, records: DataFrame, predicate: Column) -> DataFrame:
    """(node): nodes with evidence among the records that meet the predicate.

    The records that pass and the nodes are written first: few of them are then
    known to be few, and meet the evidence without a shuffle of it.
    """
    passing = written(records.where(predicate).select("record").distinct(), "passing")
    return written(node_evidence.join(passing, "record", "left_semi").select("node").distinct(), "matched")


def graph_search(
    node_evidence: DataFrame, edges: DataFrame, records: DataFrame, predicate: Column, depth: int, limit: int
) -> tuple[DataFrame, DataFrame | None]:
    """Matched nodes, and the edges within ``depth`` of them; none over the node limit.

    The limit is the feature: over it a caller gets the nodes and counts only.
    """
    nodes = matched_nodes(node_evidence, records, predicate)
    if nodes.limit(limit + 1).count() > limit:
        return nodes, None
    return nodes, graph.reached_edges(edges, nodes, depth)


def edge_kind_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, n): edges by kind that have an end among the nodes; an edge counts once, also if its rows are several."""
    ends = edges.select("edge", "kind", F.explode(F.array("src", "dst")).alias("node")).join(nodes, "node", "left_semi")
    return ends.select("edge", "kind").distinct().groupBy("kind").agg(F.count("*").alias("n"))


def value_matches(fields: Column, text: str) -> Column:
    """Names of the fields whose value holds the text, each once, in order."""
    hit = F.filter(fields, lambda f: F.coalesce(F.contains(F.lower(f["value"]), F.lit(text.lower())), F.lit(False)))
    return F.array_sort(F.array_distinct(F.transform(hit, lambda f: f["name"])))


def observed_names(fields: DataFrame) -> DataFrame:
    """(name, readable): names of fields and whether any value of theirs is readable."""
    return fields.groupBy("name").agg(F.bool_or(F.col("value").isNotNull()).alias("readable"))


def diagnosis(fields: DataFrame, name: str, text: str) -> str:
    """Why a search found nothing: no_field, no_readable_value, no_equal_value or found."""
    own = fields.where(F.col("name") == name)
    if own.isEmpty():
        return "no_field"
    if own.where("value is not null").isEmpty():
        return "no_readable_value"
    return "no_equal_value" if own.where(F.lower("value") == text.lower()).isEmpty() else "found"


def in_group(**wanted) -> Column:
    """Whether a record is in an evidence group; None selects an absent part."""
    out = F.lit(True)
    for name, value in wanted.items():
        out = out & (F.col(name).isNull() if value is None else F.coalesce(F.col(name) == value, F.lit(False)))
    return out


def same_kind(kind: Column, selectors: list[dict[str, str]]) -> Column:
    """Whether a record kind (map) equals a selector; an unknown kind passes."""
    out = F.lit(False)
    for s in selectors:
        equal = F.size(kind) == len(s)
        for k, v in s.items():
            equal = equal & F.coalesce(F.element_at(kind, k) == v, F.lit(False))
        out = out | equal
    return kind.isNull() | out


def related_values(edges: DataFrame, kind: str, value: DataFrame) -> DataFrame:
    """(node, value, records): values of the other end of one kind of edge, over shared evidence.

    edges (kind, src, dst, record), value (node, value).
    """
    own = edges.where(F.col("kind") == kind)
    return (
        own.join(value.withColumnRenamed("node", "dst"), "dst")
        .groupBy(F.col("src").alias("node"), "value")
        .agg(F.count_distinct("record").alias("records"))
    )


def scan_counts(parsed: DataFrame, source: str, failed: Column, truncated: Column) -> DataFrame:
    """(source, read, succeeded, failed, truncated): tallies of a scan."""
    return parsed.groupBy(source).agg(
        F.count("*").alias("read"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.count_if(truncated & ~failed).alias("truncated")
    )


def layered(observed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Observed edges and, on top, candidates of other identities."""
    extra = candidates.join(observed, ["kind", "src", "dst"], "left_anti")
    return observed.withColumn("state", F.lit("observed")).unionByName(extra.withColumn("state", F.lit("candidate")))


def investigation_measures(edges: DataFrame) -> DataFrame:
    """(node, records, neighbours): measures by which nodes are ranked."""
    ways = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    rows = edges.select("record", F.explode(ways).alias("w")).select("w.*", "record")
    return node_counts(rows, ["node"], {"records": "record", "neighbours": "other"})
