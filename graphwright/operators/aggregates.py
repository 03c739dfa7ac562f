"""Aggregations over records, nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, value: Column, record: str, time: str) -> DataFrame:
    """(value, records, first_seen, last_seen): distinct records of each comparable value."""
    return (
        df.where(value.isNotNull())
        .groupBy(value.alias("value"))
        .agg(F.count_distinct(record).alias("records"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))
    )


def event_kinds(df: DataFrame, category: str, action: str) -> DataFrame:
    """(category, action, records, categorised) of each kind; a null pair is uncategorised."""
    return df.groupBy(category, action).agg(
        F.count("*").alias("records"), F.bool_and(F.col(category).isNotNull()).alias("categorised")
    )


def interval_summary(df: DataFrame, keys: list[str], time_ms: Column) -> DataFrame:
    """Gaps in ms between consecutive times: least, lower, middle and upper quartile, most.

    A quartile is the gap number q * (n - 1) div 4 in order, counted from 0.
    Keys with under two times give no row. Gaps are counted by value before
    they are ordered.
    """
    w = Window.partitionBy(*keys).orderBy("__t")
    gaps = df.withColumn("__t", time_ms).withColumn("__gap", F.col("__t") - F.lag("__t").over(w))
    sizes = gaps.where("__gap is not null").groupBy(*keys, "__gap").agg(F.count("*").alias("__n"))
    by = Window.partitionBy(*keys)
    upto = F.sum("__n").over(by.orderBy("__gap").rowsBetween(Window.unboundedPreceding, 0))
    placed = sizes.withColumns({"__upto": upto, "__all": F.sum("__n").over(by)})

    def quartile(q: int) -> Column:
        at = F.floor(F.lit(q) * (F.col("__all") - 1) / 4)
        return F.min(F.when(F.col("__upto") > at, F.col("__gap")))

    return placed.groupBy(*keys).agg(
        F.sum("__n").alias("gaps"),
        F.min("__gap").alias("least"),
        quartile(1).alias("lower"),
        quartile(2).alias("middle"),
        quartile(3).alias("upper"),
        F.max("__gap").alias("most"),
    )


def grid_step(span_ms: Column, columns: int) -> Column:
    """Width in ms of a histogram column that covers a span; whole seconds from one up."""
    step = F.ceil((span_ms + 1) / F.lit(max(columns - 1, 1)))
    return F.when(step >= 1000, F.ceil(step / 1000) * 1000).otherwise(step).cast("long")


def time_histogram(df: DataFrame, lane: str, time_ms: Column, columns: int) -> DataFrame:
    """(lane, column_start, records) over a grid of columns, empty ones included.

    The grid is one row, the lanes an aggregate; their product with the columns
    is what the answer has, and the only table that is joined to it.
    """
    timed = df.withColumn("__ms", time_ms).where("__ms is not null")
    span = timed.agg(F.min("__ms").alias("lo"), F.max("__ms").alias("hi"))
    step = grid_step(F.col("hi") - F.col("lo"), columns)
    start = (F.col("lo") - F.pmod(F.col("lo"), F.col("step"))) if columns > 1 else F.col("lo")
    grid = span.withColumn("step", step).withColumn("start", start)
    counted = (
        timed.join(F.broadcast(grid))  # one row
        .withColumn("column", F.floor((F.col("__ms") - F.col("start")) / F.col("step")))
        .groupBy(lane, "column")
        .agg(F.count("*").alias("n"))
    )
    cells = (
        timed.select(lane).distinct().join(F.broadcast(grid))
        .withColumn("column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))))
    )
    return cells.join(counted, [lane, "column"], "left").select(
        lane,
        (F.col("start") + F.col("column") * F.col("step")).alias("column_start"),
        F.coalesce("n", F.lit(0)).alias("records"),
    )


def coverage(df: DataFrame, source: str, time: str, low: Column, high: Column) -> DataFrame:
    """(source, coverage): how a source's recorded range covers a requested period."""
    lo, hi = F.min(time), F.max(time)
    state = (
        F.when(lo.isNull(), "unknown")
        .when((lo <= low) & (hi >= high), "covered")
        .when((hi < low) | (lo > high), "outside")
        .otherwise("partial")
    )
    return df.groupBy(source).agg(state.alias("coverage"))


def with_zeros(df: DataFrame, outcome: str, all_outcomes: list[str]) -> DataFrame:
    """(outcome, n) for every outcome, also those that no row has."""
    spark = df.sparkSession
    known = spark.createDataFrame([(o,) for o in all_outcomes], f"{outcome} string")
    counts = df.groupBy(outcome).agg(F.count("*").alias("n"))
    return known.join(counts, outcome, "left").select(outcome, F.coalesce("n", F.lit(0)).alias("n"))


def bypass(df: DataFrame, client: str, by_proxy: Column, via_proxy: Column, direct: Column, target: str) -> DataFrame:
    """Per client: requests at the proxy, connections to it, direct ones and their targets."""
    return df.groupBy(client).agg(
        F.count_if(by_proxy).alias("proxy_requests"),
        F.count_if(via_proxy).alias("proxy_connections"),
        F.count_if(direct).alias("direct_connections"),
        F.count_distinct(F.when(direct, F.col(target))).alias("direct_targets"),
    )


def node_summaries(nodes: DataFrame, edges: DataFrame, time: str) -> DataFrame:
    """Per node: distinct records of its own and its edges' evidence, undated ones, range.

    nodes (node, record, time) and edges (src, dst, record, time) are evidence
    in long form.
    """
    own = nodes.select("node", "record", time)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "record", time)
    return (
        own.union(ends)
        .distinct()
        .groupBy("node")
        .agg(
            F.count("*").alias("records"),
            F.count_if(F.col(time).isNull()).alias("undated"),
            F.min(time).alias("first_seen"),
            F.max(time).alias("last_seen"),
        )
    )


def edge_summaries(edges: DataFrame) -> DataFrame:
    """(kind, src, dst, records, first_seen, last_seen): edges by identity, from their evidence (kind, src, dst, record, time).

    Evidence is dealt out by edge once, so that its records are told apart and
    counted where they are.
    """
    by = ["kind", "src", "dst"]
    return edges.repartition(*by).groupBy(*by).agg(
        F.count_distinct("record").alias("records"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen")
    )


def node_counts(rows: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """(by..., and the keys of values): how many different values each column of ``values`` has.

    rows are dealt out by the first of ``by``. The values of all columns are told
    apart and counted in one pass over them, and not shuffled again.
    """
    parts = F.array(*(F.struct(*(F.col(c) if c == own else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in values.values())) for own in values.values()))
    each = rows.repartition(by[0]).select(*by, F.explode(parts).alias("__v")).select(*by, "__v.*").distinct()
    return each.groupBy(*by).agg(*(F.count(c).alias(n) for n, c in values.items()))


def edge_counts(edges: DataFrame) -> DataFrame:
    """(node, kind, direction, n_edges, n_records) from edges (src, dst, kind, record)."""
    ways = F.array(
        F.struct(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("node"), F.lit("in").alias("direction"), F.col("src").alias("other")),
    )
    rows = edges.select("kind", "record", F.explode(ways).alias("w")).select("w.*", "kind", "record")
    return node_counts(rows, ["node", "kind", "direction"], {"n_edges": "other", "n_records": "record"})


def relations(roles: DataFrame) -> DataFrame:
    """(a, b, a_role, b_role, records, first_seen, last_seen) of accounts named by one record.

    roles: (record, account, role, time). A record names few accounts, so the
    join by record is bounded by the rows of a record. Each role of a record is
    one row before the join, so that pairs are counted and no record is kept.
    """
    own = roles.groupBy("record", "account", "role").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    left = own.select("record", "first", "last", F.col("account").alias("a"), F.col("role").alias("a_role"))
    right = own.select("record", F.col("account").alias("b"), F.col("role").alias("b_role"))
    return (
        left.join(right, "record")
        .where("a <> b")
        .groupBy("a", "b", "a_role", "b_role")
        .agg(F.count("*").alias("records"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))
    )


def paged(df: DataFrame, order: list, size: int, page: int) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset(size * page).limit(size)


def upserted(rows: DataFrame, node: str, order: list[str], label: str, observed: str) -> DataFrame:
    """One row for each node: the first label in order, observed if any row is, mentions."""
    return rows.groupBy(node).agg(
        F.min_by(label, F.when(F.col(label).isNotNull(), F.struct(*order))).alias("label"),
        F.bool_or(observed).alias("observed"),
        F.count("*").alias("mentions"),
    )


def withheld(records: DataFrame, source: str, position: str, references: DataFrame) -> DataFrame:
    """(source, state): withheld if a position comes twice or a reference dangles."""
    twice = records.groupBy(source, position).agg(F.count("*").alias("__n"))
    twice = twice.groupBy(source).agg(F.bool_or(F.col("__n") > 1).alias("__twice"))
    dangling = (
        references.join(records.select(source, position), [source, position], "left_anti")
        .select(source)
        .distinct()
        .withColumn("__dangling", F.lit(True))
    )
    bad = F.col("__twice") | F.coalesce("__dangling", F.lit(False))
    return twice.join(dangling, source, "left").select(source, F.when(bad, "withheld").otherwise("published").alias("state"))
