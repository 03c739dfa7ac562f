"""Window logic: sessions, instances, ranks, gaps and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import rounded_significant


def epochs(df: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """df with epoch: how many starts came not after each row of its keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn("epoch", F.count_if(starts).over(w))


def sessions(
    df: DataFrame, keys: list[str], time: str, kind: str, boot: str, logoff: str, hours: int = 24
) -> DataFrame:
    """One row for each session: (keys, epoch, started, ended, ending, operations).

    A session is what one key does between two boots. It ends with its first
    logoff not before its start, else at the next boot, else ``hours`` after
    its last operation.
    """
    marked = epochs(df, keys, [time], F.col(kind) == boot)
    boots = marked.where(F.col(kind) == boot).groupBy(*keys, "epoch").agg(F.min(time).alias("__boot"))
    own = marked.where(F.col(kind) != boot)
    spans = own.groupBy(*keys, "epoch").agg(
        F.min(time).alias("started"),
        F.max(time).alias("__last"),
        F.min(F.when(F.col(kind) == logoff, F.col(time))).alias("__off"),
        F.count("*").alias("operations"),
    )
    following = boots.select(*keys, (F.col("epoch") - 1).alias("epoch"), "__boot")
    out = spans.join(following, [*keys, "epoch"], "left")
    ended = F.coalesce("__off", "__boot", F.timestamp_add("HOUR", F.lit(hours), F.col("__last")))
    ending = F.when(F.col("__off").isNotNull(), "logoff").when(F.col("__boot").isNotNull(), "boot").otherwise("assumed")
    return out.select(*keys, "epoch", "started", ended.alias("ended"), ending.alias("ending"), "operations")


def instances(df: DataFrame, keys: list[str], time: str, row_id: str, start: Column, end: Column) -> DataFrame:
    """Process instances: (keys, instance, first_seen, last_seen, has_start, has_end, n_records).

    A start opens an instance and the row after an end opens another; islands
    are numbered by a running sum.
    """
    w = Window.partitionBy(*keys).orderBy(time, row_id)
    after_end = F.coalesce(F.lag(end).over(w), F.lit(False))
    opens = (start | after_end).cast("long")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    flagged = df.withColumns({"__opens": opens})
    return (
        flagged.withColumn("instance", F.sum("__opens").over(run))
        .groupBy(*keys, "instance")
        .agg(
            F.min(time).alias("first_seen"),
            F.max(time).alias("last_seen"),
            F.bool_or(start).alias("has_start"),
            F.bool_or(end).alias("has_end"),
            F.count("*").alias("n_records"),
        )
    )


def ranked(df: DataFrame, kind: str, value: str) -> DataFrame:
    """df with rounded, place and ties: competition rank of the value in its kind, nulls last.

    Values are rounded to ten significant digits before they are compared.
    Ranks come from counts of distinct values, so a kind with many rows is
    aggregated before it is ordered.
    """
    rounded = df.withColumn("rounded", rounded_significant(F.col(value).cast("double")))
    sizes = rounded.groupBy(kind, "rounded").agg(F.count("*").alias("ties"))
    w = Window.partitionBy(kind).orderBy(F.col("rounded").desc_nulls_last())
    before = F.coalesce(F.sum("ties").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.withColumn("place", before + 1)
    on = (F.col("l." + kind).eqNullSafe(F.col("r." + kind))) & F.col("l.rounded").eqNullSafe(F.col("r.rounded"))
    return rounded.alias("l").join(places.alias("r"), on).select("l.*", "r.place", "r.ties")


def number_gaps(df: DataFrame, stream: str, number: str) -> DataFrame:
    """For each stream: records, lowest, highest, missing numbers, gaps and duplicates."""
    counted = df.groupBy(stream, number).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(stream).orderBy(number)
    gap = F.col(number) - F.lag(number).over(w) - 1
    return (
        counted.withColumn("__gap", F.coalesce(gap, F.lit(0)))
        .groupBy(stream)
        .agg(
            F.sum("__n").alias("records"),
            F.min(number).alias("lowest"),
            F.max(number).alias("highest"),
            F.sum("__gap").alias("missing"),
            F.count_if(F.col("__gap") > 0).alias("gaps"),
            F.sum(F.col("__n") - 1).alias("duplicates"),
        )
    )


def source_order(df: DataFrame, source: str, position: str, time: str, block: int = 100_000) -> DataFrame:
    """(source, time_order): ascending, descending or unordered, by position.

    Neighbours are compared within blocks of positions, and the ends of the
    blocks with each other, so a long source is many tasks.
    """
    dealt = df.withColumn("__block", F.floor(F.col(position) / block))
    w = Window.partitionBy(source, "__block").orderBy(position)
    near = dealt.withColumns({"__up": F.col(time) >= F.lag(time).over(w), "__down": F.col(time) <= F.lag(time).over(w)})
    blocks = near.groupBy(source, "__block").agg(
        F.bool_and("__up").alias("__up"), F.bool_and("__down").alias("__down"),
        F.min_by(time, position).alias("__first"), F.max_by(time, position).alias("__last"),
    )
    last = F.lag("__last").over(Window.partitionBy(source).orderBy("__block"))
    joined = blocks.withColumns({"__over": F.col("__first") >= last, "__under": F.col("__first") <= last})

    def every(*flags: str) -> Column:
        return F.coalesce(F.bool_and(F.coalesce(flags[0], F.lit(True)) & F.coalesce(flags[1], F.lit(True))), F.lit(True))

    up, down = every("__up", "__over"), every("__down", "__under")
    order = F.when(up, "ascending").when(down, "descending").otherwise("unordered")
    return joined.groupBy(source).agg(order.alias("time_order"))


def context(df: DataFrame, scope: list[str], time: Column, seconds: int, row_id: str, of: int) -> DataFrame:
    """Rows of the same scope within so many seconds of one record."""
    centre = df.where(F.col(row_id) == of).select(*scope, time.alias("__at")).limit(1)
    return df.join(centre, scope).where(F.abs(time - F.col("__at")) <= seconds).drop("__at")
