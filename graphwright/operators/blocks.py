"""Running values over keys of any size: windows over blocks of time within a key.

A window that runs over a whole key is one task, however many rows the key has.
Here a key's rows are dealt out by blocks of time too; a window runs within each
block, and what a block passes on is carried over by a window of one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Whole numbers of a time column that a block spans (a day, if they are seconds).
SPAN = 86_400


def block_of(df: DataFrame, time: str, span: int = SPAN) -> Column:
    """The block of a time: its day, or so many units of a number."""
    kind = dict(df.dtypes)[time]
    if kind.startswith(("timestamp", "date")):
        return F.unix_date(F.to_date(time)).cast("long")
    return F.floor(F.col(time) / span).cast("long")


def carried(rows: DataFrame, keys: list[str], order: list, known: Column, block: Column, name: str) -> DataFrame:
    """rows with ``name``: the last non-null ``known`` of the keys up to each row, itself included.

    order: columns or names that grow with the block. Rows without a key or a
    block know only of rows like them in their block, which is none by equality:
    they get null.
    """
    whole = block.isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    dealt = rows.withColumn("__known", F.when(whole, known)).withColumn("__block", block)
    by = [*keys, "__block"]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("__known").isNotNull(), F.struct(*order, F.col("__known").alias("__last"))))
    ends = dealt.groupBy(*by).agg(last.getField("__last").alias("__v"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    passed = ends.withColumn("__passed", F.last("__v", ignorenulls=True).over(before)).drop("__v")
    own = dealt.withColumn("__own", F.last("__known", ignorenulls=True).over(inside))
    out = own.join(passed, by, "left").withColumn(name, F.coalesce("__own", "__passed"))
    return out.select(*rows.columns, name)


def running(rows: DataFrame, keys: list[str], order: list, block: Column, values: dict) -> DataFrame:
    """rows with the running sum or bit_xor (name: (function, column)) of the keys up to each row, itself included.

    order: columns that grow with the block; keys and blocks are not null. A null
    counts as zero.
    """
    zero = F.lit(0).cast("long")
    dealt = rows.withColumn("__block", block)
    by = [*keys, "__block"]
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*by).agg(*(f(c).alias(n) for n, (f, c) in values.items()))
    passed = parts.select(*by, *(F.coalesce(f(n).over(before), zero).alias(f"__{n}") for n, (f, _) in values.items()))
    own = dealt.withColumns({n: F.coalesce(f(c).over(inside), zero) for n, (f, c) in values.items()})
    joined = {F.sum: lambda a, b: a + b, F.bit_xor: lambda a, b: a.bitwiseXOR(b)}
    out = own.join(passed, by)
    return out.select(*rows.columns, *(joined[f](F.col(n), F.col(f"__{n}")).alias(n) for n, (f, _) in values.items()))
