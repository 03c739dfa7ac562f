"""Process instances by the start and end records of reused ids, and their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .blocks import block_of, carried


def lineage(df: DataFrame, keys: list[str], pid: str, parent_pid: str, at: str, sequence: str, position: str) -> tuple[DataFrame, DataFrame]:
    """The instances of processes, and which instance each row belongs to.

    df has the keys (a terminal, a clock), pid and parent_pid, a time, a sequence,
    a position that orders rows of one time, and whether a row ``starts`` or
    ``ends`` its process. Rows of one sequence are known to come in the order of
    their positions; those of others are not when their times are equal.

    An instance of a pid opens at a row that starts it, or at the first row when
    none is open, and is open until a row that ends it. A row that ends a pid at
    a time when another sequence starts or ends it too is ambiguous: it closes
    what is open and belongs to none. The parent is the instance of parent_pid
    that is open just before the instance opens.

    The first table is (keys, process, pid, first_seen, last_seen, rows, parent,
    outcome): process and parent are positions of opening rows; outcome is
    parent, no_parent_pid, own_pid, ambiguous (another sequence starts or ends
    the parent's pid at that very time) or not_open. The second is (position,
    process), process null for an ambiguous end. Rows without a pid or time are
    left out.
    """
    by = [*keys, pid]
    rows = df.where(F.col(pid).isNotNull() & F.col(at).isNotNull())
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("starts", "ends")})
    edge = F.col("starts") | F.col("ends")
    bounds = written(
        rows.where(edge).groupBy(*by, at).agg(F.min(sequence).alias("__least"), F.max(sequence).alias("__most")), "boundaries"
    )
    other = (F.col("__least") != F.col(sequence)) | (F.col("__most") != F.col(sequence))
    marked = rows.join(bounds, [*by, at], "left").withColumn("__unclear", F.col("ends") & F.coalesce(other, F.lit(False)))
    marked = written(marked.drop("__least", "__most").withColumn("__at", F.struct(at, position)), "observations")

    block = block_of(marked, at)
    # whether the last row up to here closed the pid; the row before is what counts
    w = Window.partitionBy(*by, "__block").orderBy(at, position)
    near = marked.withColumn("__block", block).withColumn("__before", F.lag("ends").over(w))
    lasts = near.groupBy(*by, "__block").agg(F.max_by("ends", F.col("__at")).alias("__ended"))
    across = Window.partitionBy(*by).orderBy("__block")
    lasts = lasts.withColumn("__passed", F.lag("__ended").over(across)).drop("__ended")
    closed = F.coalesce("__before", "__passed", F.lit(True))
    near = near.join(lasts, [*by, "__block"]).withColumn("__opens", ~F.col("__unclear") & (F.col("starts") | closed))
    near = written(near.drop("__before", "__passed", "__block"), "openings")
    opener = F.when(F.col("__opens"), F.col(position))
    told = carried(near, by, [at, position], opener, block_of(near, at), "process")
    told = written(told.withColumn("process", F.when(~F.col("__unclear"), F.col("process"))), "instances")

    spans = told.where("process is not null").groupBy(*by, "process").agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("rows")
    )
    # what is open after each row of a pid, for the children that ask for it
    state = F.struct(F.when(~F.col("ends"), F.col("process")).alias("open"))
    after = told.select(*by, at, position, F.lit(1).alias("__side"), state.alias("__state"))
    asked = told.where(F.col("__opens")).select(
        *keys, F.col(parent_pid).alias(pid), at, position, F.lit(0).alias("__side"), F.lit(None).cast(after.schema["__state"].dataType).alias("__state"),
        F.col(pid).alias("__child_pid"), F.col("process").alias("__child"), F.col(sequence).alias("__sequence"),
    )
    both = after.unionByName(asked, allowMissingColumns=True)
    # at a child's own place the child asks before the row counts
    held = carried(both, by, [at, position, "__side"], F.col("__state"), block_of(both, at), "__held").where("__side = 0")
    held = held.join(bounds, [*by, at], "left")
    clash = (F.col("__least") != F.col("__sequence")) | (F.col("__most") != F.col("__sequence"))
    outcome = (
        F.when(F.col(pid).isNull(), "no_parent_pid")
        .when(F.col(pid) == F.col("__child_pid"), "own_pid")
        .when(clash, "ambiguous")
        .when(F.col("__held.open").isNull(), "not_open")
        .otherwise("parent")
    )
    parents = held.select(*keys, F.col("__child").alias("process"), F.col("__child_pid").alias(pid), F.col("__held.open").alias("parent"), outcome.alias("outcome"))
    parents = parents.withColumn("parent", F.when(F.col("outcome") == "parent", F.col("parent")))
    return spans.join(parents, [*by, "process"]), told.select(position, "process")
