"""Mixing sources to target weights by hash thresholds.

Words are summed by source and by the leading bits of a document's hash. In
each source the documents of whole buckets below the budget are taken; only the
bucket in which the budget ends is cut finer, by the next bits, until it holds
one document. A threshold on the hash then says which documents are taken: no
sort, and a smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, written

#: Bits of the hash that one histogram resolves.
STEP = 12
#: Sources up to this number are joined as a broadcast table of thresholds.
BROADCAST_SOURCES = 100_000


def targets(
    sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> dict[str | None, float]:
    """Words that each source gives to the mix.

    Sources in code point order (null last) take the weights in turn and share
    ``share`` times all words by them. No target exceeds ``most`` times its
    source's words; the excess goes to the others by weight, again and again.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left = Fraction(share) * sum(sizes.values())
    out: dict[str | None, Fraction] = {}
    free = list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not over:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return {s: float(out[s]) for s in order}


def _by_source(spark, rows: list[tuple], schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_SOURCES else table


def thresholds(sized: DataFrame, budgets: dict[str | None, int]) -> dict[str | None, int]:
    """For each source the hash below which documents sum to about its budget.

    The sums below the thresholds are the nearest to the budgets that whole
    documents reach. The driver holds one row for each source.
    """
    spark = sized.sparkSession
    state = {s: (0, b) for s, b in budgets.items() if b > 0}  # prefix so far, words left
    done = {s: 0 for s in budgets if s not in state}
    for shift in range(60 - STEP, -1, -STEP):
        if not state:
            break
        # a stop is the prefix of the boundary bucket on the level above
        stops = _by_source(
            spark, [(s, p, b) for s, (p, b) in state.items()], "s string, prefix long, budget long"
        )
        inside = sized.join(
            stops,
            F.col("source").eqNullSafe(F.col("s"))
            & (F.shiftright("h", shift + STEP) == F.col("prefix")),
        )
        sums = inside.groupBy("s", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("budget").alias("budget")
        )
        w = Window.partitionBy("s").orderBy("bucket")
        cut = (
            sums.withColumn("upto", F.sum("words").over(w))
            .where("upto > budget and upto - words <= budget")
            .select("s", "bucket", "words", "rows", (F.col("upto") - F.col("words")).alias("below"), "budget")
            .collect()
        )
        found = {r.s: r for r in cut}
        following = {}
        for s, (prefix, budget) in state.items():
            r = found.get(s)
            if r is None:  # all of it is within the budget
                done[s] = (prefix + 1) << (shift + STEP)
            elif r.rows == 1 or shift == 0:
                rest = budget - r.below
                done[s] = (r.bucket + (2 * rest >= r.words)) << shift
            else:
                following[s] = (r.bucket, budget - r.below)
        state = following
    return done


def _measures(docs: DataFrame) -> list[Column]:
    """The source, size and place on the hash line of each row of docs."""
    text = F.col("text").cast("string")
    return [
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        # 60 bits, so that all arithmetic on them stays within a long
        F.shiftrightunsigned(F.xxhash64("doc_id", text), 4).alias("h"),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of each row and its place on the hash line."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_measures(docs))


def _decisions(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(s, source_size, target, passes, below): what the mix takes of each source of measured rows."""
    totals = {r.source: r.words for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    goal = targets(totals, weights, share, most)
    passes = {s: min(int(goal[s] // n), most) if n else 0 for s, n in totals.items()}
    limit = thresholds(sized, {s: round(goal[s] - passes[s] * n) for s, n in totals.items()})
    return _by_source(
        sized.sparkSession,
        [(s, totals[s], goal[s], passes[s], limit[s]) for s in totals],
        "s string, source_size long, target double, passes int, below long",
    )


def _times(most: int) -> Column:
    """How often the mix takes a row."""
    once_more = (F.col("h") < F.col("below")).cast("int")
    return F.least(F.col("passes") + once_more, F.lit(most))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of docs.

    Reads doc_id, text and source. taken is the words that the mix takes of the
    row: its size times the full passes over its source, and once more if its
    hash is below the threshold for what is left of the target. A null text has
    no words; null sources are one source, the last in order. Repeated rows are
    taken together. An empty table gives no rows. The result is a function of
    the rows alone, whatever their order or partitions.
    """
    sized = written(measured(docs), "sizes")
    table = _decisions(sized, weights, share, most)
    return sized.join(table, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _times(most)).cast("long").alias("taken")
    )


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it.

    Each row is decided by its own hash and its source's threshold, as in
    ``mix``, so rows that share a doc_id, or have none, are as many words here as
    there. Rows repeated as a whole are taken together. A row without a word adds
    nothing to the mix and is not taken. An empty table gives no rows.
    """
    sized = written(measured(docs), "sizes")
    table = _decisions(sized, weights, share, most)
    # the row as one column, so that no name of docs can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_measures(docs)).where("size > 0")
    taken = rows.join(table, F.col("source").eqNullSafe(F.col("s"))).withColumn("times", _times(most)).where("times > 0")
    out = taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
    dropped(sized)
    return out
