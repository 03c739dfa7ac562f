"""Audit of how quality filters interact, for every order of applying them.

Duplicates are found by sorting: texts are dealt out by ranges of (fingerprint,
doc_id) and sorted by fingerprint, text and doc_id, so a row repeats an earlier
document if its predecessor has the same text. What a partition cannot see of
the one before it comes from a table of the partitions' first and last texts.
Each document then is a mask of the filters that it fails. Documents are counted
by part and mask, and what a filter does after a set of others is a sum of these
counts, so all orders are read off one small table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The filters; a filter's place is its bit in a mask.
FILTERS = "ABCDE"
#: Least number of words of a document (A).
LEAST_WORDS = 200
#: Least share of different words in percent (B), most of capitals (C).
DISTINCT, CAPITALS = 50, 3
#: Characters that a document must not hold (D).
SYMBOLS = b"#$%&*|"

_CAPITAL = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))
_ROW = "doc_id long, part string, mask int, at int, open boolean, edge int, text string, least long"


def failures(text: bytes) -> int:
    """The mask of the filters A to D that a text (UTF-8) fails."""
    words = text.split()  # of bytes: at ASCII white space
    points = len(text.translate(None, _CONTINUATION))
    capitals = len(text) - len(text.translate(None, _CAPITAL))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT * len(words)) << 1
        | (100 * capitals > CAPITALS * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def _sorted_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (edge 0), the first text (1) and the last one (2) of a sorted partition.

    ``least`` is the smallest doc_id of the text so far; ``open`` says that the
    row's text is the partition's first, which may have begun before it.
    """
    at = TaskContext.get().partitionId()
    held, least, opening = None, None, True
    for batch in batches:
        rows = []
        ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc_id, part, text in zip(ids, parts, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            if held is None:
                rows.append((None, None, None, at, None, 1, text, None))
                held, least = text, doc_id
            elif text != held:
                held, least, opening = text, doc_id, False
            repeated = least is not None and doc_id is not None and least < doc_id
            rows.append((doc_id, part, failures(text) | repeated << 4, at, opening, 0, None, None))
        yield _batch(rows)
    if held is not None:
        yield _batch([(None, None, None, at, None, 2, held, least)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.int64())
    names = [x.split()[0] for x in _ROW.split(", ")]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
    columns[6] = columns[6].cast(pa.string())
    return pa.RecordBatch.from_arrays(columns, names)


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of docs: which filters its whole text fails.

    Reads doc_id, text and lang. A null text is empty; a null lang is the part
    ''. A row fails E if a smaller doc_id has the same text; rows of one doc_id
    do not repeat each other, and rows without a doc_id neither fail E nor make
    others fail it. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("fingerprint"),
    )
    by_id = F.col("doc_id").asc_nulls_last()
    # doc_id is a key of the ranges, so copies of one text are dealt over many tasks
    dealt = keyed.repartitionByRange(F.col("fingerprint"), by_id)
    rows = written(
        dealt.sortWithinPartitions("fingerprint", "text", by_id)
        .select("doc_id", "part", "text")
        .mapInArrow(_sorted_masks, _ROW),
        "failure-masks",
    )
    ends = rows.where("edge = 2").groupBy("text").agg(F.min("least").alias("since"))
    before = rows.where("edge = 1").join(ends, "text").select("at", "since")
    marked = rows.where("edge = 0").select("doc_id", "part", "mask", "at", "open")
    repeated = F.coalesce(F.col("open") & (F.col("since") < F.col("doc_id")), F.lit(False))
    # one row a partition at most
    return marked.join(F.broadcast(before), "at", "left").select(
        "doc_id", "part", F.when(repeated, F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")).alias("mask")
    )


def counted(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, rows, good, toxic): the documents of each mask, and how many labels call good or toxic.

    A document is good (toxic) if any of its rows in labels has quality (toxic)
    1. Labels without a doc_id or of unknown documents count nothing.
    """
    said = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("long")).alias("good"),
            F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("long")).alias("toxic"),
        )
    )
    # rows without a doc_id stay out of the join: they would meet in one task
    known = masks.where("doc_id is not null").join(said, "doc_id", "left").select("part", "mask", "good", "toxic")
    unknown = masks.where("doc_id is null").select(
        "part", "mask", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic")
    )
    return (
        known.unionByName(unknown)
        .groupBy("part", "mask")
        .agg(
            F.count("*").alias("rows"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
        )
    )


def _orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, earlier, bit): each step of each order, with the mask of what came before it."""
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [
        ("".join(order), i + 1, sum(bits[f] for f in order[:i]), bits[order[i]])
        for order in itertools.permutations(FILTERS)
        for i in range(len(order))
    ]


def _total(where: Column, what: Column) -> Column:
    return F.sum(F.when(where, what).otherwise(F.lit(0))).cast("long")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, filter_order and step, zeros included.

    Columns part, filter_order (the 120 orders of A to E), step (1 to 5), and the
    counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley (long) of the filter at that step within the part: what is left after
    it, what it removes there, what fails it but is gone already, what fails
    nothing else, what it removes that labels call good or toxic, and what it
    removes over all orders together. See ``failure_masks`` and ``counted`` for
    nulls and repeated rows. An empty table has no parts and gives no rows.
    """
    spark = docs.sparkSession
    orders = _orders()
    # what a filter does depends on the set of those before it only
    after = F.array(*[F.struct(F.lit(e).alias("earlier"), F.lit(b).alias("bit")) for e, b in sorted({o[2:] for o in orders})])
    counts = counted(failure_masks(docs), labels).select("*", F.explode(after).alias("s"))
    mask, rows = F.col("mask"), F.col("rows")
    earlier, bit = F.col("s.earlier"), F.col("s.bit")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(earlier) != 0
    # a filter removes a document in the orders that have it before all others that fail
    share = (F.lit(len(orders) // len(FILTERS)) / F.bit_count(mask)).cast("long")
    done = counts.groupBy("part", earlier.alias("earlier"), bit.alias("bit")).agg(
        _total(~fails & ~gone, rows).alias("kept"),
        _total(fails & ~gone, rows).alias("removed"),
        _total(fails & gone, rows).alias("redundant"),
        _total(mask == bit, rows).alias("unique_fails"),
        _total(fails & ~gone, F.col("good")).alias("good_lost"),
        _total(fails & ~gone, F.col("toxic")).alias("toxic_lost"),
        _total(fails, rows * share).alias("shapley"),
    )
    steps = spark.createDataFrame(orders, "filter_order string, step int, earlier int, bit int")
    return done.join(F.broadcast(steps), ["earlier", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
