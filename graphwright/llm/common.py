"""What several operators share: shared storage, batching and link components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import dropped, shared_folder, written

__all__ = ["SPACE", "WORD", "components", "dropped", "merged", "shared_folder", "whole_groups", "written"]

#: Regular expression of a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters between words.
SPACE = " \t\n\x0b\x0c\r"


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows: int
) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows from batches sorted by ``keys``.

    No group of equal keys is split over two tables.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        start = _last_start(table, keys)
        if start:
            yield table.slice(0, start)
            table = table.slice(start)
        held, count = table.combine_chunks().to_batches(), table.num_rows
        if not start:
            rows = max(rows, 2 * count)
    if count:
        yield pa.Table.from_batches(held)


def _last_start(table: pa.Table, keys: list[str]) -> int:
    """Index of the first row of the last group."""
    start = 0
    for key in keys:
        values = table[key].to_numpy()
        change = np.flatnonzero(values[1:] != values[:-1])
        if len(change):
            start = max(start, int(change[-1]) + 1)
    return start


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets that root describes along links a-b; roots are the minima."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as links (a, b).

    Alternates the large-star and small-star steps: each round points nodes at
    the least neighbour seen, until every node points at the least node of its
    component. Each round is a shuffle over the links, written to the shared
    folder; nothing is gathered in one place. Nodes without a link to another
    node and links with a null end give no row.
    """
    a, b = F.col("a"), F.col("b")
    e = written(
        edges.where(a != b)
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    before = _signature(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("u"), F.col("m").alias("v")),
                        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    )
                ).alias("s")
            )
            .select("s.u", "s.v")
            .where("u != v")
            .distinct()
        )
        following = written(small, "links")
        after = _signature(following)
        dropped(e)
        e = following
        if after == before:
            break
        before = after
    root = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return root.union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
