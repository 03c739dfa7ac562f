"""Line deduplication across documents.

Each document's lines are exploded to hashes of their normalised keys; the
documents of each hash are counted; hashes in too many documents lose their
lines, and the other lines are put together again by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written


def line_hash(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None if the key is too short.

    The key is the line without ASCII white space at both ends, A-Z in lower
    case.
    """
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, hi, lo): a row for each different key of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, digests = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {line_hash(x, min_chars) for x in text.split("\n")} - {None}
                digests += own
                at += [i] * len(own)
            halves = _halves(digests)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *halves], ["doc_id", "hi", "lo"]
            )

    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .where("doc_id is not null and text is not null")
        .mapInArrow(run, "doc_id long, hi long, lo long")
    )


def _halves(digests: list[bytes]) -> list[pa.Array]:
    pairs = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
    return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, hashes): for each document, the keys whose lines it loses.

    A key in ``min_docs`` or more documents stays only in the largest doc_id
    that holds it. The count is over distinct documents and is merged before
    it is shuffled by key, so a line that a third of all documents hold is
    counted in parts.
    """
    lines = written(line_hashes(docs, min_chars), "line-hashes")
    common = (
        lines.groupBy("hi", "lo", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("hi", "lo")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("hi", "lo", "keeper")
    )
    # a table of its own, so that the join deals both sides out anew and can split a hot line
    common = written(common, "common-lines")
    return (
        lines.join(common, ["hi", "lo"])
        .where("doc_id != keeper")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("hi", "lo")).alias("hashes"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The rows of docs with the repeated lines taken out of their texts.

    Columns n_lines, n_dropped (long) and deduped (string) are added to the
    columns of docs; columns of docs with these names are replaced. A null or
    empty text is one empty line. Rows with one doc_id count as one document.
    Rows with a null doc_id are in no document: they lose no line and their
    lines are not counted. An empty table gives no rows.
    """
    losses = repeated_lines(docs, min_chars, min_docs).withColumnRenamed("doc_id", "id")
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "deduped")]
    # the row as one column, so that no name of docs can clash
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*kept_columns).alias("row"))
    joined = rows.join(losses, "id", "left")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))

    @F.pandas_udf("n_lines long, n_dropped long, deduped string")
    def kept(texts: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        rows = []
        for t, own in zip(texts, hashes, strict=True):
            all_lines = t.split("\n")
            if own is None:
                rows.append((len(all_lines), 0, t))
                continue
            gone = {
                x["hi"].to_bytes(8, "big", signed=True) + x["lo"].to_bytes(8, "big", signed=True)
                for x in own
            }
            stay = [x for x in all_lines if line_hash(x, min_chars) not in gone]
            rows.append((len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "deduped"])

    out = joined.select("row", kept(text, F.col("hashes")).alias("kept"))
    return out.select("row.*", "kept.n_lines", "kept.n_dropped", "kept.deduped")
