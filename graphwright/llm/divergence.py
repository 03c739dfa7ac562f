"""How the sources of a language differ in their words.

Matches of the term pattern are exploded and counted by group; groups are
crossed with the vocabulary that their language keeps, so that absent terms
count as zero; a self-join on language and term sets each two sources side by
side, sums rank the pairs and windows the terms. All arithmetic is on whole
numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents of its language that a kept term is in, at least.
LEAST_DOCUMENTS = 3
#: Terms that a group lists.
LISTED = 200
#: Vocabulary terms that one task crosses with the groups of their language.
CROSSED = 50_000

#: Letters A-Z become lower-case, other ASCII characters but a-z become spaces.
_TERMS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def matches(text: bytes) -> list[bytes]:
    """The matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in UTF-8, A-Z in lower case."""
    return text.translate(_TERMS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group in a batch."""
    for batch in batches:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            found = matches(text)
            n.update(found)
            docs.update(set(found))
        for (lang, source), (n, docs) in groups.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(n), pa.string()),
                    pa.array([source] * len(n), pa.string()),
                    pa.array(list(n), pa.binary()).cast(pa.string()),
                    pa.array(list(n.values()), pa.int64()),
                    pa.array([docs[t] for t in n], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of each group.

    Counts are summed within each batch before they are shuffled, so a group or
    a term with a third of all words is counted in parts.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = plain.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    """The whole part of a / b of non-negative longs."""
    return F.call_function("div", a, b)


def _share(n: Column, size: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / size), three digits at a time: exact for n up to 9 * 10**15."""
    rest, out = n + 1, F.lit(1).cast("long")
    for unit in (1_000_000, 1_000, 1):
        out, rest = out + _div(rest * 1000, size) * unit, (rest * 1000) % size
    return out


def _difference(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(w))


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a group is from others, and in which terms.

    Reads text, lang and source, null as ''; each row is a document. A language
    keeps the terms in at least ``LEAST_DOCUMENTS`` of its documents. A group
    (lang, source) gives a kept term the share p = 1 + floor(10**9 * (n + 1) /
    (N + V)): n its occurrences, N those of all V kept terms. Rows of part
    ``pair`` have another source of the language as item; value is the sum of
    floor((p - q)**2 / q) over all kept terms, with that source's q, or 0 if none
    is kept. Rows of part ``term`` are the first ``LISTED`` kept terms that the
    group has with p over the language's q. Ranks go by value, then item. A
    group without terms has its pairs; an empty table gives no rows.
    """
    counts = written(term_counts(docs), "term-counts")
    vocabulary = written(
        counts.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
        .where(F.col("docs") >= LEAST_DOCUMENTS)
        .drop("docs"),
        "vocabulary",
    )
    kept = written(counts.join(vocabulary, ["lang", "term"]).drop("docs"), "kept-counts")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_size"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    # a group may have no kept term, and a language none at all
    groups = written(
        docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
        .distinct()
        .join(sizes, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["size", "v", "lang_size"]),
        "groups",
    )
    out = _pairs(groups, vocabulary, kept).unionByName(_terms(groups, kept))
    return out.select("lang", "source", "part", "item", "value", "rank")


def _dense(groups: DataFrame, vocabulary: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, term, source, p): every group of a language with every term it keeps.

    The terms of a language are dealt into lots, and its groups are repeated for
    each lot, so that no task gets all of a language.
    """
    lots = 1 + vocabulary.count() // CROSSED
    dealt = vocabulary.select("lang", "term", F.pmod(F.xxhash64("term"), F.lit(lots)).cast("int").alias("lot"))
    each = groups.where("v > 0").select(
        "lang", "source", (F.col("size") + F.col("v")).alias("size"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot")
    )
    none = dealt.join(each, ["lang", "lot"]).select("lang", "term", "source", F.lit(0).cast("long").alias("n"), "size")
    some = kept.select("lang", "term", "source", "n", F.lit(0).cast("long").alias("size"))
    # the sum and the self-join both find the rows dealt out by language and term
    return (
        none.unionByName(some)
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.max("size").alias("size"))
        .select("lang", "term", "source", _share(F.col("n"), F.col("size")).alias("p"))
    )


def _pairs(groups: DataFrame, vocabulary: DataFrame, kept: DataFrame) -> DataFrame:
    dense = _dense(groups, vocabulary, kept)
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = (
        dense.join(other, ["lang", "term"])
        .where("source <> item")
        .groupBy("lang", "source", "item")
        .agg(F.sum(_difference(F.col("p"), F.col("q"))).alias("value"))
    )
    two = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang")
    rows = two.where("source <> item").join(sums, ["lang", "source", "item"], "left").na.fill(0, ["value"])
    return _ranked(rows).withColumn("part", F.lit("pair"))


def _terms(groups: DataFrame, kept: DataFrame) -> DataFrame:
    p = _share(F.col("n"), F.col("size") + F.col("v"))
    q = _share(F.col("lang_n"), F.col("lang_size") + F.col("v"))
    rows = (
        kept.join(groups, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        .where("p > q")
        .select("lang", "source", "item", _difference(F.col("p"), F.col("q")).alias("value"))
    )
    # Spark ranks within each task first, so a group brings few rows to its window
    return _ranked(rows).where(F.col("rank") <= LISTED).withColumn("part", F.lit("term"))
