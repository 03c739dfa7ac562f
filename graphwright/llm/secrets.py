"""Secret scans of histories with a ledger of what has been scanned.

Each version of each path is content-addressed by the SHA-256 of its text. The
ledger is a folder of Parquet batches with a row for each (blob, rule, revision)
that was scanned, and the spans it found, none included. A scan reads the ledger,
looks only for pairs of blob and rule revision that are not in it, appends them as
a batch, and joins the findings back to all versions of all paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import written

_LEDGER = "blob binary, rule string, revision int, starts array<long>, ends array<long>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of a pattern, leftmost first, of at least so many characters.

    ``group`` is the part of the match that ``least`` measures (0: all of it). A
    match that is too short is dropped, but what it covers is not searched
    again. A changed pattern needs another ``revision``: the ledger knows
    patterns by name and revision only.
    """

    name: str
    pattern: str
    least: int = 0
    group: int = 0
    revision: int = 1
    any_case: bool = False

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end (exclusive) of each match, in code points."""
        found = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)).finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


ASSIGN = Rule(
    "assign",
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    least=6,
    group=2,
    any_case=True,
)
# the possessive runs below are those of [A-Z0-9]+ and [0-9a-f]+ that are long enough
ACCESS = Rule("access", r"AKIA[A-Z0-9]{16,}+")
HEX = Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+")
#: Formats that issuers publish, beside the three kinds above.
PEM = Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
JWT = Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
BASE = (ASSIGN, ACCESS, HEX)
RULES = (*BASE, PEM, JWT)


def addressed(versions: DataFrame) -> DataFrame:
    """(path, version, blob): the content address of every row of versions."""
    return versions.select("path", "version", _blob())


def _blob() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("content").cast("string"), F.lit("")), 256)).alias("blob")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the ledger in a folder, once each; none if there is no folder yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(folder).dropDuplicates(["blob", "rule", "revision"])


def _searched(rules: tuple[Rule, ...]):
    """A function over batches of (blob, content, seen): the rows of the ledger that are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob, text, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = set(seen or ())
                for rule in rules:
                    if f"{rule.name}:{rule.revision}" not in known:
                        spans = rule.spans(text)
                        rows.append((blob, rule.name, rule.revision, [s for s, _ in spans], [e for _, e in spans]))
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["blob", "rule", "revision", "starts", "ends"]
            )

    return run


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Search the blobs of versions for the rules that the ledger lacks, append the findings, count them.

    ``versions`` has path, version and content; ``ledger`` is a folder that all
    executors share. Copies of a text are one blob, merged within tasks before
    they are shuffled, and are searched once for each rule and revision; a
    second scan of the same rows searches nothing. The batch appears in the
    ledger when its job commits, so an interrupted scan leaves nothing behind
    and is repeated as a whole. Two scans at a time may search a blob twice;
    readers see it once.
    """
    spark = versions.sparkSession
    known = F.concat_ws(":", "rule", "revision")
    wanted = [f"{r.name}:{r.revision}" for r in rules]
    seen = read_ledger(spark, ledger).where(known.isin(wanted)).groupBy("blob").agg(F.collect_set(known).alias("seen"))
    blobs = versions.select(_blob(), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))
    unseen = (
        blobs.dropDuplicates(["blob"])
        .join(seen, "blob", "left")
        .where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
        .select("blob", "content", "seen")
    )
    added = Observation()
    batch = unseen.mapInArrow(_searched(tuple(rules)), _LEDGER).observe(added, F.count("*").alias("rows"))
    batch.write.mode("append").parquet(ledger)
    return added.get["rows"]


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, version, blob, found): the ledger's findings at every version of every path.

    ``found`` has a struct (rule, starts, ends) for each of the rules, or is null
    for a text that no scan has seen. Null content is an empty text; rows repeated in versions come as often here;
    null paths and versions stay null. An empty table gives no rows.
    """
    spark = versions.sparkSession
    current = F.concat_ws(":", "rule", "revision").isin([f"{r.name}:{r.revision}" for r in rules])
    found = (
        read_ledger(spark, ledger)
        .where(current)
        .groupBy("blob")
        .agg(F.collect_list(F.struct("rule", "starts", "ends")).alias("found"))
    )
    # both sides are tables, so that the join can split a blob that very many versions share
    return written(addressed(versions), "versions").join(written(found, "findings"), "blob", "left").select("path", "version", "blob", "found")


def digests(found: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``findings`` with spans, base_sha256 and n_<rule> for each base rule.

    Spans are ``rule:start:end`` by start, then in the order of the rules, joined
    by commas; base_sha256 is the lower-case hex SHA-256 of the base rules' alone.
    """
    order = {r.name: i for i, r in enumerate(rules)}
    names = [r.name for r in base]
    schema = ", ".join(f"n_{n} long" for n in names) + ", base_sha256 string, spans string"

    @F.pandas_udf(schema)
    def digest(found: pd.Series) -> pd.DataFrame:
        rows = []
        for own in found:
            spans = sorted(
                (s, order[x["rule"]], e, x["rule"]) for x in (own if own is not None else ()) for s, e in zip(x["starts"], x["ends"], strict=True)
            )
            texts = [(name, f"{name}:{s}:{e}") for s, _, e, name in spans]
            base_text = ",".join(t for name, t in texts if name in names)
            counts = [sum(name == n for name, _ in texts) for n in names]
            rows.append((*counts, hashlib.sha256(base_text.encode()).hexdigest(), ",".join(t for _, t in texts)))
        return pd.DataFrame(rows, columns=[*(f"n_{n}" for n in names), "base_sha256", "spans"])

    return found.select("path", "version", "blob", digest("found").alias("d")).select("path", "version", "blob", "d.*")
