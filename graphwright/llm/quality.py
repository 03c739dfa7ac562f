"""Quality rules learned as a decision list, in DataFrame operations only.

Statistics of each text are column expressions. Sequential covering learns from
labelled statistics: a rule grows by the threshold condition of best gain,
counted over bins of each statistic, is pruned on rows it was not grown on, and
is accepted if it is precise there; the rows it covers leave, and the next rule
grows. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Labelled documents that rules are learned from, at most (about; by hash).
LABELLED = 50_000
BINS = 24
#: Statistics that conditions may test, by name.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "repeat_share": "n_repeat_words / n_words",
    "dup_lines": "cast(n_dup_lines as double)",
    "upper_share": "n_upper / word_chars",
    "mark_share": "n_marks / word_chars",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return F.coalesce(c > self.threshold if self.above else c <= self.threshold, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """A document that meets all conditions is of low quality."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        parts = (f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)
        return " and ".join(parts)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text; a null text has no words.

    n_repeat_words counts the words inside windows of eight words that come
    twice or more in the text. Windows are hashed and sorted within the row;
    where any repeat, their positions are sorted by hash and neighbours with
    one hash are the repeated windows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spaces = F.regexp_count("text", F.lit(SPACES))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    df = df.select(
        "doc_id",
        F.filter(F.split("text", SPACES + "+"), lambda w: w != "").alias("words"),
        (F.length("text") - spaces).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[!?,;:]")).cast("long").alias("n_marks"),
        F.filter(
            F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))
        ).alias("lines"),
    )
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    ).drop("lines")
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("windows", F.when(F.size("words") >= WINDOW, windows).otherwise(none)).drop("words")
    df = df.withColumn("ordered", F.sort_array("windows"))
    again = F.exists(
        F.sequence(F.lit(1), F.greatest(F.size("ordered") - 1, F.lit(1))),
        lambda i: F.coalesce(F.get("ordered", i) == F.get("ordered", i - 1), F.lit(False)),
    )
    df = df.withColumn("again", again).drop("ordered")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(F.col("again"), placed)).drop("windows")

    def repeated(p: Column, k: Column) -> Column:
        before, after = F.get("placed", k - 1)["h"], F.get("placed", k + 1)["h"]
        return F.coalesce(p["h"] == before, F.lit(False)) | F.coalesce(p["h"] == after, F.lit(False))

    df = df.withColumn("found", F.filter("placed", repeated)).drop("placed")
    df = df.withColumn("at", F.sort_array(F.transform("found", lambda p: p["i"]))).drop("found")
    steps = F.transform(
        "at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW)))
    )
    covered = F.aggregate(steps, F.lit(0), lambda total, n: total + n)
    repeat = F.coalesce(covered, F.lit(0)).cast("long")
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"), "n_upper", "n_marks"
    )


def with_features(stats: DataFrame) -> DataFrame:
    """stats with the columns that conditions test; null where a share has no base."""
    share = {k: F.try_divide(*map(F.col, v.split(" / "))) if " / " in v else F.expr(v) for k, v in FEATURES.items()}
    return stats.withColumns({k: c for k, c in share.items() if k not in stats.columns})


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    """FOIL's gain of a condition that leaves p1 of p0 and n1 of n0 rows."""
    if not p1:
        return 0.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def learn(
    labelled: DataFrame, most_rules: int = 10, most_conditions: int = 4, precision: float = 0.95, least: int = 10
) -> list[Rule]:
    """Rules for low quality from rows with statistics, doc_id and bad (boolean).

    The driver sees counts by bin, never rows. Two thirds of the rows grow
    rules and the rest prune them and decide. Without labelled rows, or without
    a precise rule, the list is empty.
    """
    names = list(FEATURES)
    rows = with_features(labelled).select("doc_id", F.col("bad").cast("int").alias("bad"), *names)
    rows = rows.where("bad is not null")
    cuts_at = [k / BINS for k in range(1, BINS)]
    # quantiles of each class, as the rarer one would hardly show in those of all
    q = rows.groupBy("bad").agg(
        *(F.percentile_approx(f, F.lit(cuts_at), F.lit(2000)).alias(f) for f in names)
    )
    found = q.collect()
    cuts = {f: sorted({float(x) for r in found for x in r[f] or []}) for f in names}
    if len(found) < 2:
        return []

    def bin_of(f: str) -> Column:
        # number of cuts below the value
        cut = F.array(*map(F.lit, cuts[f])) if cuts[f] else F.array().cast("array<double>")
        return F.when(F.col(f).isNull(), -1).otherwise(F.size(F.filter(cut, lambda c: c < F.col(f))))

    binned = written(
        rows.select(
            "bad",
            (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow"),
            *names,
            *(bin_of(f).alias(f"bin_{f}") for f in names),
        ),
        "labelled-bins",
    )
    pairs = ", ".join(f"'{f}', bin_{f}" for f in names)
    rules: list[Rule] = []
    left = binned
    while len(rules) < most_rules:
        conditions: list[Condition] = []
        covered = left.where("grow")
        while len(conditions) < most_conditions:
            counts = (
                covered.selectExpr("bad", f"stack({len(names)}, {pairs}) as (feature, bin)")
                .groupBy("feature", "bin")
                .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
                .collect()
            )
            best = _best(counts, cuts)
            if best is None:
                break
            gain, condition, clean = best
            if gain <= 0.01 or condition in conditions:
                break
            conditions.append(condition)
            covered = covered.where(condition.column())
            if clean:
                break
        if not conditions:
            break
        prefixes = [Rule(tuple(conditions[: k + 1]), 0, 0) for k in range(len(conditions))]
        held = left.where("not grow").agg(
            *(F.count_if(r.column() & (F.col("bad") == b)).alias(f"c{k}_{b}") for k, r in enumerate(prefixes) for b in (0, 1))
        ).first()
        scored = [(held[f"c{k}_1"], held[f"c{k}_0"], r) for k, r in enumerate(prefixes)]
        p, n, rule = max(scored, key=lambda s: ((s[0] - s[1]) / max(s[0] + s[1], 1), s[0], -len(s[2].conditions)))
        if p < least or p < precision * (p + n):
            break
        rules.append(Rule(rule.conditions, p / (p + n), p + n))
        left = left.where(~rule.column())
    return rules


def _best(counts: list, cuts: dict[str, list[float]]) -> tuple[float, Condition, bool] | None:
    """The condition of best gain, from the class counts of each bin."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r.feature, {})[r.bin] = (r.p, r.n)
    best = None
    for feature in sorted(by):
        bins = by[feature]
        p0, n0 = (sum(x[k] for x in bins.values()) for k in (0, 1))
        if not p0 or not n0:
            return None
        p = n = 0
        known = [sum(x[k] for b, x in bins.items() if b >= 0) for k in (0, 1)]
        for k, cut in enumerate(cuts[feature]):
            p, n = p + bins.get(k, (0, 0))[0], n + bins.get(k, (0, 0))[1]
            for above, a, b in ((False, p, n), (True, known[0] - p, known[1] - n)):
                gain = _gain(p0, n0, a, b)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, Condition(feature, above, cut), not b)
    return best


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression: false by the first rule met."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(False)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[DataFrame, list[Rule]]:
    """Statistics, base_failed and kept of each row of docs, and the rules.

    Reads doc_id and text of docs, doc_id and quality (0: low) of labels. Rows
    of labels with a null are left out; of several labels of a doc_id the least
    counts. About ``labelled`` labels, by hash of doc_id, are learned from. An
    empty table gives no rows; no labels give no rules, so only the base rule
    (under 20 words, or over 30 % of the words repeated) applies.
    """
    stats = written(statistics(docs), "statistics")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    total = known.count()
    if total > labelled:
        upto = int(labelled / total * (1 << 53))
        known = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < upto)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = stats.where(~base_failed).join(known, "doc_id").withColumn("bad", F.col("quality") == 0)
    rules = learn(rows)
    out = with_features(stats).withColumn("base_failed", base_failed)
    out = out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules)))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_upper", "n_marks"
    ), rules
