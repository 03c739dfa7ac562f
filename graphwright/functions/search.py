"""Search terms over a record's fields, as Columns to join with & | and ~.

A term is a field, an operator (== != >= <= > < contains) and a wanted text.
``!=`` holds if the field exists and no value equals; any other operator, if
some value satisfies it. Order compares decimals of any length, else instants;
a value of the other kind never satisfies it. A field is known by its name, else
by the end of one after a dot.

Where the fields of all records are columns, ``term`` takes these by name: the
field is looked up when the plan is built, so a scan reads the columns that are
asked for only, and order on numeric columns reaches the scan. Where each
record has fields of its own, they are ``array<struct<name, value>>``, and
``compare`` and ``mentions`` look into that.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The operators of a term.
OPERATORS = ("==", "!=", ">=", "<=", ">", "<", "contains")
_DECIMAL = r"^[+-]?\d+(\.\d+)?$"
#: Decimals that fit a decimal(38, 10), but for zeros at their ends.
_SHORT = r"^[+-]?0*\d{1,28}(\.\d{1,10}0*)?$"
#: Types whose order is that of their decimal text.
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "decimal", "float", "double")


class SearchError(ValueError):
    """What is wrong with a term."""


def decimal_key(text: Column) -> Column:
    """A struct that orders decimals of any number of digits; null if not a decimal."""
    whole = F.regexp_extract(text, r"^[+-]?0*(\d*?)(\.\d+)?$", 1)
    fraction = F.regexp_replace(F.regexp_extract(text, r"\.(\d+)$", 1), "0+$", "")
    zero = (whole == "") & (fraction == "")
    sign = F.when(zero, 0).when(text.startswith("-"), -1).otherwise(1)
    # digits of negative numbers are complemented so that structs still compare in order
    size = F.when(sign < 0, -F.length(whole)).otherwise(F.length(whole))
    padded = F.concat(fraction, F.lit(" "))

    def ordered(c: Column) -> Column:
        return F.when(sign < 0, F.translate(c, "0123456789 ", "9876543210~")).otherwise(c)

    return F.when(
        text.rlike(_DECIMAL),
        F.struct(sign.alias("sign"), size.alias("size"), ordered(whole).alias("whole"), ordered(padded).alias("part")),
    )


def _ordered(value: Column, op: str, want: str) -> Column:
    def compare(a: Column, b: Column) -> Column:
        return {">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b}[op]

    if re.match(_DECIMAL, want):
        out = compare(decimal_key(value), decimal_key(F.lit(want)))
        if re.match(_SHORT, want):  # most values are short, and cheap to compare
            small = F.lit(want).cast("decimal(38,10)")
            out = F.when(value.rlike(_SHORT), compare(value.try_cast("decimal(38,10)"), small)).otherwise(out)
    else:
        out = compare(F.try_to_timestamp(value), F.try_to_timestamp(F.lit(want)))
    return F.coalesce(out, F.lit(False))


def _checked(op: str, want: str) -> None:
    if op not in OPERATORS:
        raise SearchError(f"operator {op}")
    if not isinstance(want, str):
        raise SearchError("a wanted value is a text")


def _satisfied(value: Column, op: str, want: str) -> Column:
    """Whether one value satisfies an operator other than !=; never null."""
    if op == "==":
        hit = F.lower(value) == want.lower()
    elif op == "contains":
        hit = F.contains(F.lower(value), F.lit(want.lower()))
    else:
        return _ordered(value, op, want)
    return F.coalesce(hit, F.lit(False))


def named_fields(df: DataFrame, **names: str) -> dict[str, tuple[Column, str]]:
    """Fields of df for ``term``: name to (column, type); names: column to field name."""
    kinds = dict(df.dtypes)
    return {names.get(c, c): (F.col(c), kinds[c]) for c in df.columns}


def term(fields: dict[str, tuple[Column, str]], field: str, op: str, want: str) -> Column:
    """Whether the columns of a record satisfy one term; never null.

    A field that no column has, and one whose columns are all null, is absent: it
    satisfies no term, != included, as in ``compare``. Order on a numeric column
    reaches the scan as it is.
    """
    _checked(op, want)
    own = [fields[field]] if field in fields else [v for n, v in fields.items() if n.endswith("." + field)]
    if not own:
        return F.lit(False)
    if op == "!=":
        equal = [_satisfied(c.cast("string"), "==", want) for c, _ in own]
        there = reduce(lambda a, b: a | b, (c.isNotNull() for c, _ in own))
        return there & ~reduce(lambda a, b: a | b, equal)
    hits = []
    for column, kind in own:
        if kind.startswith(_NUMERIC) and op not in ("==", "contains"):
            hits.append(_numeric(column, kind, op, want))
        else:
            hits.append(_satisfied(column.cast("string"), op, want))
    return reduce(lambda a, b: a | b, hits)


def _numeric(column: Column, kind: str, op: str, want: str) -> Column:
    """Order of a numeric column, in a form that a scan can use."""
    if not re.match(_DECIMAL, want):
        return F.lit(False)
    real = kind in ("float", "double")
    if not real and not re.match(_SHORT, want):
        return _ordered(column.cast("string"), op, want)
    bound = F.lit(want).cast("double" if real else f"decimal(38,{len(want.partition('.')[2])})")
    hit = {">=": column >= bound, "<=": column <= bound, ">": column > bound, "<": column < bound}[op]
    there = column.isNotNull() & ~F.isnan(column) if real else column.isNotNull()
    return hit & there


def mentioned(fields: dict[str, tuple[Column, str]], text: str) -> Column:
    """Whether any of the columns holds the text, without case."""
    hits = [_satisfied(c.cast("string"), "contains", text) for c, _ in fields.values()]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def _named(name: Column, field: str) -> Column:
    return (name == field) | name.endswith("." + field)


def compare(fields: Column, field: str, op: str, want: str) -> Column:
    """Whether a record's own fields (an array) satisfy one term.

    A field without a value is not held: != is of fields that hold a value and
    none equal to the one wanted.
    """
    _checked(op, want)
    exact = F.exists(fields, lambda f: f["name"] == field)
    own = F.filter(
        fields, lambda f: F.when(exact, f["name"] == field).otherwise(_named(f["name"], field))
    )
    if op == "!=":
        none = ~F.exists(own, lambda f: _satisfied(f["value"], "==", want))
        held = F.exists(own, lambda f: f["value"].isNotNull())
        return F.coalesce(held & none, F.lit(False))
    return F.coalesce(F.exists(own, lambda f: _satisfied(f["value"], op, want)), F.lit(False))


def mentions(fields: Column, text: str) -> Column:
    """Whether any of a record's own fields (an array) holds the text, without case."""
    return F.coalesce(F.exists(fields, lambda f: _satisfied(f["value"], "contains", text)), F.lit(False))
