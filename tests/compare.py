"""Rows of both engines in one form."""

from __future__ import annotations


def normal(value):
    """A value as both engines show it."""
    import datetime
    import decimal
    import math

    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return float(f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    return value


def same_rows(df, con, sql: str) -> None:
    """Assert that a DataFrame and DuckDB's answer hold the same rows."""
    from collections import Counter

    other = con.execute(sql)
    names = [d[0] for d in other.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(map(normal, r)) for r in other.fetchall())
    got = Counter(tuple(normal(r[n]) for n in names) for r in df.collect())
    assert got == want
