"""Decimal texts with zeros at their ends."""

from __future__ import annotations

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from graphwright.functions import search


@pytest.mark.parametrize("op", [">=", "<=", ">", "<"])
def test_padded_decimals(spark, op):
    texts = ["0" * 40 + "123.4500", "-" + "0" * 40 + "123.45", "+0123.45" + "0" * 40, "123.4500000000000000001", "123.45", "-123.4500000000000000001",
             "0" * 50, "-" + "0" * 41 + ".0", "9" * 28, "9" * 29, "0" * 9 + "9" * 29 + ".5", "1e2", " 1", "", "."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for want in ("123.45", "-123.45", "0", "9" * 28):
        got = {r.t for r in df.where(search.term({"t": (F.col("t"), "string")}, "t", op, want)).collect()}
        own = [t for t in texts if re.match(search._DECIMAL, t)]
        test = {">=": Decimal.__ge__, "<=": Decimal.__le__, ">": Decimal.__gt__, "<": Decimal.__lt__}[op]
        assert got == {t for t in own if test(Decimal(t), Decimal(want))}


def test_zeros_at_the_ends_are_no_digits():
    assert re.match(search._SHORT, "0" * 40 + "123.45" + "0" * 40)
    assert not re.match(search._SHORT, "1" + "0" * 28)
    assert not re.match(search._SHORT, "0.00000000001")
