"""Hand-built rows that every operator must bear."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, score double, fp string, size int, __doc string"

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    (1, "Hello world, this is a text."),
    (2, None),
    (3, ""),
    (4, " \n\t \x0b\n"),
    (5, LONG),
    (6, "Hello world, this is a text."),
    (6, "Hello world, this is a text."),
    (7, "1234 5678 !!! ???"),
    (8, "Das ist  ein\r\nText mit Ümläuten und 　 mehr <|endoftext|>"),
    (None, "no id at all"),
    (9, "😀 emoji \x00 nul é"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if i == 3 else "en", None if i in (2, 5) else f"s{(i or 0) % 2}", None, 7, 0.5, "x", 3, "d") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
