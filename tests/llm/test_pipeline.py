"""The corpus pipeline against stages worked out by hand."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_text_operators import RANKS, brute_dedup, brute_lines

from graphwright.llm import langid, mixing


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = docs.limit(1).selectExpr("cast(100000 as bigint) as doc_id", "'12 34 -- 56' as text", "lang", "source", "n_chars")
    blank = docs.limit(1).selectExpr("cast(100001 as bigint) as doc_id", "cast(null as string) as text", "lang", "source", "n_chars")
    docs.unionByName(junk).unionByName(blank).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_run(spark, small):
    import base64

    import public_tokenizers
    import tiktoken

    rows = spark.read.parquet(f"{small}/documents.parquet")
    said = {r.doc_id: r.lang_pred for r in langid.identify(rows).collect()}
    assert said[100000] == said[100001] == "und"
    stay = [r for r in rows.collect() if said[r.doc_id] != "und"]
    assert len(stay) == rows.count() - 2
    texts = {doc: text for doc, _, _, text in brute_lines(stay)}
    kept = {doc for doc, _ in brute_dedup(list(texts.items()))}
    source = {r.doc_id: r.source for r in stay}
    left = spark.createDataFrame([(d, texts[d], source[d]) for d in kept], "doc_id long, text string, source string")
    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix(left).collect() if r["size"]}
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = Counter()
    for d, n in times.items():
        if n:
            ids = np.array(encode(texts[d]), "<u4").tobytes()
            want[d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[d].encode()).hexdigest()] += n
    assert Counter(map(tuple, corpus_pipeline.run(spark, small).collect())) == want


def test_near_dedup_keeps_rows_without_id(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    (some,) = docs.where("text is not null").orderBy("doc_id").limit(1).collect()
    rows = [(None, f"a text {i} of its own with words enough to be one", "en", "s", 1) for i in "ab"]
    rows += [(1, "another text altogether, and it comes twice", "en", "s", 2)] * 2 + [(2, some.text, "en", "s", 3), (1, some.text, "de", "s", 3)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, docs.schema), small).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted({(d or 0, t) for d, t, *_ in rows if d != 2})


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == list(corpus_pipeline.COLUMNS), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 0
