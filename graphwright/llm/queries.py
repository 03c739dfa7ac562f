"""The queries of this folder's operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    divergence,
    embedding,
    filteraudit,
    langid,
    linededup,
    mixing,
    ordinal,
    passages,
    quality,
    secrets,
    simhash,
    tokenids,
)
from .common import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return tokenids.token_ids(docs, _tokenizer("byte_bpe_50k.json"), end_id=2)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = ordinal.fit(docs, ordinal.grade_of_labels(labels))
    graded = ordinal.grade(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return graded.select("doc_id", "expected_grade", "p_tail", (F.col("p_tail") >= 0.5).alias("kept"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = langid.identify(_table(spark, sf_dir, "documents"))
    return said.select("doc_id", "held_out", "lang_pred", "score")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.bpe_digests(docs, _tokenizer("byte_bpe_50k.tiktoken"), _pattern())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.quality_rules(docs, labels)[0]


def op8_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("deduped").cast("binary"), 256).alias("kept_sha256")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return filteraudit.filter_audit(docs, labels)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content"))
    ledger = shared_folder(spark, "ledger")
    secrets.scan(versions, ledger)
    out = secrets.digests(secrets.findings(versions, ledger))
    return out.withColumnRenamed("path", "doc_id").drop("version", "blob")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_ids,
        op2_simhash,
        op3_passages,
        op4_quality_grade,
        op5_language_id,
        op6_bpe,
        op7_quality_rules,
        op8_embedding,
        op9_mixing,
        op10_line_dedup,
        op11_filter_audit,
        op12_source_divergence,
        op13_secret_scans,
    )
}


#: Equivalent DuckDB SQL where SQL can express the operator.
ORACLE_SQL: dict[str, str] = {
    "op10_line_dedup": r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20
  group by key having count(distinct doc_id) >= 3),
marked as (
  select k.*, c.key is not null and k.doc_id <> c.keeper as gone
  from keyed k left join common c using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""",
    "op11_filter_audit": r"""
with plain as (
  select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         min(doc_id) over (partition by coalesce(text, '')) as least
  from documents),
masks as (
  select doc_id, part,
         (len(words) < 200)::int
         + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
         + 8 * regexp_matches(text, '[#$%&*|]')::int
         + 16 * coalesce(least < doc_id, false)::int as mask
  from plain),
said as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
counts as (
  select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
  from masks left join said using (doc_id) group by part, mask),
f(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a join f b on b.bit <> a.bit join f c on c.bit not in (a.bit, b.bit)
  join f d on d.bit not in (a.bit, b.bit, c.bit) join f e on e.bit not in (a.bit, b.bit, c.bit, d.bit)),
steps as (
  select filter_order, s as step, bits[s] as bit, coalesce(list_sum(bits[1:s - 1]), 0)::int as earlier
  from orders, range(1, 6) t(s)),
done as (
  select part, filter_order, step, bit,
         sum(case when mask & (bit | earlier) = 0 then n else 0 end) as kept,
         sum(case when mask & bit <> 0 and mask & earlier = 0 then n else 0 end) as removed,
         sum(case when mask & bit <> 0 and mask & earlier <> 0 then n else 0 end) as redundant,
         sum(case when mask = bit then n else 0 end) as unique_fails,
         sum(case when mask & bit <> 0 and mask & earlier = 0 then good else 0 end) as good_lost,
         sum(case when mask & bit <> 0 and mask & earlier = 0 then toxic else 0 end) as toxic_lost
  from counts, steps group by part, filter_order, step, bit)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
       redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
       toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
from done""",
    "op12_source_divergence": r"""
with plain as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
words as (
  select doc, lang, source,
         translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from plain),
counts as (select lang, source, term, count(*) as n from words group by lang, source, term),
vocabulary as (
  select lang, term, count(*) as lang_n from words group by lang, term having count(distinct doc) >= 3),
groups as (select distinct lang, source from plain),
sized as (
  select v.lang, count(*) as v, sum(lang_n) as lang_size from vocabulary v group by v.lang),
dense as (
  select g.lang, g.source, v.term, coalesce(c.n, 0) as n, v.lang_n
  from groups g join vocabulary v using (lang) left join counts c using (lang, source, term)),
totals as (select lang, source, sum(n) as size from dense group by lang, source),
shares as (
  select lang, source, term, n,
         1 + (1000000000::hugeint * (n + 1)) // (size + v) as p,
         1 + (1000000000::hugeint * (lang_n + 1)) // (lang_size + v) as q
  from dense join totals using (lang, source) join sized using (lang)),
sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by a.lang, a.source, b.source),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // q as value
  from shares where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::int as rank
from ranked where part = 'pair' or rank <= 200""",
    "op13_secret_scans": r"""
with plain as (select row_number() over () as doc, doc_id, coalesce(text, '') as text from documents),
rules(kind, place, pattern, part, least) as (values
  ('assign', 1, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 2, 'AKIA([A-Z0-9]+)', 0, 20),
  ('hex', 3, '([0-9a-f]+)', 0, 24),
  ('pem', 4, '-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----', 0, 0),
  ('jwt', 5, 'eyJ([A-Za-z0-9_-]{8,})\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 0)),
found as (
  select doc, kind, place, least, string_split_regex(text, pattern) as between,
         regexp_extract_all(text, pattern, 0) as whole, regexp_extract_all(text, pattern, part) as measured
  from plain, rules),
each as (
  select doc, kind, place, least, generate_subscripts(whole, 1) as i, unnest(whole) as match,
         unnest(measured) as measured, unnest(between[1:len(whole)]) as before
  from found),
placed as (
  select *, sum(length(before) + length(match)) over (partition by doc, kind order by i) as stop from each),
spans as (
  select doc, kind, place, stop - length(match) as start,
         kind || ':' || (stop - length(match)) || ':' || stop as span
  from placed where length(measured) >= least)
select any_value(p.doc_id) as doc_id, count(*) filter (where kind = 'assign') as n_assign,
       count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
       sha256(coalesce(string_agg(span, ',' order by start, place) filter (where place <= 3), '')) as base_sha256,
       coalesce(string_agg(span, ',' order by start, place), '') as spans
from plain p left join spans s using (doc) group by doc""",
}
