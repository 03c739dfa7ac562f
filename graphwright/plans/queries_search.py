"""Queries of the search surface over the graph of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import epoch_s
from ..operators import graph, logons, patterns, searching
from ..plans.storage import written
from ..sources import lines
from .queries_graph import _EVIDENCE, _KINDS, _NODES, evidence, named, numbered
from .queries_records import _access_lines, event_fields
from .registry import query, table

_MATCHED = _EVIDENCE + """
, m as (select distinct dst as node from e where src = 'c7' and record in (select record from e where time < timestamp '1998-01-01' and src = 'c7'))"""


def _graph(spark, sf_dir):
    # one table for the steps of a search; its edges are rows of evidence, so one may come several times
    rows = written(evidence(spark, sf_dir).withColumn("edge", F.concat_ws("|", "kind", "src", "dst")), "evidence")
    edges = rows.select("edge", "kind", "src", "dst")
    ends = rows.select(F.col("dst").alias("node"), F.concat_ws("|", "record", "src").alias("record"))
    records = rows.select(F.concat_ws("|", "record", "src").alias("record"), "src", "time")
    hit = (F.col("time") < F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'")) & (F.col("src") == "c7")
    return ends, edges, records, hit


@query(_MATCHED + "select node from m")
def matched_nodes(spark, sf_dir):
    """Nodes with evidence among the records that pass."""
    ends, _, records, hit = _graph(spark, sf_dir)
    return searching.matched_nodes(ends, records, hit)


@query(_MATCHED + "select distinct kind || '|' || src || '|' || dst as edge from e where src in (select node from m) or dst in (select node from m)")
def graph_search(spark, sf_dir):
    """Edges within one hop of the matched nodes."""
    ends, edges, records, hit = _graph(spark, sf_dir)
    nodes, found = searching.graph_search(ends, edges, records, hit, 1, 10_000)
    return (graph.reached_edges(edges, nodes, 1) if found is None else found).select("edge").distinct()


@query(_MATCHED + "select kind, count(distinct src || dst) as n from e where src in (select node from m) or dst in (select node from m) group by 1")
def edge_kind_counts(spark, sf_dir):
    """Edges by kind around the matched nodes."""
    ends, edges, records, hit = _graph(spark, sf_dir)
    return searching.edge_kind_counts(edges, searching.matched_nodes(ends, records, hit))


@query(_EVIDENCE + """
select src as node, p_brand as value, count(distinct record) as records from e join part on dst = 'p' || p_partkey where kind = 'supplied' group by 1, 2""")
def related_value_counts(spark, sf_dir):
    """Values at the other end of one kind of edge."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("value"))
    return searching.related_values(evidence(spark, sf_dir), "supplied", part)


@query(_EVIDENCE + """
, w as (select src as node, dst as other, record from e union all select dst, src, record from e)
select node, count(distinct record) as records, count(distinct other) as neighbours from w group by 1""")
def investigation_measures(spark, sf_dir):
    """Records and neighbours of each node."""
    return named(searching.investigation_measures(numbered(spark, sf_dir)))


@query("""
select event_id, case when event_type like '%1%' then 'event.type,' else '' end || case when cast(user_id as varchar) like '%1%' then 'event.user,' else '' end
  || case when json_extract_string(props, '$.k') like '%1%' then 'props.k,' else '' end as names from events""")
def value_matches(spark, sf_dir):
    """The fields in which a text was found."""
    names = searching.value_matches(event_fields(), "1")
    text = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(","))), "")
    return table(spark, sf_dir, "events").select("event_id", text.alias("names"))


@query("""select name, readable from (values ('event.type', true), ('event.user', true), ('props.k', true)) t(name, readable)""")
def observed_fields(spark, sf_dir):
    """Names of fields and whether they can be read."""
    rows = table(spark, sf_dir, "events").select(F.explode(event_fields()).alias("f")).select("f.*")
    return searching.observed_names(rows)


@query("""
select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_linenumber >= 4""")
def evidence_filter(spark, sf_dir):
    """Records of one evidence group, of which a part is absent."""
    rows = table(spark, sf_dir, "lineitem").withColumn("port", F.when(F.col("l_linenumber") < 4, F.col("l_linenumber")))
    return rows.where(searching.in_group(l_returnflag="R", port=None)).select("l_orderkey", "l_linenumber")


@query("""select event_id from events where event_type in ('click', 'view') or user_id % 9 = 0""")
def observation_kinds(spark, sf_dir):
    """Records whose kind equals a selector, or is not known."""
    kind = F.when(F.col("user_id") % 9 != 0, F.create_map(F.lit("evt"), F.col("event_type")))
    chosen = searching.same_kind(kind, [{"evt": "click"}, {"evt": "view"}, {"evt": "error", "sub": "1"}])
    return table(spark, sf_dir, "events").where(chosen).select("event_id")


@query("""
select o_orderkey % 5 as source, count(*) as read, count(*) filter (o_orderkey % 50 <> 0) as succeeded, count(*) filter (o_orderkey % 50 = 0) as failed,
  count(*) filter (o_orderkey % 50 <> 0 and o_orderkey > 10000) as truncated from orders group by 1""")
def scan_counts(spark, sf_dir):
    """Tallies of a scan: read, kept, kept truncated, rejected."""
    rows = lines.access_records(_access_lines(spark, sf_dir)).withColumn("source", F.col("o_orderkey") % 5)
    return searching.scan_counts(rows, "source", F.col("failed"), F.coalesce(F.col("size") > 10_000, F.lit(False)))


@query("""
with o as (select distinct 'placed' as kind, o_custkey as src, o_orderkey as dst from orders where o_orderkey % 2 = 0),
c as (select distinct 'placed' as kind, o_custkey as src, o_orderkey as dst from orders where o_orderkey % 3 = 0)
select *, 'observed' as state from o union all select *, 'candidate' from c where dst % 2 <> 0""")
def candidate_layer(spark, sf_dir):
    """Candidate edges on top of the observed ones."""
    rows = table(spark, sf_dir, "orders").select(F.lit("placed").alias("kind"), F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).distinct()
    return searching.layered(rows.where("dst % 2 = 0"), rows.where("dst % 3 = 0"))


@query("""
with r0 as (select event_id as record, user_id % 4 as terminal, user_id % 20 as ip, epoch_us(ts) // 1000000 as tm, event_id // 2 as transcript from events where event_type in ('error', 'view')),
r as (select * from r0 where record in (select min(record) from r0 group by transcript)),
a as (select user_id % 14 + 6 as ip, epoch_us(ts) // 1000000 as s, epoch_us(ts) // 1000000 + 21600 as e, event_id % 4 as source from events where event_type = 'signup'),
h as (select record, count(distinct source) as n, min(source) as source from r join a using (ip) where tm between s and e group by 1)
select record, source, terminal as target, 'terminal_remote_session' as relation from r join h using (record) where n = 1 and source <> terminal
union all select record, null, terminal, 'unidentified_source' from r where ip not in (select ip from a) and ip <> 3""")
def remote_sessions(spark, sf_dir):
    """Remote sessions by the terminal that an address was at the time."""
    ip = F.when(F.col("user_id") % 20 == 3, F.lit("127.0.0.3")).otherwise(F.concat(F.lit("10.0.0."), (F.col("user_id") % 20).cast("string")))
    at, events = epoch_s(F.col("ts")), table(spark, sf_dir, "events")
    rows = events.where("event_type in ('error', 'view')").select(
        F.col("event_id").alias("record"), (F.col("user_id") % 4).alias("terminal"), ip.alias("src_ip"), at.alias("at"), F.floor(F.col("event_id") / 2).alias("transcript")
    )
    held = F.concat(F.lit("10.0.0."), (F.col("user_id") % 14 + 6).cast("string"))
    made = events.where("event_type = 'signup'").select(held.alias("src_ip"), at.alias("start_s"), (at + 21600).alias("end_s"), (F.col("event_id") % 4).alias("source"))
    return logons.remote_sessions(rows, made)


PATTERN = {
    "nodes": {
        "buyer": {"kind": "c"},
        "part": {"kind": "p", "where": {"brand": {"basename_in": ["BRAND#11", "brand#12"]}}},
        "maker": {"kind": "s", "where": {"key": {"mask_any": ["0x8"]}}},
        "other": {"kind": "s", "where": {"key": {"present": True}}},
    },
    "edges": {
        "bought": {"kind": "placed", "from": "buyer", "to": "part"},
        "made": {"kind": "supplied", "from": "maker", "to": "part"},
        "also": {"kind": "supplied", "from": "other", "to": "part"},
    },
    "distinct": [["maker", "other"]],
    "joins": [{"equal": ["buyer.nation", "maker.nation"]}],
    "order": [{"before": ["made", "also"], "within": 864_000}],
}


@query(_EVIDENCE + """
, p as (select 'p' || p_partkey as p from part where lower(p_brand) in ('brand#11', 'brand#12')),
e1 as (select distinct src as buyer, dst as p from e where kind = 'placed'), sv as (select src, dst, epoch_us(time) // 1000000 as t from e where kind = 'supplied')
select distinct buyer, m.src as maker, o.src as other, p.p as part
from p join e1 on e1.p = p.p join sv m on m.dst = p.p join sv o on o.dst = p.p and o.src <> m.src and o.t - m.t > 0 and o.t - m.t <= 864000
join customer c on 'c' || c.c_custkey = buyer join supplier s on 's' || s.s_suppkey = m.src and s.s_suppkey & 8 <> 0 and s.s_nationkey = c.c_nationkey""")
def subgraph_patterns(spark, sf_dir):
    """Bindings of a pattern of nodes, edges, joins and order."""
    def nodes(name: str, kind: str, column: str, **attributes: str):
        pairs = [x for n, c in attributes.items() for x in (F.lit(n), F.array(F.col(c).cast("string")))]
        return table(spark, sf_dir, name).select(
            (F.col(column) * len(_NODES) + _NODES.index(kind)).alias("node"), F.lit(kind).alias("kind"), F.create_map(*pairs).alias("attributes")
        )

    all_nodes = (
        nodes("customer", "c", "c_custkey", nation="c_nationkey")
        .union(nodes("part", "p", "p_partkey", brand="p_brand"))
        .union(nodes("supplier", "s", "s_suppkey", key="s_suppkey", nation="s_nationkey"))
    )
    edges = numbered(spark, sf_dir).select("kind", "src", "dst", epoch_s(F.col("time")).alias("time"))
    pattern = PATTERN | {"edges": {r: e | {"kind": _KINDS.index(e["kind"])} for r, e in PATTERN["edges"].items()}}
    found, why = patterns.matches(pattern, all_nodes, edges, None)
    assert why is None
    roles = {"buyer": "c", "maker": "s", "other": "s", "part": "p"}
    return found.select(*(F.concat(F.lit(k), F.floor(F.col(r) / len(_NODES)).cast("string")).alias(r) for r, k in roles.items()))
