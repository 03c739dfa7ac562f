"""Queries of further readers and of the placement of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import epoch_s
from ..operators import placement
from ..sources import lines
from .registry import query, table


@query("""
select o_orderkey, o_orderkey % 30 = 0 as failed, case when o_orderkey % 30 <> 0 then o_orderdate end as at,
  case when o_orderkey % 30 <> 0 then 'core' end as module, case when o_orderkey % 30 <> 0 then 'error' end as severity,
  case when o_orderkey % 30 <> 0 then o_custkey end as pid, case when o_orderkey % 30 <> 0 and o_orderkey % 2 = 0 then '10.0.0.1' end as client from orders""")
def error_log(spark, sf_dir):
    """Error lines with a local time, with and without a client."""
    client = F.when(F.col("o_orderkey") % 2 == 0, F.lit("[client 10.0.0.1:99] ")).otherwise(F.lit(""))
    line = F.format_string("[%s] [core:error] [pid %d:tid 7] %sAH00: gone", F.date_format("o_orderdate", "EEE MMM dd HH:mm:ss.SSSSSS yyyy"), F.col("o_custkey"), client)
    line = F.when(F.col("o_orderkey") % 30 == 0, F.lit("[x] gone")).otherwise(line)
    rows = lines.error_records(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")))
    return rows.select("o_orderkey", "failed", F.col("local_time").alias("at"), "module", "severity", "pid", "client")


@query("""
with l as (select distinct l_orderkey as k, l_linenumber * 100 as n from lineitem),
f1 as (select k, min(n) as f from l group by 1),
f2 as (select l.k, min(n) as f from l join f1 on l.k = f1.k and l.n > f1.f + 256 group by 1),
f3 as (select l.k, min(n) as f from l join f2 on l.k = f2.k and l.n > f2.f + 256 group by 1),
f as (select * from f1 union all select * from f2 union all select * from f3),
m as (select l.k, l.n, max(f.f) as f from l join f on l.k = f.k and f.f <= l.n group by 1, 2)
select 1700000000000 + k as serial, f as event, count(*) as lines, string_agg('T' || n, ' ' order by n) as types from m group by 1, 2""")
def audit_log(spark, sf_dir):
    """Audit events assembled from their lines, within 256 lines of the first."""
    stamp = F.col("l_orderkey") + 1700000000000
    number = F.col("l_linenumber") * 100
    line = F.format_string("node=a type=T%d msg=audit(%d.000:%d): x=1", number, stamp, stamp)
    rows = table(spark, sf_dir, "lineitem").select(number.alias("number"), line.alias("line")).distinct()
    out = lines.audit_events(rows)
    return out.select(F.split_part("serial", F.lit(":"), F.lit(2)).cast("long").alias("serial"), "event", "lines", F.array_join("types", " ").alias("types"))


@query("""select p_partkey, case when p_partkey % 3 <> 2 then 'ls -l /p' || p_size end as command, 'ls ' || p_brand as title from part""")
def command_lines(spark, sf_dir):
    """Command lines of numbered arguments and of hexadecimal titles."""
    args = F.create_map(F.lit("a0"), F.lit("ls"), F.lit("a1"), F.lit("-l"), F.lit("a2"), F.concat(F.lit("/p"), F.col("p_size").cast("string")))
    argc = F.when(F.col("p_partkey") % 3 == 2, 4).otherwise(3)
    title = F.concat(F.hex(F.encode(F.concat(F.lit("ls"), F.lit("\0"), F.col("p_brand")), "UTF-8")), F.lit("0000"))
    return table(spark, sf_dir, "part").select("p_partkey", lines.command_line(args, argc).alias("command"), lines.hex_text(title).alias("title"))


@query("""
with r as (select event_id as record, case when event_id % 7 = 0 then user_id end as terminal, case when event_id % 11 <> 0 then 'pc' || user_id % 30 || '.org' end as host,
   epoch_us(ts) // 1000000 as tm, event_type as source from events where event_type in ('view', 'error')),
a as (select 'PC' || user_id % 30 || '.org' as host, epoch_us(ts) // 1000000 as s, epoch_us(ts) // 1000000 + 43200 as e, event_id % 3 as owner from events where event_type = 'signup'),
h as (select record, count(distinct owner) as n, min(owner) as owner from r join a on lower(a.host) = lower(r.host) and tm between s and e where terminal is null group by 1),
c as (select 'pc' || (s_suppkey - s_suppkey % 3 % 2) as short, count(distinct s_suppkey) as n, min('col' || s_suppkey) as collection from supplier group by 1)
select r.record, coalesce(cast(terminal as varchar), cast(h.owner as varchar), c.collection, source || '|' || host, source) as place,
  case when terminal is not null then 'own' when h.owner is not null then 'assignment' when c.collection is not null then 'collection' when host is not null then 'host_in_source' else 'source' end as basis
from r left join h on h.record = r.record and h.n = 1 left join c on c.short = split_part(r.host, '.', 1) and c.n = 1""")
def record_placement(spark, sf_dir):
    """The terminal of each record by the first rule that gives one."""
    events, at = table(spark, sf_dir, "events"), epoch_s(F.col("ts"))
    host = F.concat(F.lit("pc"), (F.col("user_id") % 30).cast("string"), F.lit(".org"))
    rows = events.where("event_type in ('view', 'error')").select(
        F.col("event_id").alias("record"), F.when(F.col("event_id") % 7 == 0, F.col("user_id")).alias("terminal"),
        F.when(F.col("event_id") % 11 != 0, host).alias("host"), at.alias("at"), F.col("event_type").alias("source"),
    )
    made = events.where("event_type = 'signup'").select(F.upper(host).alias("host"), at.alias("start_s"), (at + 43200).alias("end_s"), (F.col("event_id") % 3).alias("owner"))
    number = F.col("s_suppkey") - F.col("s_suppkey") % 3 % 2
    owned = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("PC"), number.cast("string"), F.lit(".x")).alias("host"), F.concat(F.lit("col"), F.col("s_suppkey").cast("string")).alias("collection")
    )
    return placement.placed(rows, made, owned)


@query("""
select coalesce(cast(case when user_id % 2 = 0 then user_id end as varchar), cast(event_id as varchar)) as src, case when user_id % 2 = 0 then 'process' else 'record' end as src_kind,
  'name' || json_extract_string(props, '$.k') || '.org' as domain, count(distinct event_id) as records from events group by 1, 2, 3""")
def reverse_lookups(spark, sf_dir):
    """Names that processes, else records, looked up."""
    domain = F.concat(F.lit("NAME"), F.get_json_object("props", "$.k"), F.lit(".org"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("record"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("process"), domain.alias("domain"))
    return placement.reverse_lookups(rows)


@query("""
with o as (select o_custkey as terminal, o_orderkey % 5 as address, count(distinct o_orderkey) as evidence from orders group by 1, 2),
a as (select distinct c_custkey as terminal, cast(c_nationkey % 5 as bigint) as address from customer)
select coalesce(o.terminal, a.terminal) as terminal, coalesce(o.address, a.address) as address, coalesce(evidence, 0) as evidence, a.terminal is not null as assigned
from o full join a on o.terminal = a.terminal and o.address = a.address""")
def assigned_addresses(spark, sf_dir):
    """Addresses of terminals by records and by assignments."""
    observed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("terminal"), (F.col("o_orderkey") % 5).alias("address"), F.col("o_orderkey").alias("record"))
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("terminal"), (F.col("c_nationkey") % 5).cast("long").alias("address"))
    return placement.assigned_addresses(observed, made)
