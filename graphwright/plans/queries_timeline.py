"""Queries of time lines, evidence near nodes, names and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline
from ..sources import lines
from .registry import query, table


def _times(spark, sf_dir):
    """Events as records: some without a time, some with further ones."""
    day = F.expr("ts - interval 1 day")
    more = F.when(F.col("event_id") % 3 == 0, F.array(day)).when(F.col("event_id") % 3 == 1, F.array(day, F.expr("ts + interval 1 day")))
    dated = F.col("event_id") % 5 != 0
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record"), F.col("event_type").alias("source"), F.when(dated, F.col("ts")).alias("at"),
        F.when(~dated, F.date_format("ts", "yyyy-MM-dd")).alias("local"), more.alias("more"),
    )


_TIMES = """
with own as (select event_id as record, event_type as source, case when event_id % 5 <> 0 then ts end as w,
    case when event_id % 5 = 0 then strftime(ts, '%Y-%m-%d') end as local, ts, event_id % 3 as m from events),
more as (select record, source, ts - interval 1 day as w, local from own where m < 2
  union all select record, source, ts + interval 1 day, local from own where m = 1),
"""


@query(_TIMES + """
t as (select record, w, local, false as additional from own where w is not null or m = 2 union all select record, w, local, true from more)
select record, w as "at", local, additional from t""")
def timeline_rows(spark, sf_dir):
    """A row for each time of a record, those with a local time only behind."""
    return timeline.timeline(_times(spark, sf_dir))


@query(_TIMES + """
t as (select source, w from own union all select source, w from more)
select source, min(w) as low, max(w) as high from t group by 1""")
def source_ranges(spark, sf_dir):
    """Ranges of sources by all times of their records."""
    return timeline.source_ranges(_times(spark, sf_dir))


@query("""
select event_id as record, case event_type when 'signup' then 'created' else 'disabled' end as category,
  case when event_id % 4 <> 0 then ts end as at from events where user_id = 3 and event_type in ('signup', 'error')""")
def account_history(spark, sf_dir):
    """Management events of one account."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record"), F.col("user_id").alias("target"), F.col("event_type").alias("action"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("at")
    )
    return timeline.account_history(rows, 3, {"signup": "created", "error": "disabled"})


@query("""
with e as (select o_orderkey as edge, 'c' || o_custkey as src, 'd' || strftime(o_orderdate, '%Y-%m-%d') as dst from orders),
o as (select 'c1' as node union all select 'c7'),
n as (select o.node from o union select dst from e join o on src = node union select src from e join o on dst = node),
met as (select distinct edge from e where src in (select node from n) or dst in (select node from n))
select distinct record from (select l_linenumber + 10 * l_orderkey as record from lineitem where l_orderkey in (select edge from met)
  union all select -c_custkey from customer where 'c' || c_custkey in (select node from o))""")
def records_near(spark, sf_dir):
    """Evidence within two hops of two customers."""
    edges = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("edge"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dst")
    )
    origins = table(spark, sf_dir, "customer").where("c_custkey in (1, 7)").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), (-F.col("c_custkey")).alias("record"))
    of_edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge"), (F.col("l_linenumber") + 10 * F.col("l_orderkey")).alias("record"))
    return timeline.records_near(edges, origins, own, of_edges, 2)


@query("""
select l_suppkey as account, count(distinct l_orderkey) as records from lineitem
where l_suppkey <> 3 and l_orderkey in (select l_orderkey from lineitem where l_suppkey = 3) group by 1""")
def accounts_beside(spark, sf_dir):
    """Accounts that share records with one account."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("account"))
    return timeline.accounts_beside(rows, 3)


@query("""
select event_id, contains(lower(props || event_type), 'rr') as in_raw, contains(event_type, 'rr') as in_values
from events where contains(lower(props || event_type), 'rr') or contains(event_type, 'rr')""")
def text_hits(spark, sf_dir):
    """Records that hold a text, in their raw form or a value."""
    rows = table(spark, sf_dir, "events").withColumn("raw", F.concat("props", F.upper("event_type")))
    return timeline.text_hits(rows, "RR", "raw", F.array("event_type", F.lit(None).cast("string"))).select("event_id", "in_raw", "in_values")


@query("""
select event_id, case when user_id % 3 = 0 and event_type = 'click' then 'target' when user_id % 3 = 0 and event_id % 2 = 1 then 'odd'
  when user_id % 3 < 2 then 'plain' || user_id % 3 end as semantic from events""")
def scoped_semantics(spark, sf_dir):
    """Meanings of a key by event, by sub-event, or by itself."""
    key = F.concat(F.lit("k"), F.col("user_id") % 3)
    scopes = [(F.col("event_type"), {("k0", "click"): "target"}), ((F.col("event_id") % 2).cast("string"), {("k0", "1"): "odd"})]
    meaning = timeline.scoped_semantic(key, scopes, {"k0": "plain0", "k1": "plain1"})
    return table(spark, sf_dir, "events").select("event_id", meaning.alias("semantic"))


@query(r"""
with f as (select p_partkey, p_size as collection, 'V' || p_partkey % 2 as device,
   case when p_partkey % 2 = 0 or p_size % 3 = 0 then '\Windows\System32\a' || p_partkey else '\data\b' || p_partkey end as path from part),
r as (select s_suppkey as collection, 'C:\Windows' as root from supplier where s_suppkey <= 50 union all select s_suppkey, 'D:\Win\' from supplier where s_suppkey % 5 = 0),
one as (select collection, min(root) as root from r group by 1 having count(distinct lower(root)) = 1),
d as (select f.collection, min(device) as device, min(left(root, 2)) as letter from f join one using (collection) where path like '\Windows\System32\%' and root = 'C:\Windows' group by 1 having count(distinct device) = 1)
select p_partkey, letter || path as drive_path from f left join d on f.collection = d.collection and f.device = d.device""")
def drive_paths(spark, sf_dir):
    """Device paths under the drive letter of their collection."""
    inside = (F.col("p_partkey") % 2 == 0) | (F.col("p_size") % 3 == 0)
    path = F.when(inside, F.concat(F.lit("\\Windows\\System32\\a"), "p_partkey")).otherwise(F.concat(F.lit("\\data\\b"), "p_partkey"))
    files = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("collection"), F.concat(F.lit("V"), F.col("p_partkey") % 2).alias("device"), path.alias("path"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("collection"))
    roots = own.where("collection <= 50").withColumn("root", F.lit("C:\\Windows")).union(own.where("collection % 5 = 0").withColumn("root", F.lit("D:\\Win\\")))
    return timeline.drive_paths(files, roots).select("p_partkey", "drive_path")


@query("""
select o_orderkey as edge, o_custkey % 50 = 0 as earliest, cast(o_totalprice as bigint) // 1000 as length, o_orderkey % 5 as hops from orders
order by earliest desc, length, hops, edge limit 300""")
def short_routes(spark, sf_dir):
    """The best 300 edges of routes (a top-k report)."""
    edges = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("edge"), (F.col("o_custkey") % 50 == 0).alias("earliest"), F.expr("cast(rint(o_totalprice) as bigint) div 1000").alias("length"), (F.col("o_orderkey") % 5).alias("hops")
    )
    return timeline.short_routes(edges, 300)


@query("""
select distinct * from (
  select 'record_names_object' as kind, cast(event_id as varchar) as src, event_type as dst from events
  union all select 'record_subject_account', cast(event_id as varchar), cast(user_id as varchar) from events where event_id % 2 = 0
  union all select 'record_target_account', cast(event_id as varchar), cast(user_id + 1 as varchar) from events where event_id % 3 = 0
  union all select 'process_executable', 'bin' || user_id % 9, cast(user_id as varchar) from events)""")
def naming_edges(spark, sf_dir):
    """Edges from records to what they name, and from executables to processes."""
    e, user = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select(
        e.alias("record"), F.col("event_type").alias("object"), F.when(e % 2 == 0, user).alias("subject"), F.when(e % 3 == 0, user + 1).alias("target"),
        user.alias("process"), F.concat(F.lit("bin"), user % 9).alias("path"),
    )
    return timeline.naming_edges(rows)


@query("select user_id as node, event_type as terminal, min(event_id) as first from events where event_type <> 'view' group by 1, 2")
def named_terminals(spark, sf_dir):
    """Terminals of a node's evidence by where each comes first."""
    terminal = F.when(F.col("event_type") != "view", F.col("event_type"))
    return timeline.named_terminals(table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), terminal.alias("terminal"), F.col("event_id").alias("ord")))


@query("""
select l_orderkey as record, arg_min(l_suppkey, l_linenumber) filter (where l_returnflag = 'A') as "A",
  arg_min(l_suppkey, l_linenumber) filter (where l_returnflag = 'N') as "N" from (
  select l_orderkey, l_returnflag, l_linenumber, min(l_suppkey) as l_suppkey from lineitem group by 1, 2, 3) group by 1""")
def record_summaries(spark, sf_dir):
    """First value of each meaning in a record."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("semantic"), F.col("l_linenumber").alias("ord")).agg(F.min("l_suppkey").alias("value"))
    return timeline.record_summaries(rows, ["A", "N"])


@query("""
select p_partkey as source, case when p_partkey % 4 = 0 then 'registry' when p_partkey % 4 = 1 then 'error' else '' end as formats from part""")
def detected_formats(spark, sf_dir):
    """Formats by their signature, or by a trial of the first lines."""
    good = F.format_string("[Mon Jan 01 00:00:00 2024] [core:error] [pid %d:tid 7] gone", "p_partkey")
    rest = F.when(F.col("p_partkey") % 4 == 1, good).when(F.col("p_partkey") % 4 == 2, F.lit("x")).otherwise(F.lit("\x01"))
    head = F.when(F.col("p_partkey") % 4 == 0, F.encode(F.lit("regf"), "UTF-8")).otherwise(F.encode(rest, "UTF-8"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), head.alias("head"), F.array(good, rest, rest).alias("lines"))
    out = timeline.detected_formats(files, lines.TRIALS)
    return out.select("source", F.array_join("formats", ",").alias("formats"))
