"""Queries of filtered traversal, routes, rule targets and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import network
from ..functions.times import epoch_s
from ..operators import details, detect, graph, joins, logsource, meanings
from .queries_graph import _EVIDENCE, evidence, named, numbered
from .registry import query, table


def _k():
    return F.get_json_object("props", "$.k").cast("long")


_K = "cast(json_extract_string(props, '$.k') as bigint)"

_NAMED = f"""
with ev as (select event_id, event_type, user_id, ts, {_K} as k from events),
e as (select distinct 'record_names_object' as kind, 'r' || event_id as src, 't' || user_id % 7 as dst from ev
  union select distinct 'ran_on', 'p' || k, 't' || user_id % 7 from ev where event_type = 'signup'
  union select distinct 'communication', 'p' || k, '10.0.' || k % 3 || '.' || user_id % 9 from ev where event_type = 'purchase'),
x as (select kind || '|' || src || '|' || dst as edge, * from e where kind <> 'communication' or dst like '10.0.1.%'),
w as (select edge, kind, src, dst from x union all select edge, kind, dst, src from x),
o as (select 'p5' as node union all select 't3'),
m1 as (select edge, dst from w where src in (select node from o)),
n1 as (select distinct dst as node from m1 where dst not in (select node from o)),
m2 as (select edge, dst from w where src in (select node from n1) and not (src like 't%' and kind = 'record_names_object'))
"""


def _named_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Records that name terminals, processes that ran on them, and addresses they reached."""
    rows = table(spark, sf_dir, "events").withColumn("k", _k())

    def text(prefix: str, c):
        return F.concat(F.lit(prefix), c.cast("string"))

    terminal, process = text("t", F.col("user_id") % 7), text("p", F.col("k"))
    address = F.concat(F.lit("10.0."), (F.col("k") % 3).cast("string"), F.lit("."), (F.col("user_id") % 9).cast("string"))
    parts = F.array(
        F.struct(F.lit("record_names_object").alias("kind"), F.lit("record").alias("a"), text("r", F.col("event_id")).alias("src"), F.lit("terminal").alias("b"), terminal.alias("dst")),
        F.when(F.col("event_type") == "signup", F.struct(F.lit("ran_on").alias("kind"), F.lit("process").alias("a"), process.alias("src"), F.lit("terminal").alias("b"), terminal.alias("dst"))),
        F.when(F.col("event_type") == "purchase", F.struct(F.lit("communication").alias("kind"), F.lit("process").alias("a"), process.alias("src"), F.lit("ip").alias("b"), address.alias("dst"))),
    )
    long = rows.select(F.explode(parts).alias("e")).where("e is not null").select("e.*").distinct()
    edges = long.select(F.concat_ws("|", "kind", "src", "dst").alias("edge"), "kind", "src", "dst")
    nodes = long.select(F.col("src").alias("node"), F.col("a").alias("node_kind")).union(long.select("dst", "b")).distinct()
    return edges, nodes


@query(_NAMED + "select edge from m1 union select edge from m2")
def filtered_traversal(spark, sf_dir):
    """Two steps from a process and a terminal, within an address block; relayed terminals don't lead to records."""
    edges, nodes = _named_graph(spark, sf_dir)
    origins = spark.createDataFrame([("p5",), ("t3",)], "node string")
    keep = network.passes_blocks(F.col("src_node_kind"), F.col("src"), "10.0.1.0/24") & network.passes_blocks(F.col("dst_node_kind"), F.col("dst"), "10.0.1.0/24")
    return graph.expanded(edges, nodes, origins, 2, keep)[0]


@query(_NAMED + """
, y as (select * from x where kind = 'ran_on'), v as (select edge, src, dst from y union all select edge, dst, src from y),
a1 as (select edge, dst from v where src in (select node from o)), b1 as (select distinct dst as node from a1 union select node from o)
select node, case when node in (select node from o) then 0 else 1 end as hops from b1""")
def object_traversal(spark, sf_dir):
    """Nodes of one kind of edge, where records are not shown."""
    edges, nodes = _named_graph(spark, sf_dir)
    origins = spark.createDataFrame([("p5",), ("t3",)], "node string")

    def shown(side: str):
        return details.kind_passes(F.col(f"{side}_node_kind"), ["process", "terminal"], objects=True)

    keep = shown("src") & shown("dst") & F.col("kind").isin("ran_on")
    return graph.expanded(edges, nodes, origins, 1, keep)[1]


@query(_EVIDENCE + """
, r as (select distinct record from e where src = 'c7' and time < timestamp '1996-01-01'),
n as (select 'node' as element, src as id, record from e union all select 'node', dst, record from e union all select 'edge', kind || '|' || src || '|' || dst, record from e)
select element, id, count(distinct record) as records from n where record in (select record from r) group by 1, 2""")
def record_elements(spark, sf_dir):
    """Nodes and edges that some records are evidence of."""
    rows = evidence(spark, sf_dir)
    chosen = rows.where((F.col("src") == "c7") & (F.col("time") < F.expr("TIMESTAMP_NTZ'1996-01-01 00:00:00'"))).select("record")
    ends = rows.select(F.col("src").alias("node"), "record").union(rows.select("dst", "record"))
    return graph.record_elements(ends, rows.select(F.concat_ws("|", "kind", "src", "dst").alias("edge"), "record"), chosen)


@query(f"""
with c as (
  select event_id as contact, user_id % 50 as s, {_K} % 50 as d, epoch_us(ts) // 1000000 as t,
         event_id % 5 = 0 as sent, event_id % 7 = 0 as received
  from events where user_id % 50 <> {_K} % 50),
snd as (select contact, d as record, s as candidate from c where sent),
many as (select record from snd group by 1 having count(distinct candidate) > 1),
sp as (select * from snd where record in (select record from many) and record not in (3, 17)),
door as (select distinct record, candidate from sp),
kept as (
  select * from c
  where not (received and s = 17 and s in (select record from many))
    and not (sent and d = 3 and d in (select record from many)))
select contact, cast(s as varchar) as src,
       case when contact in (select contact from sp) then d || '#' || s else cast(d as varchar) end as dst, t as depart
from kept
union all
select contact, record || '#' || candidate, cast(d as varchar), t from kept join door on record = s where not received""")
def separated_candidates(spark, sf_dir):
    """Contacts in which alternative matches of a record lead not to one another, from 3 to 17."""
    src, dst = F.col("user_id") % 50, _k() % 50
    rows = table(spark, sf_dir, "events").where(src != dst)
    contacts = rows.select(F.col("event_id").alias("contact"), src.alias("src"), dst.alias("dst"), epoch_s(F.col("ts")).alias("depart"))
    sends = contacts.where("contact % 5 = 0").select("contact", F.col("dst").alias("record"), F.col("src").alias("candidate"))
    return graph.separated(contacts, sends, contacts.where("contact % 7 = 0").select("contact"), 3, 17)


@query()
def earliest_route(spark, sf_dir):
    """The contacts of one earliest path, in order. A walk back has no plain SQL; a test compares with enumeration."""
    src, dst, at = F.col("user_id") % 50, _k() % 50, epoch_s(F.col("ts"))
    contacts = table(spark, sf_dir, "events").where(src != dst).select(
        F.col("event_id").alias("contact"), src.alias("src"), dst.alias("dst"), at.alias("depart"), (at + 600).alias("arrive")
    )
    route = graph.earliest_route(contacts, 3, 17, 0, 2_000_000_000)
    places = spark.createDataFrame(list(enumerate(route)), "place int, contact long")
    return places.join(contacts, "contact")


RULES = [
    {"title": "creation", "level": "high", "logsource": {"product": "windows", "category": "process_creation"},
     "detection": {"sel": {"Image|contains": "7"}, "low": {"ProcessId|startswith": "1"}, "condition": "sel and not low"}},
    {"title": "own", "level": "low", "logsource": {"product": "windows", "category": "process_creation"},
     "detection": {"sel": {"OriginalFileName|endswith": "3"}, "condition": "sel"}},
    {"title": "keys", "level": "low", "logsource": {"product": "windows", "category": "registry_delete"},
     "detection": {"sel": {"Image|contains": "5"}, "condition": "1 of sel*"}},
    {"title": "channel", "level": "medium", "logsource": {"product": "windows", "service": "security"},
     "detection": {"sel": {"EventID": [4688, 1102]}, "condition": "sel"}},
    {"title": "elsewhere", "logsource": {"product": "linux"}, "detection": {"sel": {"EventID": 1}, "condition": "sel"}},
]


def _channel_records(spark, sf_dir) -> DataFrame:
    k, n = _k(), F.col("event_id") % 4
    name = F.concat(F.lit("p"), k.cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record"),
        F.when(n == 0, "Microsoft-Windows-Sysmon/Operational").when(n == 1, "Security").when(n == 2, "Setup").alias("Channel"),
        F.when(n == 3, F.when(k % 2 == 0, "Microsoft-Windows-Eventlog").otherwise("microsoft-windows-sysmon")).alias("Provider_Name"),
        F.when(n == 0, F.when(k % 3 == 0, "12").otherwise("1")).when(n == 1, F.when(k % 3 == 0, "4624").otherwise("4688"))
        .otherwise(F.when(k % 5 == 0, "1102").otherwise("1")).alias("EventID"),
        F.when(n != 1, name).alias("Image"), F.when(n == 1, name).alias("NewProcessName"), k.cast("string").alias("ProcessId"),
        (k + 1).cast("string").alias("NewProcessId"), name.alias("OriginalFileName"), F.when(k % 2 == 0, "DeleteKey").otherwise("CreateKey").alias("EventType"),
        F.col("user_id"),
    )


_CHANNELS = f"""
with r as (select event_id as record, event_id % 4 as n, {_K} as k, user_id from events),
h as (select record, k, user_id, n,
  case when n = 0 and k % 3 = 0 then '12' when n = 0 then '1' when n = 1 and k % 3 = 0 then '4624' when n = 1 then '4688' when k % 5 = 0 then '1102' else '1' end as id,
  case when n = 0 then 'sysmon' when n = 1 then 'security' when n = 3 and k % 2 = 1 then 'sysmon'
       when n = 3 and k % 5 = 0 then 'security' end as service from r),
m as (
  select record, user_id, 'creation' as rule, 'high' as level from h where service = 'sysmon' and id = '1' and contains('p' || k, '7') and not starts_with(cast(k as varchar), '1')
  union all select record, user_id, 'creation', 'high' from h where service = 'security' and id = '4688' and contains('p' || k, '7') and not starts_with(cast(k + 1 as varchar), '1')
  union all select record, user_id, 'own', 'low' from h where service = 'sysmon' and id = '1' and ends_with('p' || k, '3')
  union all select record, user_id, 'keys', 'low' from h where service = 'sysmon' and id = '12' and k % 2 = 0 and contains('p' || k, '5')
  union all select record, user_id, 'channel', 'medium' from h where service = 'security' and id in ('4688', '1102'))
"""


def _target_hits(spark, sf_dir):
    rows = _channel_records(spark, sf_dir)
    rows = rows.withColumn("service", logsource.service_of(F.col("Channel"), F.col("Provider_Name"), F.col("EventID")))
    found, skipped = detect.hits(rows, RULES, ["record"], F.col("service"), F.col("EventID"))
    assert list(skipped) == ["elsewhere"]
    return rows, found


@query(_CHANNELS + "select record, rule, level from m")
def targeted_rules(spark, sf_dir):
    """Rules over the records that their logsource names, with the events' own field names."""
    return _target_hits(spark, sf_dir)[1]


@query(_CHANNELS + "select rule, count(*) as hits from m where user_id % 3 = 1 group by 1")
def rule_hits_within(spark, sf_dir):
    """Hits of rules on the records that a search selects."""
    rows, found = _target_hits(spark, sf_dir)
    return detect.hits_within(found, rows, F.col("user_id") % 3 == 1)[1]


@query(f"""
with r as (select event_id as record, {_K} as k, event_id % 3 as n, user_id from events)
select record, case n when 0 then case when k % 4 <> 0 then 'login' end when 1 then case when k % 5 <> 0 then 'prov' end end as category,
  case n when 0 then 'a' || k % 2 when 1 then case when k % 5 <> 0 then cast(k as varchar) end end as action from r""")
def record_kinds(spark, sf_dir):
    """Category and action of records by their own fields, else by provider and event id."""
    k, n = _k(), F.col("event_id") % 3
    own = details.event_kind(
        F.when(k % 4 != 0, "login"), F.concat(F.lit("a"), (k % 2).cast("string")), n == 0, F.when(n == 1, "prov"), F.when(k % 5 != 0, k.cast("string")).otherwise("")
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("record"), own[0].alias("category"), own[1].alias("action"))


_TERMINAL = f"""
with r as (select event_id as record, user_id % 4 as terminal, {_K} as k, event_id % 5 as n, '10.0.0.' || user_id % 6 as ip from events),
c as (select record, terminal, ip, case when k % 10 = 9 then 'program_execution'
    when n = 0 then case when k % 3 <> 2 then 'remote_logon' end when n = 1 then 'remote_logon' when n = 2 then 'account_management' when n = 3 then 'defense_evasion' end as category,
  case when k % 10 = 9 then null when n = 0 and k % 3 <> 2 then 'success' when n = 1 then 'failure' end as outcome from r)
"""


def _terminal_records(spark, sf_dir) -> DataFrame:
    k, n = _k(), F.col("event_id") % 5
    security = "Microsoft-Windows-Security-Auditing"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record"), (F.col("user_id") % 4).alias("terminal"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 6).cast("string")).alias("src_ip"),
        F.when(n < 3, security).when(n == 3, "Microsoft-Windows-Eventlog").otherwise("other").alias("provider"),
        F.when(n == 0, "4624").when(n == 1, "4625").when(n == 2, "4720").when(n == 3, "104").otherwise("1").alias("event_id"),
        F.when(k % 3 == 0, " 3 ").when(k % 3 == 1, "10").otherwise("2").alias("logon_type"), F.when(k % 10 == 9, "prefetch").alias("artifact"),
    )


@query(_TERMINAL + "select terminal, category, outcome, count(*) as records from c where category is not null group by 1, 2, 3")
def terminal_categories(spark, sf_dir):
    """Records about terminals by category and outcome."""
    rows = details.classified(_terminal_records(spark, sf_dir)).where("category is not null")
    return rows.groupBy("terminal", "category", "outcome").agg(F.count("*").alias("records"))


@query(_TERMINAL + "select record, category, outcome from c where terminal = 2 and category = 'remote_logon' and ip = '10.0.0.4'")
def terminal_events(spark, sf_dir):
    """Records of one terminal, of a category and from an address."""
    return details.terminal_events(_terminal_records(spark, sf_dir), 2, "remote_logon", "10.0.0.4").select("record", "category", "outcome")


@query(f"""
with o as (select case when {_K} % 11 > 7 then user_id else user_id + 1000 end as origin, case {_K} % 6 when 0 then 'matched' when 1 then 'no_candidate_in_window' when 2 then 'no_candidate_record'
  when 3 then 'terminal_undetermined' when 4 then 'proxy_address_unknown' else 'candidate_item_unreadable' end as outcome,
  case {_K} % 6 when 0 then 1 when 1 then 10 when 2 then 15 when 3 then 7 when 4 then 13 else 12 end as rank from events where event_type = 'error'),
b as (select origin, min_by(outcome, rank) as outcome from o group by 1)
select user_id as record, coalesce(b.outcome, 'not_used_as_origin') as outcome from (select user_id from events union select origin from o where origin % 2 = 0) u left join b on origin = user_id""")
def match_outcomes(spark, sf_dir):
    """The best outcome of each origin over its candidate sets, and of records that were none."""
    k = _k() % 6
    name = F.when(k == 0, "matched").when(k == 1, "no_candidate_in_window").when(k == 2, "no_candidate_record").when(k == 3, "terminal_undetermined")
    name = name.when(k == 4, "proxy_address_unknown").otherwise("candidate_item_unreadable")
    rows = table(spark, sf_dir, "events")
    origin = F.when(_k() % 11 > 7, F.col("user_id")).otherwise(F.col("user_id") + 1000)
    tried = rows.where("event_type = 'error'").select(origin.alias("origin"), name.alias("outcome"))
    known = rows.select(F.col("user_id").alias("record")).union(tried.where("origin % 2 = 0").select("origin")).distinct()
    return details.derivations(known, details.best_outcomes(tried))


@query(f"""
with r as (select event_id as record, {_K} as k, user_id, ts from events)
select record, case when record % 10 = 0 then null when k % 3 = 0 then 'origin' when user_id % 2 = 0 then 'candidate' end as side,
  case when record % 10 = 0 then 'origin_item_unreadable' when k % 4 = 0 then 'destination_ip_absent' else 'matched' end as outcome from r where k % 5 <> 0""")
def match_sides(spark, sf_dir):
    """Which records are origins and which candidates of matching, and early failures of requests."""
    rows = table(spark, sf_dir, "events").withColumn("k", _k()).select(
        F.col("event_id").alias("record"), "k", F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("at"), F.when(F.col("k") % 3 != 0, F.lit("p")).alias("process"),
        F.when(F.col("user_id") % 2 == 0, F.lit("t")).alias("terminal"), F.when(F.col("k") % 5 != 0, F.lit("10.0.0.1")).alias("dst_ip"), F.lit(443).alias("dst_port"), F.lit(None).cast("int").alias("src_port"),
    )
    outcome = details.match_outcome((F.col("at").isNull(), "origin_item_unreadable"), (F.col("k") % 4 == 0, "destination_ip_absent"))
    return details.match_sides(rows).where("dst_ip is not null").select("record", "side", outcome.alias("outcome"))


@query(f"""
with a as (select event_id as origin, user_id, {_K} % 3 as c, epoch_us(ts) // 1000000 as s from events where event_type = 'error'),
b as (select event_id as candidate, user_id, {_K} % 3 as c, epoch_us(ts) // 1000000 as s from events where event_type = 'view'),
p as (select origin, candidate, a.c as ac, b.c as bc, a.s as asec, b.s as bsec from a join b on a.user_id = b.user_id and abs(a.s - b.s) <= 7200)
select origin, candidate, 'destination_ip' as condition, cast(ac as varchar) as "left", cast(bc as varchar) as "right", ac = bc as holds, null::bigint as delta_s from p
union all select origin, candidate, 'second_of_time', cast(asec as varchar), cast(bsec as varchar), abs(asec - bsec) <= 3600, bsec - asec from p""")
def explained_pairs(spark, sf_dir):
    """How each pair of records compares by condition, with the difference of times."""
    rows = table(spark, sf_dir, "events").withColumn("k", _k() % 3)
    a = rows.where("event_type = 'error'").select("user_id", F.col("event_id").alias("origin"), F.col("k").alias("a_ip"), epoch_s(F.col("ts")).alias("a_s"))
    b = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("candidate"), F.col("k").alias("b_ip"), epoch_s(F.col("ts")).alias("b_s"))
    pairs = joins.band_join(a, b, ["user_id"], F.col("a_s"), F.col("b_s"), 7200)
    return details.explained_pairs(pairs, {"destination_ip": ("a_ip", "b_ip")}, ("a_s", "b_s"), 3600)


@query(f"""
with l as (select *, {_K} % 3 as case_id from events where event_type = 'purchase'), r as (select *, {_K} % 3 as case_id from events where event_type = 'signup')
select l.case_id, l.event_id as run_id, r.event_id as registration_id from l asof join r on l.case_id = r.case_id and l.user_id = r.user_id and r.ts <= l.ts""")
def case_registrations(spark, sf_dir):
    """As-of registrations within each case: the case is one of the keys."""
    rows = table(spark, sf_dir, "events").withColumn("case_id", _k() % 3)
    runs = rows.where("event_type = 'purchase'").select("case_id", "user_id", F.col("event_id").alias("run_id"), F.col("ts").alias("run_ts"))
    made = rows.where("event_type = 'signup'").select("case_id", "user_id", F.col("event_id").alias("registration_id"), F.col("ts").alias("made_ts"))
    return joins.asof_latest(runs, made, ["case_id", "user_id"], "run_ts", "made_ts").select("case_id", "run_id", "registration_id")


@query(_EVIDENCE + """
, w as (select src as node, kind, 'out' as direction, dst as other, record, time from e union all select dst, kind, 'in', src, record, time from e),
s as (select node, count(distinct record) as records, min(time) as first_seen, max(time) as last_seen from w group by 1),
c as (select node, string_agg(x, ',' order by x) as edges from (select node, kind || ':' || direction || ':' || count(distinct other) as x from w group by node, kind, direction) group by 1),
a as (select 'p' || p_partkey as node, 'brand:' || p_brand || ';size:' || p_size as attributes from part)
select s.*, edges, attributes, case when s.node like 'c%' then 'matched' else 'not_used_as_origin' end as outcome from s join c using (node) left join a using (node)""")
def node_details(spark, sf_dir):
    """Each node with its evidence, edges by kind, attributes and outcome."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("node"), F.lit("in").alias("direction"), F.col("src").alias("other")),
    )
    # dealt out by node once, as numbers
    ways = numbered(spark, sf_dir).select(F.explode(ends).alias("w"), "kind", "record", "time").select("w.*", "kind", "record", "time").repartition("node")
    summaries = ways.groupBy("node").agg(F.count_distinct("record").alias("records"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))
    counts = ways.groupBy("node", "kind", "direction").agg(F.count_distinct("other").alias("n_edges"))
    summaries, counts = named(summaries), named(counts)
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.array(
        F.struct(F.lit("brand").alias("attribute"), F.col("p_brand").alias("values")), F.struct(F.lit("size").alias("attribute"), F.col("p_size").cast("string").alias("values"))
    ).alias("a"))
    attributes = part.select("node", F.explode("a").alias("a")).select("node", "a.*")
    outcomes = counts.where("kind = 'placed' and direction = 'out'").select("node", F.lit("matched").alias("outcome"))
    return details.node_details(summaries, counts, attributes, outcomes)


@query(_EVIDENCE + """
, g as (select kind || '|' || src || '|' || dst as edge, record % 3 as g, case when record % 7 <> 0 then time end as time from e)
select edge, count(*) as records, count(*) filter (time is null) as undated, min(time) as first_seen, max(time) as last_seen, count(distinct g) as groups from g group by 1""")
def edge_details(spark, sf_dir):
    """Each edge with its evidence and groups."""
    rows = evidence(spark, sf_dir).select(
        F.concat_ws("|", "kind", "src", "dst").alias("edge"), "record", (F.col("record") % 3).alias("g"), F.when(F.col("record") % 7 != 0, F.col("time")).alias("time")
    )
    return details.edge_details(rows, ["g"])


@query("""select o_orderstatus as place, o_orderpriority as priority, 'a' || o_custkey % 9 as account, count(distinct o_orderkey) as records
from orders where o_custkey % 4 <> 0 group by 1, 2, 3""")
def group_accounts(spark, sf_dir):
    """Accounts that the evidence of each group names."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("place"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("record"),
        F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("a"), (F.col("o_custkey") % 9).cast("string"))).alias("account"),
    )
    return details.group_accounts(rows, ["place", "priority"])


@query("""
with e as (select c_custkey as edge from customer), v as (select o_custkey as edge, min(o_orderdate) as lo, max(o_orderdate) as hi from orders where o_custkey % 3 = 0 group by 1),
a as (select c_custkey as edge from customer where c_custkey % 2 = 0), l as (select c_custkey as edge from customer where c_custkey % 5 = 0)
select e.edge, case when v.edge is not null then v.lo when a.edge is not null then timestamp '1995-01-01' when l.edge is not null then timestamp '1996-01-01' end as low,
  case when v.edge is not null then v.hi when a.edge is not null then timestamp '1995-06-01' when l.edge is not null then timestamp '1996-06-01' end as high,
  case when v.edge is not null then 'evidence' when a.edge is not null then 'assignment' when l.edge is not null then 'lease' end as basis
from e left join v using (edge) left join a using (edge) left join l using (edge)""")
def edge_ranges(spark, sf_dir):
    """Range of an edge by its evidence, else by assignments, else by a lease."""
    edges = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("edge"))
    seen = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("edge"), F.col("o_orderdate").cast("timestamp_ntz").alias("time"))

    def fixed(rows, low: str, high: str):
        return rows.select("edge", F.expr(f"TIMESTAMP_NTZ'{low} 00:00:00'").alias("low"), F.expr(f"TIMESTAMP_NTZ'{high} 00:00:00'").alias("high"))

    return details.edge_ranges(edges, seen, fixed(edges.where("edge % 2 = 0"), "1995-01-01", "1995-06-01"), fixed(edges.where("edge % 5 = 0"), "1996-01-01", "1996-06-01"))


@query("""
with r as (select event_id as record, event_type as source, 'line' as position_kind, event_id // 3 as position, user_id from events)
select source, position_kind, position, min(record) as record, min_by(user_id, record) as user_id from r group by 1, 2, 3""")
def records_by_position(spark, sf_dir):
    """The first record at each position of a source."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.lit("line").alias("position_kind"), F.floor(F.col("event_id") / 3).alias("position"), F.col("event_id").alias("record"), "user_id"
    )
    return details.by_position(rows, "record")


@query("""select event_id as record, 'type=' || event_type || chr(10) || 'user=' || user_id as text from events where event_id in (select event_id + 1 from events where event_type = 'error')""")
def converted_texts(spark, sf_dir):
    """Searchable texts of the wanted records, a field a line."""
    rows = table(spark, sf_dir, "events")
    pairs = F.array(
        F.struct(F.lit(2).alias("ord"), F.lit("user").alias("name"), F.col("user_id").cast("string").alias("value")),
        F.struct(F.lit(1).alias("ord"), F.lit("type").alias("name"), F.col("event_type").alias("value")),
        F.struct(F.lit(3).alias("ord"), F.lit("none").alias("name"), F.lit(None).cast("string").alias("value")),
    )
    fields = rows.select(F.col("event_id").alias("record"), F.explode(pairs).alias("f")).select("record", "f.*")
    return details.raw_texts(details.converted_texts(fields), rows.where("event_type = 'error'").select((F.col("event_id") + 1).alias("record")))


@query("""
with r as (select event_type as source, case when event_id % 9 <> 0 then event_id % 500 end as number from events),
s as (select source, max(number) as highest, count(*) filter (number is null) as unreadable from r group by 1),
h as (select event_type as source, case event_type when 'view' then null when 'click' then 1 else max(case when event_id % 9 <> 0 then event_id % 500 end) + 1 end as next from events group by 1)
select h.source, highest, next, unreadable, case when next is null then 'unreadable' when next = highest + 1 then 'agrees' else 'differs' end as comparison from h join s using (source)""")
def header_numbers(spark, sf_dir):
    """Record numbers of files against the next one that their headers hold."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.when(F.col("event_id") % 9 != 0, (F.col("event_id") % 500).cast("string")).otherwise("x").alias("number"))
    top = rows.where("number <> 'x'").groupBy("source").agg((F.max(F.col("number").cast("long")) + 1).cast("string").alias("top"))
    heads = top.select("source", F.when(F.col("source") == "view", "?").when(F.col("source") == "click", "1").otherwise(F.col("top")).alias("next"))
    return details.header_comparison(rows, heads)


@query("""select event_id as record from events where event_id % 7 = 0 order by 1 limit 40""")
def unrendered_messages(spark, sf_dir):
    """The first forty records without a message; the limit is the feature."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("record"), F.when(F.col("event_id") % 7 != 0, F.lit("m")).alias("message"))
    return details.unrendered(rows, 40)


@query("""
with r as (select event_id as record, unnest([ts - interval 1 day, null, ts - interval 2 day]) as "at", unnest([0, 1, 2]) as position from events where event_type = 'view')
select record, "at", position from r where "at" is not null""")
def run_times(spark, sf_dir):
    """Further run times of a record as rows."""
    more = F.array(F.expr("ts - interval 1 day"), F.lit(None).cast("timestamp_ntz"), F.expr("ts - interval 2 day"))
    return details.run_times(table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("event_id").alias("record"), more.alias("more")))


@query("""
with r as (select event_id as record, user_id % 20 as address, epoch_us(ts) // 1000000 as s from events where event_type = 'view'),
a as (select user_id % 16 + 4 as address, epoch_us(ts) // 1000000 as lo, case when event_id % 4 <> 0 then epoch_us(ts) // 1000000 + 3600 end as hi, 't' || event_id % 3 as terminal from events where event_type = 'signup'),
h as (select distinct record, terminal from r join a using (address) where s >= lo and (hi is null or s <= hi))
select record, coalesce(string_agg(terminal, ',' order by terminal), '') as terminals from r left join h using (record) group by 1""")
def supplemented_records(spark, sf_dir):
    """Records with the terminals that assignments give their address; some assignments are open."""
    rows, at = table(spark, sf_dir, "events"), epoch_s(F.col("ts"))
    address = F.col("user_id") % 20
    made = rows.where("event_type = 'signup'").select(
        (F.col("user_id") % 16 + 4).alias("address"), at.alias("start_s"), F.when(F.col("event_id") % 4 != 0, at + 3600).alias("end_s"), F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("terminal")
    )
    out = details.supplemented(rows.where("event_type = 'view'").select(F.col("event_id").alias("record"), address.alias("address"), at.alias("at")), made)
    return out.select("record", F.array_join("terminal_items", ",").alias("terminals"))


@query("""
with e as (select 'n' || case when c_nationkey < 2 then c_custkey % 40 else 1000 + c_custkey end as node, 'h' || c_nationkey % 3 as host from customer),
k as (select 'n' || s_suppkey as node, 'h' || s_suppkey % 2 as host from supplier), b as (select * from e union select * from k)
select node, min(host) as host from b group by 1 having count(distinct host) = 1""")
def node_hosts(spark, sf_dir):
    """The one host of each node."""
    number = F.when(F.col("c_nationkey") < 2, F.col("c_custkey") % 40).otherwise(F.col("c_custkey") + 1000)
    edges = table(spark, sf_dir, "customer").select(F.lit("ran_on").alias("kind"), F.concat(F.lit("n"), number.cast("string")).alias("src"), F.concat(F.lit("h"), (F.col("c_nationkey") % 3).cast("string")).alias("dst"))
    keyed = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("node"), F.concat(F.lit("h"), (F.col("s_suppkey") % 2).cast("string")).alias("host"))
    return details.node_hosts(edges, keyed)


@query("""select o_orderkey, sha256('rule 1' || chr(10) || 'buyer=' || o_custkey || chr(10) || 'order=' || o_orderkey) as id from orders""")
def match_ids(spark, sf_dir):
    """Digests of the bindings of a rule."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("buyer"))
    return details.match_ids(rows, "rule 1", ["order", "buyer"]).select("o_orderkey", "id")


@query("""
select p_partkey, case when p_partkey % 4 <> 0 then lower(p_brand) <> 'brand#' || p_size else false end as renamed,
  case when p_partkey % 3 = 0 then 'label' || p_size else 'f' || p_partkey || '.exe' end as label, p_partkey % 3 <> 0 as derived, 'chan' as capability from part""")
def file_names_and_labels(spark, sf_dir):
    """Labels of files, names that differ from the original one, and what input a record shows."""
    path = F.concat(F.lit("c:\\\\dir/sub\\\\f"), F.col("p_partkey").cast("string"), F.lit(".exe"))
    own = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("label"), F.col("p_size").cast("string")))
    label, derived = details.node_label(own, path, F.lit("file"))
    original = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("BRAND#"), F.col("p_size").cast("string"), F.lit(".dll"))).otherwise(" ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", details.original_name_differs(F.concat(F.col("p_brand"), F.lit(".exe")), original).alias("renamed"),
        label.alias("label"), derived.alias("derived"), details.capability(F.lit(""), F.lit("CHAN")).alias("capability"),
    )


@query(f"""
with c as (select user_id as logon, {_K} % 4 as tier, event_id as session from events where event_type = 'error')
select *, row_number() over (partition by logon order by tier, session) as place from c""")
def candidates_by_tier(spark, sf_dir):
    """Candidates in the order of their tier."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("logon"), (_k() % 4).alias("tier"), F.col("event_id").alias("session"))
    return details.by_tier(rows, "logon", "tier", "session")


@query("""
select event_id, case when event_id % 3 = 0 then ts - interval 1 hour - interval 2 hour when event_id % 3 = 1 then ts - interval 2 hour end as start,
  case when event_id % 5 <> 0 then ts - interval 9 hour end as low, case when event_id % 5 <> 0 then ts + interval 1 day - interval 9 hour end as high from events""")
def recorded_starts(spark, sf_dir):
    """Starts that records of an end themselves hold, and ranges read under an offset."""
    wall = F.when(F.col("event_id") % 3 == 0, F.expr("ts - interval 1 hour")).when(F.col("event_id") % 3 == 1, F.col("ts")).otherwise(F.expr("ts + interval 3 hour"))
    low, high = details.interpreted_range(F.col("ts"), F.expr("ts + interval 1 day"), F.when(F.col("event_id") % 5 != 0, 540).otherwise(1081))
    return table(spark, sf_dir, "events").select("event_id", details.recorded_start(F.col("ts"), wall, F.lit(120)).alias("start"), low.alias("low"), high.alias("high"))


_V6 = ("2001:db8::%x", "2001:db8:0:1::%x", "fe80:0:0:0:0:0:0:%x", "[2001:db8:0:2::%x]", "10.0.0.%d", "2001:db8:::%x")


@query("""
select p_partkey, p_partkey % 6 in (0, 1, 3) as in_block, p_partkey % 6 in (0, 1) as in_odd, p_partkey % 6 = 4 as in_v4, p_partkey % 6 not in (0, 1, 3, 5) as passes from part""")
def address_blocks(spark, sf_dir):
    """IPv6 and IPv4 blocks, and what a search's blocks let through."""
    n = (F.col("p_partkey") % 200).cast("int")
    text = F.lit(None).cast("string")
    for i, form in enumerate(_V6):
        text = F.when(F.col("p_partkey") % 6 == i, F.format_string(form, n)).otherwise(text)
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("ip")).select(
        "p_partkey", network.in_cidr(F.col("ip"), "2001:db8::/32").alias("in_block"), network.in_cidr(F.col("ip"), "2001:db8::/63").alias("in_odd"),
        network.in_cidr(F.col("ip"), "10.0.0.0/8").alias("in_v4"), network.passes_blocks(F.lit("ip"), F.col("ip"), outside="2001:db8::/32").alias("passes"),
    )


_TRAIL_SQL = f"""
with o as (
  select event_id as origin, user_id % 30 as address, {_K} % 20 as port, case when event_id % 9 = 0 then null else user_id % 4 end as target, epoch_us(ts) // 1000000 as t
  from events where event_type = 'error'),
c as (
  select user_id % 37 as address, {_K} % 23 as port, case when event_id % 7 = 0 then null else event_id % 4 end as target, epoch_us(ts) // 1000000 as t
  from events where event_type = 'click' and user_id % 2 = 0),
n as (
  select o.origin, o.target is null as open, (select count(*) from c) as s0, count(c.t) as s1, count(c.t) filter (c.port = o.port) as s2,
         count(c.t) filter (c.port = o.port and c.target = o.target) as s3,
         count(c.t) filter (c.port = o.port and c.target = o.target and abs(c.t - o.t) <= 500000) as s4
  from o left join c on c.address = o.address group by o.origin, o.target),
s as (
  select origin, open, unnest([0, 1, 2, 3, 4]) as stage, unnest(['all', 'address', 'port', 'target', 'time']) as condition,
         unnest([s0, s1, s2, s3, s4]) as stays, unnest([1, s0, s1, s2, s3]) as before from n)
select origin, stage::int as stage, condition, stays, case when stays > 0 then 'kept' when open and stage > 2 then 'unread' when before > 0 then 'emptied' else 'empty' end as state
from s"""


@query(_TRAIL_SQL)
def condition_trails(spark, sf_dir):
    """How many candidates each condition leaves of those before it, and which one empties the set."""
    rows, at = table(spark, sf_dir, "events"), epoch_s(F.col("ts"))
    target = F.when(F.col("event_id") % 9 == 0, None).otherwise(F.col("user_id") % 4)
    origins = rows.where("event_type = 'error'").select(F.col("event_id").alias("origin"), (F.col("user_id") % 30).alias("src"), (_k() % 20).alias("port"), target.alias("dst"), at.alias("at"))
    theirs = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("event_id") % 4)
    candidates = rows.where("event_type = 'click' and user_id % 2 = 0").select((F.col("user_id") % 37).alias("c_src"), (_k() % 23).alias("c_port"), theirs.alias("c_dst"), at.alias("c_at"))
    conditions = [("address", "src", "c_src"), ("port", "port", "c_port"), ("target", "dst", "c_dst")]
    return details.condition_trail(origins, candidates, "origin", conditions, ("at", "c_at"), 500_000)


_EVENTS_SQL = f"""
e as (
  select event_id as record, case when event_id % 11 = 0 then 'Other' else 'Microsoft-Windows-Sysmon' end as provider,
         [1, 2, 3, 11, 12, 13, 22][event_id % 7 + 1] as event_id, event_id as n, user_id as u, {_K} as k, ts from events),
d as (
  select record, provider, event_id, n % 4 = 0 as initiated, unnest(['UtcTime', 'ProcessGuid', 'Image', 'TargetFilename', 'SourceIp', 'DestinationHostname', 'TargetObject', 'Initiated', 'Extra']) as name,
         unnest([case when n % 5 = 0 then 'never' else strftime(ts, '%Y-%m-%d %H:%M:%S') || '.250' end,
                 case when k % 4 = 0 then '{{00000000-0000-0000-0000-000000000000}}' else '{{' || u || '}}' end, '', 'f' || k,
                 case when k % 3 = 0 then '-' else '10.0.0.' || k end, case when k % 2 = 0 then '-' else 'h' || k end, case when u % 6 = 0 then '' else 'HK' || u end,
                 case when n % 4 = 0 then 'true' else 'false' end, 'x']) as value, ts, n
  from e),
m as (
  select *, case when provider = 'Other' then null when name = 'Image' and event_id < 20 then 'process.binary_path' when name = 'ProcessGuid' and event_id < 20 then 'process.id'
    when name = 'UtcTime' and n % 5 > 0 and event_id < 20 then case when event_id = 1 then 'process.start_time' else 'event.operation_start_time' end
    when name = 'TargetFilename' and event_id in (2, 11) then 'file.path' when name = 'TargetObject' and event_id in (12, 13) then 'registry_value.key_path'
    when name = 'SourceIp' and event_id = 3 and initiated then 'connection.source_address'
    when name = 'DestinationHostname' and event_id = 3 and initiated then 'connection.destination_reverse_lookup_name' end as semantic from d)"""


def _monitored(spark, sf_dir):
    n, u, k = F.col("event_id"), F.col("user_id").cast("string"), _k()
    kind = F.element_at(F.array(*map(F.lit, (1, 2, 3, 11, 12, 13, 22))), (n % 7 + 1).cast("int"))
    text = k.cast("string")
    data = {
        "UtcTime": F.when(n % 5 == 0, "never").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".250"))),
        "ProcessGuid": F.when(k % 4 == 0, "{00000000-0000-0000-0000-000000000000}").otherwise(F.concat(F.lit("{"), u, F.lit("}"))),
        "Image": F.lit(""),
        "TargetFilename": F.concat(F.lit("f"), text),
        "SourceIp": F.when(k % 3 == 0, "-").otherwise(F.concat(F.lit("10.0.0."), text)),
        "DestinationHostname": F.when(k % 2 == 0, "-").otherwise(F.concat(F.lit("h"), text)),
        "TargetObject": F.when(F.col("user_id") % 6 == 0, "").otherwise(F.concat(F.lit("HK"), u)),
        "Initiated": F.when(n % 4 == 0, "true").otherwise("false"),
        "Extra": F.lit("x"),
    }
    return table(spark, sf_dir, "events").select(
        n.alias("record"), F.when(n % 11 == 0, "Other").otherwise("Microsoft-Windows-Sysmon").alias("provider"), kind.alias("event_id"),
        F.create_map(*(x for name, v in data.items() for x in (F.lit(name), v))).alias("data"),
    )


@query(f"""
with {_EVENTS_SQL}
select record, name, semantic, value,
       case when semantic in ('process.id', 'file.path', 'registry_value.key_path', 'connection.source_address', 'connection.destination_reverse_lookup_name')
              and value in ('', '-', '{{00000000-0000-0000-0000-000000000000}}') then 'absent' else 'present' end as state,
       case when semantic like '%_time' then epoch_us(ts) // 1000000 end as second
from m""")
def event_meanings(spark, sf_dir):
    """What the data of system monitor events mean, and which of it says that there is nothing."""
    out = meanings.event_meanings(_monitored(spark, sf_dir))
    return out.withColumn("second", epoch_s(F.col("instant"))).drop("instant")


@query(f"""
with {_EVENTS_SQL},
r as (select record, provider, event_id, n % 3 = 0 as rendered, n % 6 = 0 as unnamed, n % 10 = 3 as twice, k from e)
select record,
       case when twice or (rendered and unnamed) then 'unknowable' when event_id <> 2 then 'known'
            when not rendered or (provider <> 'Other' and not unnamed) then 'absent' else 'unknowable' end as image,
       case when rendered and unnamed then 'unknowable' when not rendered or (provider <> 'Other' and not unnamed) then 'absent' else 'unknowable' end as other,
       case when record % 2 = 0 then 'known' else 'absent' end as level,
       case when twice or (rendered and unnamed) then null when event_id <> 2 then k % 2 = 0 when not rendered or (provider <> 'Other' and not unnamed) then false end as even
from r""")
def knowable_names(spark, sf_dir):
    """Whether a record's fields can say what a name asks for, and a term in three values."""
    n, c = F.col("record"), F.lit("EventData.")
    own = _monitored(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("record"), _k().alias("k")), "record")
    names = F.array_compact(F.array(
        F.when(F.col("event_id") != 2, F.concat(c, F.lit("Image"))), F.when(n % 10 == 3, F.concat(c, F.lit("Image#2"))),
        F.when(n % 6 == 0, F.concat(c, F.lit("Data"))), F.when(n % 2 == 0, F.lit("Level")), F.concat(c, F.lit("Extra")),
    ))
    form = F.when(n % 3 == 0, meanings.RENDERED).otherwise("windows_event_xml")
    rows = own.withColumns({"names": names, "form": form})
    of = (F.col("names"), F.col("form"), F.col("provider"))
    return rows.select(
        "record", meanings.knowledge("Image", *of).alias("image"), meanings.knowledge("Other", *of).alias("other"), meanings.knowledge("Level", *of).alias("level"),
        meanings.when_known("Image", F.col("k") % 2 == 0, *of).alias("even"),
    )
