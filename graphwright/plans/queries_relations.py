"""Queries of logon relations, object extraction and further aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import epoch_s, epoch_us
from ..operators import joins, lineage, logons, records
from ..sources import structured
from .registry import query, table

_K = "cast(json_extract_string(props, '$.k') as bigint)"


def _events(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _kind(spark, sf_dir, kind: str):
    return _events(spark, sf_dir).where(F.col("event_type") == kind)


@query(f"""
with e as (select *, {_K} as k from events),
a as (select event_id as logon, event_id % 4 as t, event_id % 3 as s, ts, k * 16 + user_id % 15 as id from e where event_type = 'signup'),
b as (select event_id as operation, event_id % 4 as t, event_id % 3 as s, ts, k * 16 + user_id % 15 as id from e where event_type = 'error')
select logon, operation, case when a.t <> b.t then 'other_terminal' when a.s <> b.s then 'other_source' when b.ts < a.ts then 'before_logon' end as reason
from a join b using (id)""")
def logon_operations(spark, sf_dir):
    """Operations of a logon session, and why others are rejected, pair by pair."""
    t, s = F.col("event_id") % 4, F.col("event_id") % 3
    id_ = F.concat(F.lit("0x00"), F.hex(F.col("k") * 16 + F.col("user_id") % 15))
    a = _kind(spark, sf_dir, "signup").select(F.col("event_id").alias("logon"), t.alias("terminal"), s.alias("source"), F.col("ts").alias("at"), id_.alias("id"))
    b = _kind(spark, sf_dir, "error").select(
        F.col("event_id").alias("operation"), t.alias("o_terminal"), s.alias("o_source"), F.col("ts").alias("o_at"), id_.alias("id")
    )
    return logons.session_operations(a, b)


@query(f"""
with e as (select event_id, user_id, {_K} % 7 as id, {_K} % 5 as linked from events where event_type = 'signup')
select a.event_id as first, b.event_id as second from e a join e b on a.user_id = b.user_id and a.id = b.linked and a.linked = b.id and a.event_id < b.event_id""")
def linked_logons(spark, sf_dir):
    """Two logons that name each other."""
    rows = _kind(spark, sf_dir, "signup").select(
        F.col("event_id").alias("logon"), F.col("user_id").alias("terminal"), F.lit(1).alias("source"), (F.col("k") % 7).alias("id"), (F.col("k") % 5).alias("linked_id")
    )
    return logons.linked_logons(rows)


@query(f"""
with e as (select event_id, event_type, {_K} * 1000 + user_id as g from events)
select a.event_id as ticket, b.event_id as logon from e a join e b on a.event_type = 'signup' and b.event_type = 'purchase' and a.g = b.g""")
def ticket_logons(spark, sf_dir):
    """Ticket requests and logons with one GUID, however it is written."""
    n = F.col("k") * 1000 + F.col("user_id") + 1
    guid = F.format_string("%08x-0000-0000-0000-0000000000ff", n)
    a = _kind(spark, sf_dir, "signup").select(F.col("event_id").alias("ticket"), F.concat(F.lit("{"), F.upper(guid), F.lit("}")).alias("guid"))
    b = _kind(spark, sf_dir, "purchase").select(F.col("event_id").alias("logon"), guid.alias("guid"))
    return logons.ticket_logons(a, b)


@query(f"""
with e as (select *, {_K} as k, epoch_us(ts) // 1000 as ms from events)
select a.event_id as request, b.event_id as logon from e a join e b on a.event_type = 'view' and b.event_type = 'click' and a.user_id = b.user_id
 and a.k % 3 = b.k % 3 and abs(a.ms - b.ms) <= 3600000 and b.k % 2 = 0 and a.k % 5 <> b.k % 3""")
def explicit_credential_logons(spark, sf_dir):
    """Requests with explicit credentials and the logons they led to."""
    ms = F.floor(epoch_us(F.col("ts")) / 1000).cast("long")
    account = F.col("user_id").cast("string")
    a = _kind(spark, sf_dir, "view").select(F.col("event_id").alias("request"), F.concat(F.lit("U"), account).alias("account"), (F.col("k") % 5).alias("from_terminal"), (F.col("k") % 3).alias("to_terminal"), ms.alias("at_ms"))
    b = _kind(spark, sf_dir, "click").select(F.col("event_id").alias("logon"), F.concat(F.lit("u"), account).alias("account"), (F.col("k") % 3).alias("terminal"), ms.alias("logon_ms"), (F.col("k") % 2 == 0).alias("success"))
    return logons.explicit_logons(a, b, tolerance_ms=3_600_000)


@query(f"""
with e as (select *, {_K} as k from events),
l as (select * from e where event_type = 'purchase' and k % 10 <> 0),
s as (select *, ts + interval 2 day as ended from e where event_type = 'signup'),
c as (select l.event_id as logon, s.event_id as session, (case when s.k % 3 = 0 then 0 when s.k % 3 = 1 then 2 else 1 end) + case when l.k % 2 = s.k % 2 then 0 else 3 end as tier
      from l join s on l.user_id = s.user_id and l.ts between s.ts and s.ended)
select logon, session, case when count(*) over (partition by logon) > 1 then 'uncertain_chain' else 'candidate' end as state, tier,
  count(*) over (partition by logon) as candidates, rank() over (partition by logon order by tier) - 1 as better from c""")
def logon_chains(spark, sf_dir):
    """Sessions that a logon may come from, with tiers."""
    account = F.concat(F.lit("A"), (F.col("k") % 2).cast("string"))
    kind = F.when(F.col("k") % 3 == 0, "interactive").when(F.col("k") % 3 == 1, "network").otherwise("service")
    l = _kind(spark, sf_dir, "purchase").select(F.col("event_id").alias("logon"), F.col("user_id").alias("source_terminal"), F.col("ts").alias("at"), account.alias("account"), "k")
    s = _kind(spark, sf_dir, "signup").select(
        F.col("event_id").alias("session"), F.col("user_id").alias("terminal"), F.col("ts").alias("started"),
        F.timestamp_add("DAY", F.lit(2), F.col("ts")).alias("ended"), F.lower(account).alias("s_account"), kind.alias("kind"),
    )
    return logons.logon_chains(l.drop("k"), s, l.where("k % 10 = 0").select("logon"))


_SAME = f"""
with e as (select *, {_K} as k, epoch_us(ts) as u, epoch_us(ts) // 1000000 as t from events),
r as (
  select event_id as record, event_id % 5 as terminal, user_id % 20 as ip, k % 10 as port, u, t,
         case when event_id % 4 > 0 then '10.0.0.' || event_id % 7 end as dst,
         case event_type when 'view' then 'open' when 'click' then 'close' end as phase
  from e),
g as (select '10.0.0.' || user_id % 7 as ip, t as lo, t + 43200 * (1 + k % 3) as hi, user_id % 5 as owner from e where event_type = 'signup' and k < 50),
ph as (
  select *, lag(phase) over w as was, lag(record) over w as open_id from r where phase is not null
  window w as (partition by ip, port, terminal, dst order by u, record)),
one as (select 'phased' as rule, open_id as first, record as second from ph where phase = 'close' and was = 'open'),
two as (
  select 'unphased' as rule, case when (a.u, a.record) < (b.u, b.record) then a.record else b.record end as first,
         case when (a.u, a.record) < (b.u, b.record) then b.record else a.record end as second
  from r a join r b on a.ip = b.ip and a.port = b.port and a.terminal = b.terminal and a.dst is not distinct from b.dst
    and a.record < b.record and abs(a.t - b.t) <= 43200 and (a.phase is null or b.phase is null)),
res as (
  select r.record, count(distinct g.owner) as n, min(g.owner) as owner, any_value(known.ip) is not null as has
  from r left join g on g.ip = r.dst and r.t between g.lo and g.hi left join (select distinct ip from g) known on known.ip = r.dst
  where r.dst is not null group by r.record),
acc as (
  select c.record as caller, d.record as accepter
  from r c join res on res.record = c.record and res.n = 1 and res.owner <> c.terminal
  join r d on d.ip = c.ip and d.port = c.port and d.terminal = res.owner and abs(c.t - d.t) <= 43200 and (d.dst is null or d.dst = c.dst)),
three as (
  select 'across' as rule, case when bool_or(caller < accepter) then least(caller, accepter) else greatest(caller, accepter) end as first,
         case when bool_or(caller < accepter) then greatest(caller, accepter) else least(caller, accepter) end as second
  from acc group by least(caller, accepter), greatest(caller, accepter))"""


def _connections(spark, sf_dir):
    n, kind = F.col("event_id"), F.col("event_type")
    rows = _events(spark, sf_dir).select(
        n.alias("record"), (n % 5).alias("terminal"), (F.col("user_id") % 20).alias("src_ip"), (F.col("k") % 10).alias("src_port"),
        F.lit(445).alias("dst_port"), F.when(n % 4 > 0, F.concat(F.lit("10.0.0."), (n % 7).cast("string"))).alias("dst_ip"),
        epoch_us(F.col("ts")).alias("at_us"), F.when(kind == "view", "open").when(kind == "click", "close").alias("phase"),
    )
    at = epoch_s(F.col("ts"))
    given = _kind(spark, sf_dir, "signup").where("k < 50").select(
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")).alias("ip"),
        at.alias("start"), (at + 43200 * (1 + F.col("k") % 3)).alias("stop"), (F.col("user_id") % 5).alias("owner"),
    )
    return rows, given, 43_200


@query(_SAME + " select * from one union all select * from two union all select * from three")
def same_connections(spark, sf_dir):
    """Records of one connection: opened and closed, near each other, or seen by both terminals."""
    return logons.same_connections(*_connections(spark, sf_dir))


@query(_SAME + """
select 'phased' as rule, phase as reason, count(*) as records from r
where phase is not null and record not in (select first from one union select second from one) group by phase
union all
select 'unphased', 'no_partner', count(*) from r where phase is null and record not in (select first from two union select second from two) having count(*) > 0
union all
select 'across', case when not has then 'none' when n = 0 then 'outside_range' when n > 1 then 'overlapping' when owner = terminal then 'own_terminal' else 'no_partner' end as reason, count(*)
from res join r using (record) where record not in (select first from three) group by reason""")
def unrelated_connections(spark, sf_dir):
    """Records of connections that a rule relates to no other, by the reason."""
    return logons.unrelated_connections(*_connections(spark, sf_dir))


@query(f"""
with e as (select *, {_K} as k from events)
select event_type as terminal, user_id % 30 as src_ip, count(*) filter (k % 2 = 0) as successes, count(*) filter (k % 2 = 1) as failures,
 count(distinct k % 9) as accounts_tried, count(distinct case when k % 2 = 0 then k % 9 end) as accounts_in, min(ts) as first_seen, max(ts) as last_seen
from e group by 1, 2""")
def remote_logon_tallies(spark, sf_dir):
    """Remote logons of each terminal by source address."""
    rows = _events(spark, sf_dir).select(
        F.col("event_type").alias("terminal"), (F.col("user_id") % 30).alias("src_ip"), F.when(F.col("k") % 2 == 0, "success").otherwise("failure").alias("outcome"), (F.col("k") % 9).alias("account"), F.col("ts").alias("at")
    )
    return logons.remote_logon_tallies(rows)


@query("""
with n as (select o_custkey as node, 'dom' || o_custkey % 2 || '\\' || 'user' || case when o_custkey % 3 = 0 then o_orderkey % 2 else 0 end as name from orders)
select node, case when count(distinct name) = 1 then min(name) end as name from n group by 1""".replace("\\\\", "\\"))
def account_names(spark, sf_dir):
    """The one name of an account, withheld where there are several."""
    key = F.col("o_custkey")
    login = F.concat(F.lit("User"), F.when(key % 3 == 0, F.col("o_orderkey") % 2).otherwise(0).cast("string"), F.lit("@x.org"))
    rows = table(spark, sf_dir, "orders").select(key.alias("node"), F.concat(F.lit("DOM"), (key % 2).cast("string"), F.lit(".corp")).alias("domain"), login.alias("login"))
    return logons.account_names(rows)


@query("""
with r as (select l_orderkey as record, 'process' as object, 'p' || l_partkey as value from lineitem union select l_orderkey, 'terminal', 't' || l_suppkey % 20 from lineitem),
f as (select record, object, value from r where object = 'terminal')
select 'ran_on' as kind, a.value as src, b.value as dst, count(distinct a.record) as records from r a join f b using (record) where a.object = 'process' group by 1, 2, 3""")
def intra_record_links(spark, sf_dir):
    """Relations between the objects that one record names."""
    lines = table(spark, sf_dir, "lineitem")
    semantics = spark.createDataFrame([("process.path", "process", "identity"), ("terminal.name", "terminal", "identity"), ("note", "file", "label")], "semantic string, object string, role string")
    named = F.array(
        F.struct(F.lit("process.path").alias("semantic"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("value")),
        F.struct(F.lit("terminal.name").alias("semantic"), F.concat(F.lit("t"), (F.col("l_suppkey") % 20).cast("string")).alias("value")),
    )
    # each line is a record of its own here; lines of an order are merged behind
    line = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = lines.select(line.alias("record"), F.explode(named).alias("f"))
    fields = rows.select("record", F.lit(1).alias("ord"), "f.semantic", "f.value")
    objects = records.objects(fields, semantics).withColumn("record", F.substring_index("record", "|", 1)).distinct()
    return records.intra_record_links(objects)


@query("""
select l_returnflag, l_linestatus, case when l_linenumber < 4 then l_linenumber end as port, count(*) as records, count(distinct l_suppkey) as accounts
from lineitem group by 1, 2, 3""")
def evidence_groups(spark, sf_dir):
    """Evidence by several parts of which some are absent."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.when(F.col("l_linenumber") < 4, F.col("l_linenumber")).alias("port"), F.col("l_suppkey").alias("account"))
    return records.evidence_groups(rows, ["l_returnflag", "l_linestatus", "port"])


@query("""
with a as (select o_custkey as node, case when o_orderkey % 2 = 0 then 'prio' else 'other' end as attribute, o_orderpriority as value, o_orderkey as record from orders),
c as (select node, attribute, value, count(distinct record) as n from a group by 1, 2, 3)
select node, attribute, string_agg(value || '=' || n, ',' order by n desc, value) as values from c group by 1, 2""".replace("as values", 'as "values"'))
def node_attributes(spark, sf_dir):
    """Attributes of a node with their values in order of count."""
    even = F.col("o_orderkey") % 2 == 0
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("node"), F.when(even, F.lit("prio")).alias("semantic"), F.lit("other").alias("name"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("record")
    )
    return records.grouped_attributes(rows)


@query("""
with o as (select distinct l_orderkey as record, l_suppkey as object from lineitem)
select a.object as a, b.object as b, count(distinct record) as records from o a join o b using (record) where a.object < b.object group by 1, 2""")
def co_occurring_objects(spark, sf_dir):
    """Pairs of objects that records name together."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("object")).distinct()
    return records.co_occurring(rows)


@query("""
with l as (select l_partkey, l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey, min(l_returnflag) as l_returnflag from lineitem group by 1, 2, 3),
f as (select l_partkey as stream, l_orderkey * 10 + l_linenumber as ord, l_suppkey % 2 as source, l_linenumber as number, l_returnflag || 'x' as token from l),
n as (select *, case when number < lag(number) over w or source <> lag(source) over w then 1 else 0 end as new from f window w as (partition by stream order by ord)),
s as (select *, sum(new) over (partition by stream order by ord rows unbounded preceding) as segment from n),
b as (select stream, segment, number, arg_min(token, ord) as token, count(*) as n, count(distinct token) as variants from s group by 1, 2, 3)
select stream, cast(segment as bigint) as segment, string_agg(token, '' order by number) as body, cast(sum(case when variants = 1 then n - 1 else 0 end) as bigint) as duplicates,
 count(*) filter (variants > 1) as conflicts, max(number) - min(number) + 1 - count(*) as missing, 'undetermined' as alphabet from b group by 1, 2""")
def joined_fragments(spark, sf_dir):
    """Bodies sent in numbered pieces, put together."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber")
    rows = one.agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("l_returnflag")).select(
        F.col("l_partkey").alias("stream"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_suppkey") % 2).alias("source"),
        F.col("l_linenumber").alias("number"), F.concat("l_returnflag", F.lit("x")).alias("token"),
    )
    return records.joined_fragments(rows)


@query("""
select p_partkey, kind, value from (
 select p_partkey, 'host' as kind, 'srv' || p_size as value from part union all select p_partkey, 'host', 'h' || p_partkey % 5 || '.org' from part
 union all select p_partkey, 'file', 'c:\\tools\\x' || p_size || '.exe' from part)""".replace("\\\\", "\\"))
def argument_objects(spark, sf_dir):
    """Hosts and paths that command lines name."""
    size = F.col("p_size").cast("string")
    line = F.concat(
        F.lit("C:\\Tools\\X"), size, F.lit(".exe \\\\SRV"), size, F.lit("\\share https://u@H"), (F.col("p_partkey") % 5).cast("string"), F.lit(".org/a")
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    return records.named_objects(rows, "line").drop("line")


@query("""
select o_custkey, o_orderkey, o_orderpriority from orders o where o_orderkey = (select max(x.o_orderkey) from orders x where x.o_custkey = o.o_custkey)""")
def latest_revisions(spark, sf_dir):
    """The latest revision of each key."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return records.latest_revisions(rows, ["o_custkey"], "o_orderkey")


@query("""select time_bucket(interval 10 minute, ts) as bucket, count(*) as records from events group by 1""")
def timeline_buckets(spark, sf_dir):
    """Records per ten minutes."""
    return records.bucketed_timeline(table(spark, sf_dir, "events"), "ts", "10 minutes")


@query("""
with o as (select n_nationkey as source, n_nationkey * 60 - 600 as minutes from nation union all select n_nationkey, 0 from nation where n_nationkey % 6 = 0),
u as (select source, min(minutes) as minutes from o group by 1 having count(distinct minutes) = 1 and abs(min(minutes)) <= 1080)
select event_id, case when minutes is not null then ts - to_minutes(minutes) end as instant from events left join u on user_id % 25 = source""")
def time_interpretations(spark, sf_dir):
    """Local times read under a source's one offset."""
    n = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    offsets = nation.select(n.alias("source"), (n * 60 - 600).alias("minutes")).union(nation.where("n_nationkey % 6 = 0").select(n, F.lit(0)))
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("source"), F.col("ts").alias("local_time"))
    return records.interpreted_times(rows, offsets).select("event_id", "instant")


@query("""
select s_nationkey as collection, sha256(string_agg(s_name, chr(10) order by s_name)) as terminal from supplier group by 1""")
def collection_terminals(spark, sf_dir):
    """A terminal for each collection, by the hashes of its members."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("collection"), F.col("s_name").alias("sha256"))
    return records.collection_terminals(rows)


@query("""
with p as (select p_partkey, 'a/d' || p_size % 3 || '/f' || p_partkey % 1500 as path, 'f' || p_partkey % 1500 as name, 'd' || p_size % 3 || '/f' || p_partkey % 1500 as two from part)
select p_partkey, case when count(*) over (partition by name) = 1 then name when count(*) over (partition by two) = 1 then two else path end as shown from p""")
def file_names(spark, sf_dir):
    """File names with as much of the folder as tells them apart."""
    path = F.concat(F.lit("a/d"), (F.col("p_size") % 3).cast("string"), F.lit("/f"), (F.col("p_partkey") % 1500).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return records.distinguished_names(rows, "path").select("p_partkey", "shown")


@query("""
select event_id, false as failed, make_timestamp(epoch_us(ts) // 1000 * 1000) as at, 'u' || user_id as "user", event_type as result, 'http://h/' || event_id as target from events""")
def proxy_log(spark, sf_dir):
    """Proxy lines under the native format."""
    ms = F.floor(epoch_us(F.col("ts")) / 1000).cast("long")
    line = F.format_string(
        "%d.%03d %6d 10.0.0.1 %s/200 %d GET http://h/%d u%d DIRECT/- text/html",
        F.floor(ms / 1000).cast("long"), ms % 1000, F.col("event_id") % 900, F.col("event_type"), F.col("event_id"), F.col("event_id"), F.col("user_id"),
    )
    rows = structured.proxy_records(table(spark, sf_dir, "events").select("event_id", line.alias("line")), "squid")
    return rows.select("event_id", "failed", F.col("instant").cast("timestamp_ntz").alias("at"), "user", "result", "target")


@query("""select o_orderkey, 'Audit' as provider, 4624 as event_id, 'pc' || o_custkey as computer, o_orderpriority as account, o_orderdate as at from orders""")
def event_xml(spark, sf_dir):
    """Event XML and its named data."""
    xml = F.format_string(
        '<Event xmlns="urn:e"><System><Provider Name="Audit"/><EventID>4624</EventID><TimeCreated SystemTime="%sZ"/><EventRecordID>%d</EventRecordID><Computer>pc%d</Computer></System><EventData><Data Name="Empty"/><Data Name="Account">%s</Data></EventData></Event>',
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority"),
    )
    rows = structured.event_records(table(spark, sf_dir, "orders").select("o_orderkey", xml.alias("xml")))
    return rows.select("o_orderkey", "provider", "event_id", "computer", F.element_at("data", "Account").alias("account"), F.col("instant").cast("timestamp_ntz").alias("at"))


@query("""select c_custkey, c_name as name, 'h' || c_nationkey as host, 3389 as port, false as leaks from customer""")
def connection_objects(spark, sf_dir):
    """Remote connection objects without their passwords."""
    xml = F.format_string("<Obj><Name>%s</Name><URI>h%d</URI><Port>3389</Port><CredentialPassword>secret%d</CredentialPassword></Obj>", "c_name", "c_nationkey", "c_custkey")
    rows = structured.connection_objects(table(spark, sf_dir, "customer").select("c_custkey", xml.alias("xml")))
    return rows.select("c_custkey", "name", "host", "port", F.col("xml").contains("secret").alias("leaks"))


@query(f"""
with i as (select user_id % 40 as pid, event_id as instance, epoch_us(ts) // 1000000 as s, epoch_us(ts) // 1000000 + 14400 as e from events where event_type = 'signup'),
c as (select event_id as child, {_K} % 40 as pid, epoch_us(ts) // 1000000 as t from events where event_type = 'view')
select child, min(instance) as parent from c join i using (pid) where t between s and e group by 1 having count(distinct instance) = 1""")
def process_lineage(spark, sf_dir):
    """The live parent of a process at its start, if there is exactly one."""
    at = epoch_s(F.col("ts"))
    spans = _kind(spark, sf_dir, "signup").select((F.col("user_id") % 40).alias("pid"), F.col("event_id").alias("parent"), at.alias("s"), (at + 14400).alias("e"))
    rows = _kind(spark, sf_dir, "view").select(F.col("event_id").alias("child"), (F.col("k") % 40).alias("pid"), at.alias("at"))
    return joins.live_parents(rows, spans, ["pid"], "child", "at", "s", "e", "parent")


@query(f"""
with p as (select event_id as request, event_id + 1 as logon, user_id % 4 as terminal, {_K} % 5 as logon_id, epoch_us(ts) // 1000000 as t from events where event_type = 'click'),
s as (select event_id as session, user_id % 4 as terminal, {_K} % 5 as logon_id, epoch_us(ts) // 1000000 as s, epoch_us(ts) // 1000000 + 3600 as e from events where event_type = 'purchase')
select distinct logon, session from p join s using (terminal, logon_id) where t between s.s and s.e""")
def requested_sessions(spark, sf_dir):
    """Sessions in which the requests behind logons were made."""
    at = epoch_s(F.col("ts"))
    own = [(F.col("user_id") % 4).alias("terminal"), (F.col("k") % 5).alias("logon_id")]
    clicks = _kind(spark, sf_dir, "click")
    pairs = clicks.select(F.col("event_id").alias("request"), (F.col("event_id") + 1).alias("logon"))
    requests = clicks.select(F.col("event_id").alias("request"), *own, at.alias("at"))
    sessions = _kind(spark, sf_dir, "purchase").select(F.col("event_id").alias("session"), *own, at.alias("started"), (at + 3600).alias("ended"))
    return logons.requested_sessions(pairs, requests, sessions)


@query(f"""
with r as (select event_id as record, user_id % 6 as terminal, case when {_K} % 8 = 7 then '224.0.0.1' else '10.9.8.' || {_K} % 8 end as ip, event_type = 'signup' and user_id % 6 = {_K} % 8 as owned from events)
select terminal, ip as address, count(distinct record) as records from r where not owned and ip <> '224.0.0.1'
 and not exists (select 1 from r o where o.owned and o.terminal = r.terminal and o.ip = r.ip) group by 1, 2""")
def outbound_connections(spark, sf_dir):
    """Destinations of a terminal that reach another one."""
    n, terminal = F.col("k") % 8, F.col("user_id") % 6
    ip = F.when(n == 7, F.lit("224.0.0.1")).otherwise(F.concat(F.lit("10.9.8."), n.cast("string")))
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("record"), terminal.alias("terminal"), ip.alias("dst_ip"), ((F.col("event_type") == "signup") & (terminal == n)).alias("owned"))
    return logons.outbound_connections(rows)


_PROCESSES = f"""
with o as (
  select event_id as position, event_id % 3 as terminal, user_id % 12 as pid, {_K} % 13 as parent_pid,
         epoch_us(ts) // 3600000000 as t, event_type in ('signup', 'purchase') as starts, event_type = 'error' as ends,
         case when event_id % 2 = 0 then 0 else event_id end as sequence
  from events),
bounds as (
  select terminal, pid, t, min(sequence) as lo, max(sequence) as hi from o where starts or ends group by all),
m as (
  select o.*, ends and (lo <> sequence or hi <> sequence) as unclear
  from o left join bounds using (terminal, pid, t)),
op as (
  select *, not coalesce(unclear, false) and (starts or coalesce(lag(ends) over w, true)) as opens
  from m window w as (partition by terminal, pid order by t, position)),
i as (
  select *, case when not coalesce(unclear, false) then last_value(case when opens then position end ignore nulls) over w end as process
  from op window w as (partition by terminal, pid order by t, position rows between unbounded preceding and current row)),
spans as (
  select terminal, pid, process, min(t) as first_seen, max(t) as last_seen, count(*) as rows from i where process is not null group by all),
state as (
  select c.terminal, c.position, arg_max(case when p.ends then -1 else p.process end, (p.t, p.position)) as open
  from i c join i p on p.terminal = c.terminal and p.pid = c.parent_pid and (p.t, p.position) < (c.t, c.position)
    and (not coalesce(p.unclear, false) or p.ends)
  where c.opens group by all),
parents as (
  select c.terminal, c.pid, c.position as process,
         case when c.parent_pid = c.pid then 'own_pid' when lo <> c.sequence or hi <> c.sequence then 'ambiguous'
              when coalesce(open, -1) = -1 then 'not_open' else 'parent' end as outcome, open
  from i c left join state s on s.position = c.position
  left join bounds b on b.terminal = c.terminal and b.pid = c.parent_pid and b.t = c.t
  where c.opens)"""


def _processes(spark, sf_dir):
    n = F.col("event_id")
    rows = _events(spark, sf_dir).select(
        n.alias("position"), (n % 3).alias("terminal"), (F.col("user_id") % 12).alias("pid"), (F.col("k") % 13).alias("parent_pid"),
        F.floor(epoch_us(F.col("ts")) / 3_600_000_000).cast("long").alias("at"),
        F.col("event_type").isin("signup", "purchase").alias("starts"), (F.col("event_type") == "error").alias("ends"),
        F.when(n % 2 == 0, 0).otherwise(n).alias("sequence"),
    )
    return lineage.lineage(rows, ["terminal"], "pid", "parent_pid", "at", "sequence", "position")


@query(_PROCESSES + """
select terminal, pid, process, first_seen, last_seen, rows, case when outcome = 'parent' then open end as parent, outcome
from spans join parents using (terminal, pid, process)""")
def process_parents(spark, sf_dir):
    """Instances of reused process ids with the instance that was open when each began, or why there is none."""
    return _processes(spark, sf_dir)[0]


@query(_PROCESSES + " select position, process from i")
def process_rows(spark, sf_dir):
    """Which instance each record belongs to; ambiguous ends to none."""
    return _processes(spark, sf_dir)[1]
