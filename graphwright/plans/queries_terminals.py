"""Queries over terminals and imports: profiles, leases, facts, folders of files.

Registry values are made of orders: a customer is a terminal, an order is a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch_s
from ..operators import joins, profiles
from ..plans.storage import shared_folder
from ..sources import imports
from .registry import query, table

_K = "cast(json_extract_string(props, '$.k') as bigint)"


def _values(spark, sf_dir) -> DataFrame:
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    kind, text = n % 8, lambda x: x.cast("string")
    rows = table(spark, sf_dir, "orders").select(c.alias("terminal"), n.alias("record"), kind.alias("kind"), (c % 3 + 1).alias("set"), epoch_s(F.col("o_orderdate")).alias("at"))
    record = F.col("record")
    own_set = F.concat(F.lit("\\ControlSet00"), text(F.col("record") % 3 + 1))
    path = (
        F.when(F.col("kind") == 0, F.lit("\\Select"))
        .when(F.col("kind") == 1, F.lit("\\Microsoft\\Windows NT\\CURRENTVERSION"))
        .when(F.col("kind") == 2, F.concat(own_set, F.lit("\\Control\\TimeZoneInformation")))
        .otherwise(F.concat(own_set, F.lit("\\Services\\Tcpip\\Parameters\\Interfaces\\{"), text(F.col("kind")), F.lit("}")))
    )
    current = F.when(record % 40 == 8, F.lit("4 (0x4)")).otherwise(F.concat(text(F.col("set")), F.lit(" (0x0)")))

    def value(name: str, what):
        return F.struct(F.lit(name).alias("name"), what.alias("value"))

    given = (
        F.when(F.col("kind") == 0, F.array(value("Current", current)))
        .when(F.col("kind") == 1, F.array(
            value("ProductName", F.concat(F.lit("System "), text(record % 4))), value("UBR", F.concat(text(record % 900), F.lit(" (0x0)"))),
            value("CurrentBuild", F.when(record % 3 == 0, F.lit("")).otherwise(text(record % 5000))), value("Other", F.lit("x")),
        ))
        .when(F.col("kind") == 2, F.array(value("Bias", text(record % 720)), value("TimeZoneKeyName", F.lit("Zone"))))
        .otherwise(F.array(
            value("DhcpIPAddress", F.when(record % 5 == 0, F.lit("0.0.0.0")).otherwise(F.concat(F.lit("10.1.2."), text(record % 50), F.lit(" 10.1.3."), text(record % 20)))),
            value("LeaseObtainedTime", F.when(record % 7 == 0, F.lit("0 (0x0)")).otherwise(F.concat(text(F.col("at")), F.lit(" (0x0)")))),
        ))
    )
    return rows.select("terminal", "record", path.alias("path"), F.explode(given).alias("v")).select("terminal", "record", "path", "v.*")


_VALUES = r"""
o as (select o_custkey as terminal, o_orderkey as record, o_orderkey % 8 as kind, o_orderkey % 3 + 1 as own_set, epoch_us(o_orderdate) // 1000000 as t from orders),
cur as (
  select terminal, min(c) as current from (select terminal, case when record % 40 = 8 then 4 else terminal % 3 + 1 end as c from o where kind = 0)
  group by terminal having count(distinct c) = 1),
pv as (
  select terminal, 'operating_system' as part, null as interface, record, name, value from o, lateral (values
    ('ProductName', 'System ' || record % 4), ('UBR', record % 900 || ' (0x0)'), ('CurrentBuild', case when record % 3 = 0 then '' else cast(record % 5000 as varchar) end)) v(name, value)
  where kind = 1 and value <> ''
  union all
  select terminal, 'time_zone', null, record, name, value from o join cur using (terminal), lateral (values ('Bias', cast(record % 720 as varchar)), ('TimeZoneKeyName', 'Zone')) v(name, value)
  where kind = 2 and own_set = current
  union all
  select terminal, 'address', '{' || kind || '}', record, name, value from o join cur using (terminal), lateral (values
    ('DhcpIPAddress', case when record % 5 = 0 then '0.0.0.0' else '10.1.2.' || record % 50 || ' 10.1.3.' || record % 20 end),
    ('LeaseObtainedTime', case when record % 7 = 0 then '0 (0x0)' else t || ' (0x0)' end)) v(name, value)
  where kind > 2 and own_set = current),
lst as (select terminal, max(t) as last from o group by terminal),
ad as (
  select p.terminal, interface, p.record, name, unnest(string_split(value, ' ')) as ip,
         case when p.record % 7 <> 0 then o.t end as lease_from, case when p.record % 7 <> 0 then last end as lease_to
  from pv p join o on o.record = p.record join lst on lst.terminal = p.terminal where name = 'DhcpIPAddress' and value <> '0.0.0.0')"""


def _last(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("terminal"), epoch_s(F.col("o_orderdate")).alias("at"))
    return orders.groupBy("terminal").agg(F.max("at").alias("last"))


@query(f"with {_VALUES} select * from pv")
def terminal_profiles(spark, sf_dir):
    """The values that describe a terminal: its system, and time zone and interfaces of the current control set."""
    return profiles.profile_values(_values(spark, sf_dir))


@query(f"with {_VALUES} select * from ad")
def terminal_leases(spark, sf_dir):
    """The addresses of a terminal's interfaces with the times of their leases."""
    return profiles.leases(_values(spark, sf_dir), _last(spark, sf_dir))


@query(f"with {_VALUES} select terminal, ip, count(distinct record) as records, min(lease_from) as lease_from, max(lease_to) as lease_to from ad group by 1, 2")
def terminal_addresses(spark, sf_dir):
    """One edge for each address of a terminal."""
    return profiles.address_edges(profiles.leases(_values(spark, sf_dir), _last(spark, sf_dir)))


@query(f"""
with {_VALUES},
c as (select o_orderkey as point, '10.1.2.' || o_orderkey % 60 as ip, epoch_us(o_orderdate) // 1000000 as t from orders where o_orderkey % 4 = 0),
g as (select ip, lease_from, lease_to, terminal from ad where lease_from is not null),
h as (select point, count(distinct terminal) as n, min(terminal) as terminal from c join g on g.ip = c.ip and c.t between lease_from and lease_to group by point)
select c.point, case when c.ip not in (select ip from g) then 'none' when n is null then 'outside_range' when n = 1 then 'determined' else 'overlapping' end as outcome,
       case when n = 1 then h.terminal end as terminal
from c left join h using (point)""")
def leased_terminals(spark, sf_dir):
    """Which terminal held an address at a time, by the leases of profiles."""
    held = profiles.leases(_values(spark, sf_dir), _last(spark, sf_dir)).where("lease_from is not null")
    points = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(
        F.col("o_orderkey").alias("point"), F.concat(F.lit("10.1.2."), (F.col("o_orderkey") % 60).cast("string")).alias("ip"), epoch_s(F.col("o_orderdate")).alias("at")
    )
    return joins.resolved(points, held.select("ip", "lease_from", "lease_to", "terminal"), ["ip"], "point", "at", "lease_from", "lease_to", "terminal")


def _facts(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("terminal"))
    sorts = F.when(F.col("l_returnflag") == "R", F.array(F.lit("remote_logon"))).otherwise(F.array().cast("array<string>"))
    record = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return lines.join(orders, "l_orderkey").select("terminal", record.alias("record"), sorts.alias("categories"), "l_partkey", "l_suppkey")


@query(f"""
with {_VALUES},
v as (select terminal, name, arg_min(value, record) as value from pv where part = 'operating_system' group by all),
s as (
  select terminal, max(case when name = 'ProductName' then value end) as p, max(case when name = 'CurrentBuild' then value end) as b,
         max(case when name = 'UBR' then string_split(value, ' ')[1] end) as u from v group by terminal),
f as (
  select o_custkey as terminal, count(*) as records, count(*) filter (where l_returnflag = 'R') as categorized
  from lineitem join orders on o_orderkey = l_orderkey group by 1),
t as (select distinct terminal, true as profile from o)
select coalesce(t.terminal, f.terminal) as terminal, coalesce(concat_ws(' ', p, case when b is not null then concat_ws('.', b, u) end), '') as operating_system,
       coalesce(records, 0) as records, coalesce(categorized, 0) as categorized
from t full join f on f.terminal = t.terminal left join s on s.terminal = t.terminal where profile or categorized > 0""")
def terminal_summaries(spark, sf_dir):
    """Terminals with their system and how many of their records are classified."""
    return profiles.summaries(_values(spark, sf_dir), _facts(spark, sf_dir).select("terminal", "record", "categories"))


@query("""
with l as (select o_custkey as terminal, l_orderkey * 10 + l_linenumber as record, l_partkey, l_suppkey, l_returnflag from lineitem join orders on o_orderkey = l_orderkey),
f as (select distinct terminal, record from l where l_returnflag = 'R')
select terminal, record, 'process' || l_partkey % 500 as node from f join l using (terminal, record)
union select terminal, record, 'file' || l_suppkey from f join l using (terminal, record) where l_suppkey % 2 = 0""")
def terminal_fact_nodes(spark, sf_dir):
    """The nodes that the classified records of a terminal name."""
    rows = _facts(spark, sf_dir)
    n = F.col("l_suppkey")
    kind = F.when(n % 2 == 0, "file").otherwise("terminal")
    nodes = rows.select(F.concat(F.lit("process"), (F.col("l_partkey") % 500).cast("string")).alias("node"), F.lit("process").alias("kind"), "record").union(
        rows.select(F.concat(kind, n.cast("string")), kind, "record")
    )
    return profiles.fact_nodes(rows.select("terminal", "record", "categories"), nodes)


def _folder(spark, sf_dir) -> str:
    """A folder of logs made of events: access and error logs, endpoint and audit lines, notes and files of spaces."""
    n, at = F.col("event_id"), F.col("ts")
    broken = n % 13 == 5
    stamp = F.date_format(at, "dd/MMM/yyyy:HH:mm:ss")
    access = F.format_string('10.0.0.%d - u%d [%s +0000] "GET /a/%d HTTP/1.1" 200 %d', n % 250, F.col("user_id"), stamp, n, n % 9999)
    error = F.format_string("[%s] [core:error] [pid 7] broke %d", F.date_format(at, "EEE MMM dd HH:mm:ss.SSSSSS yyyy"), n)
    endpoint = F.format_string("%s +0000 sn=%d evt=x", F.date_format(at, "MM/dd/yyyy HH:mm:ss.SSS"), n)
    audit = F.format_string("type=SYSCALL msg=audit(%d.123:%d): syscall=59", epoch_s(at), n)
    note = F.concat(F.lit("a note of "), F.col("event_type"))
    kind = F.element_at(F.array(*map(F.lit, ("access", "error", "endpoint", "audit", "note"))), (n % 5 + 1).cast("int"))
    line = F.element_at(F.array(access, error, endpoint, audit, note), (n % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        kind.alias("kind"), (n % 4).alias("part"), F.when(broken | (F.col("user_id") % 150 == 3), F.lit("not a record")).otherwise(line).alias("line"), n.alias("n")
    )
    folder = shared_folder(spark, "logs")
    rows.repartition("kind", "part").sortWithinPartitions("kind", "part", "n").select("kind", "part", "line").write.partitionBy("kind", "part").text(folder)
    return folder


@query("""
with r as (
  select ['access', 'error', 'endpoint', 'audit', 'note'][event_id % 5 + 1] as kind, event_id % 4 as part,
         event_id % 13 = 5 or user_id % 150 = 3 as bad from events)
select kind || '/' || part as source, case when kind <> 'note' then kind end as format,
       case when kind = 'note' then 'skipped' when bool_and(bad) then 'withheld' when bool_or(bad) then 'published_partial' else 'published_full' end as state,
       case when kind = 'note' then 0 else count(*) end as read, case when kind = 'note' then 0 else count(*) filter (where not bad) end as succeeded,
       case when kind = 'note' then 0 else count(*) filter (where bad) end as failed,
       case when kind = 'note' then 'unsupported_format' end as reason
from r group by kind, part""")
def imported_folder(spark, sf_dir):
    """A folder of logs, each file read by the format that its head shows, with what came of it."""
    status, _ = imports.imported(spark, _folder(spark, sf_dir), imports.registry(imports.FORMATS))
    own = status.where(~F.col("source").rlike(r"/[_.][^/]*$"))
    name = F.concat_ws("/", F.regexp_extract("source", "kind=([a-z]+)/", 1), F.regexp_extract("source", r"part=(\d+)/", 1))
    return own.withColumn("source", name)
