"""Queries with time: as-of, band, interval and phased joins, sessions, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch_s, epoch_us
from ..operators import aggregates, detect, joins, windows
from .registry import query, table


def _events(spark, sf_dir, kind: str | None = None, prefix: str = "") -> DataFrame:
    rows = table(spark, sf_dir, "events")
    rows = rows.where(F.col("event_type") == kind) if kind else rows
    rows = rows.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.select("user_id", *(F.col(c).alias(prefix + c) for c in ("event_id", "ts", "event_type", "value", "k")))


@query("""
with l as (select * from events where event_type = 'purchase'), r as (select * from events where event_type = 'signup')
select l.event_id as run_id, r.event_id as registration_id
from l join r on l.user_id = r.user_id and r.ts <= l.ts
where r.ts = (select max(x.ts) from r x where x.user_id = l.user_id and x.ts <= l.ts)""")
def asof_registrations(spark, sf_dir):
    """Each run with the latest registrations not after it, ties kept."""
    runs = _events(spark, sf_dir, "purchase").select("user_id", F.col("event_id").alias("run_id"), F.col("ts").alias("run_ts"))
    made = _events(spark, sf_dir, "signup").select("user_id", F.col("event_id").alias("registration_id"), F.col("ts").alias("made_ts"))
    return joins.asof_latest(runs, made, ["user_id"], "run_ts", "made_ts").select("run_id", "registration_id")


@query("""
with l as (select event_id, user_id, ts from events where event_type = 'click'),
r as (select user_id, ts, event_id, (event_id % 2) as v from events where event_type = 'signup'),
b as (select l.event_id, arg_max(r.v, (r.ts, r.v)) as v from l join r on r.user_id = l.user_id and r.ts <= l.ts group by 1),
a as (select l.event_id, arg_min(r.v, (r.ts, r.v)) as v from l join r on r.user_id = l.user_id and r.ts >= l.ts group by 1)
select event_id, coalesce(b.v, a.v) as sid from l left join b using (event_id) left join a using (event_id)
where coalesce(b.v, a.v) is not null and (b.v is null or a.v is null or a.v = b.v)""")
def asof_identities(spark, sf_dir):
    """A name's identity at a time, where the records before and after agree."""
    uses = _events(spark, sf_dir, "click").select("user_id", "event_id", "ts")
    known = _events(spark, sf_dir, "signup").select("user_id", F.col("ts").alias("at"), (F.col("event_id") % 2).alias("sid"))
    return joins.asof_agreeing(uses, known, ["user_id"], "ts", "at", "sid").select("event_id", "sid")


@query("""
select a.event_id as logon_id, b.event_id as connection_id from events a join events b
on a.user_id = b.user_id and a.event_type = 'purchase' and b.event_type = 'error'
and abs(epoch_us(a.ts) // 1000000 - epoch_us(b.ts) // 1000000) <= 7200""")
def connection_logons(spark, sf_dir):
    """Records of one user within a band of whole seconds."""
    a = _events(spark, sf_dir, "purchase").select("user_id", F.col("event_id").alias("logon_id"), F.col("ts").alias("a_ts"))
    b = _events(spark, sf_dir, "error").select("user_id", F.col("event_id").alias("connection_id"), F.col("ts").alias("b_ts"))
    pairs = joins.band_join(a, b, ["user_id"], epoch_s(F.col("a_ts")), epoch_s(F.col("b_ts")), 7200)
    return pairs.select("logon_id", "connection_id")


_ASSIGNED = """
with a as (select user_id, epoch_us(ts) // 1000000 as start_s, epoch_us(ts) // 1000000 + 86400 * (1 + event_id % 5) as end_s, event_id % 4 as terminal
           from events where event_type = 'signup'),
p as (select event_id, user_id, case when event_id % 40 = 0 then null else epoch_us(ts) // 1000000 end as at from events where event_type = 'error'),
h as (select p.event_id, count(distinct a.terminal) as n, min(a.terminal) as t from p join a on a.user_id = p.user_id and p.at between a.start_s and a.end_s group by 1)
select p.event_id, case when not exists (select 1 from a where a.user_id = p.user_id) then 'none' when p.at is null then 'not_comparable'
  when h.n is null then 'outside_range' when h.n = 1 then 'determined' else 'overlapping' end as outcome,
  case when h.n = 1 then h.t end as terminal
from p left join h using (event_id)"""


@query(_ASSIGNED)
def terminal_resolution(spark, sf_dir):
    """Where an address pointed to at a time, by assignments with validity."""
    made = _events(spark, sf_dir, "signup")
    start = epoch_s(F.col("ts"))
    assigned = made.select("user_id", start.alias("start_s"), (start + 86400 * (1 + F.col("event_id") % 5)).alias("end_s"), (F.col("event_id") % 4).alias("terminal"))
    points = _events(spark, sf_dir, "error").select("event_id", "user_id", F.when(F.col("event_id") % 40 != 0, epoch_s(F.col("ts"))).alias("at"))
    return joins.resolved(points, assigned, ["user_id"], "event_id", "at", "start_s", "end_s", "terminal")


@query("""
with p as (select *, lag(event_type) over w as before, lag(event_id) over w as before_id from events
           where event_type in ('signup', 'purchase') window w as (partition by user_id order by ts, event_id))
select user_id, before_id as open_id, event_id as close_id from p where event_type = 'purchase' and before = 'signup'""")
def phased_connections(spark, sf_dir):
    """Each close with the latest open before it, every open used once."""
    return joins.phased_pairs(_events(spark, sf_dir), ["user_id"], "ts", "event_type", "event_id", "signup", "purchase")


@query("""
with e as (select *, count(*) filter (event_type = 'signup') over (partition by user_id order by ts range unbounded preceding) as epoch from events),
b as (select user_id, epoch, min(ts) as boot from e where event_type = 'signup' group by 1, 2),
s as (select user_id, epoch, min(ts) as started, max(ts) as last_op, min(ts) filter (event_type = 'purchase') as off, count(*) as operations
      from e where event_type <> 'signup' group by 1, 2)
select s.user_id, s.epoch, started, coalesce(off, boot, last_op + interval 24 hour) as ended,
  case when off is not null then 'logoff' when boot is not null then 'boot' else 'assumed' end as ending, operations
from s left join b on b.user_id = s.user_id and b.epoch = s.epoch + 1""")
def logon_sessions(spark, sf_dir):
    """Sessions between boots and how each ended."""
    return windows.sessions(_events(spark, sf_dir), ["user_id"], "ts", "event_type", "signup", "purchase")


_INSTANCES = """
with o as (select *, case when event_type = 'signup' or coalesce(lag(event_type) over w = 'purchase', false) then 1 else 0 end as opens
           from events window w as (partition by user_id order by ts, event_id)),
n as (select *, sum(opens) over (partition by user_id order by ts, event_id rows unbounded preceding) as instance from o),
i as (select user_id, cast(instance as bigint) as instance, min(ts) as first_seen, max(ts) as last_seen, bool_or(event_type = 'signup') as has_start,
      bool_or(event_type = 'purchase') as has_end, count(*) as n_records from n group by 1, 2)
"""


@query(_INSTANCES + "select * from i")
def process_instances(spark, sf_dir):
    """Observations of one key cut into instances at starts and after ends."""
    kind = F.col("event_type")
    return windows.instances(_events(spark, sf_dir), ["user_id"], "ts", "event_id", kind == "signup", kind == "purchase")


@query(_INSTANCES + """
, o2 as (select user_id, event_id, ts as from_ts, ts + interval 6 hour as to_ts from events where event_type = 'error')
select user_id, instance, event_id from i join o2 using (user_id) where first_seen <= to_ts and from_ts <= last_seen""")
def process_identity(spark, sf_dir):
    """Instances and other spans of one key that share a moment."""
    own = process_instances(spark, sf_dir)
    spans = _events(spark, sf_dir, "error").select(
        "user_id", "event_id", F.col("ts").alias("from_ts"), F.timestamp_add("HOUR", F.lit(6), F.col("ts")).alias("to_ts")
    )
    own = own.select("user_id", "instance", epoch_us(F.col("first_seen")).alias("a"), epoch_us(F.col("last_seen")).alias("b"))
    spans = spans.select("user_id", "event_id", epoch_us(F.col("from_ts")).alias("c"), epoch_us(F.col("to_ts")).alias("d"))
    pairs = joins.overlapping(own, spans, ["user_id"], ("a", "b"), ("c", "d"), 86_400_000_000)
    return pairs.select("user_id", "instance", "event_id")


@query("""
with c as (select event_id, user_id, ts from events where event_type = 'signup'),
w as (select event_id, user_id, ts from events where event_type = 'purchase'),
r as (select event_id, user_id, ts from events where event_type = 'view')
select w.event_id as write_id, r.event_id as read_id from w join r on w.user_id = r.user_id and w.ts <= r.ts
where not exists (select 1 from c where c.user_id = w.user_id and c.ts > w.ts and c.ts <= r.ts)""")
def visible_writes(spark, sf_dir):
    """Writes that a later read sees: no replacement of the content between."""
    w = _events(spark, sf_dir, "purchase").select("user_id", "ts", F.col("event_id").alias("write_id"))
    r = _events(spark, sf_dir, "view").select("user_id", "ts", F.col("event_id").alias("read_id"))
    c = _events(spark, sf_dir, "signup").select("user_id", "ts")
    return joins.visible_writes(w, r, c, ["user_id"], "ts", "write_id", "read_id")


@query("""
with c as (select user_id, ts from events where event_type = 'signup'),
e as (select user_id, ts, event_id, event_type from events where event_type in ('purchase', 'view'))
select e.user_id, c.ts as version_start, case event_type when 'view' then 'read' else 'write' end as kind, event_id as id, e.ts
from e asof left join c on c.user_id = e.user_id and c.ts <= e.ts""")
def content_versions(spark, sf_dir):
    """The version of a content that each write and read belongs to."""
    w = _events(spark, sf_dir, "purchase").select("user_id", "ts", F.col("event_id").alias("write_id"))
    r = _events(spark, sf_dir, "view").select("user_id", "ts", F.col("event_id").alias("read_id"))
    c = _events(spark, sf_dir, "signup").select("user_id", "ts")
    return joins.content_versions(w, r, c, ["user_id"], "ts", "write_id", "read_id")


@query("""
with o as (select event_id as oid, user_id as u, cast(json_extract_string(props, '$.k') as bigint) % 3 as c, ts from events where event_type = 'error'),
p as (select event_id as pid, user_id as u, cast(json_extract_string(props, '$.k') as bigint) % 3 as c, ts,
      cast(json_extract_string(props, '$.k') as bigint) % 4 as process, event_id % 2 as content from events where event_type = 'click'),
s1 as (select u, c, count(*) as m, count(distinct process) as np from p group by 1, 2),
n as (select oid, pid, process, content from o join p using (u, c) where abs(epoch_us(o.ts) // 1000000 - epoch_us(p.ts) // 1000000) <= 21600),
g as (select oid, content, count(*) as size from n group by 1, 2),
s2 as (select oid, count(*) as m, count(distinct process) as np from n group by 1),
al as (select oid, count(*) filter (size >= 2) as alike from g group by 1)
select oid, coalesce(s1.m, 0) as stage1_members, coalesce(s1.np, 0) as stage1_processes, coalesce(s2.m, 0) as stage2_members,
  coalesce(s2.np, 0) as stage2_processes, coalesce(alike, 0) as n_alike,
  case when coalesce(s1.m, 0) = 0 then 'no_equal_candidate' when coalesce(s2.m, 0) = 0 then 'none_in_window'
       when s2.np = 1 then 'one_process' else 'several_processes' end as outcome
from o left join s1 using (u, c) left join s2 using (oid) left join al using (oid)""")
def staged_matching(spark, sf_dir):
    """Two stages of cross-source matching with their counts and outcome."""
    o = _events(spark, sf_dir, "error").select(F.col("event_id").alias("oid"), F.col("user_id").alias("u"), (F.col("k") % 3).alias("c"), F.col("ts").alias("o_ts"))
    p = _events(spark, sf_dir, "click").select(
        F.col("event_id").alias("pid"), F.col("user_id").alias("u"), (F.col("k") % 3).alias("c"), F.col("ts").alias("p_ts"),
        (F.col("k") % 4).alias("process"), (F.col("event_id") % 2).alias("content"),
    )
    return joins.staged_matches(o, p, ["u", "c"], "oid", "pid", "process", epoch_s(F.col("o_ts")), epoch_s(F.col("p_ts")), 21600, ["content"])


@query("""
with g as (select event_type, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by event_type order by ts) as gap from events),
s as (select event_type, list_sort(list(gap)) as l from g where gap is not null group by 1)
select event_type, len(l) as gaps, l[1] as least, l[(len(l) - 1) // 4 + 1] as lower, l[2 * (len(l) - 1) // 4 + 1] as middle,
       l[3 * (len(l) - 1) // 4 + 1] as upper, l[len(l)] as most from s""")
def event_intervals(spark, sf_dir):
    """Gaps between consecutive records: extremes and quartiles."""
    ms = F.floor(epoch_us(F.col("ts")) / 1000).cast("long")
    return aggregates.interval_summary(table(spark, sf_dir, "events"), ["event_type"], ms)


@query("""
with t as (select event_type, epoch_us(ts) // 1000 as ms from events), s as (select min(ms) as lo, max(ms) as hi from t),
g as (select *, cast(ceil(((hi - lo + 1) / 39.0)) as bigint) as raw from s),
g2 as (select *, case when raw >= 1000 then cast(ceil(raw / 1000.0) as bigint) * 1000 else raw end as step from g),
g3 as (select *, lo - lo % step as start from g2),
c as (select event_type, unnest(range(0, 40)) as col from (select distinct event_type from t)),
n as (select event_type, (ms - start) // step as col, count(*) as n from t, g3 group by 1, 2)
select c.event_type, start + c.col * step as column_start, coalesce(n, 0) as records from c cross join g3 left join n using (event_type, col)""")
def time_histogram(spark, sf_dir):
    """Records of each kind over a grid of forty columns, empty ones included."""
    ms = F.floor(epoch_us(F.col("ts")) / 1000).cast("long")
    return aggregates.time_histogram(table(spark, sf_dir, "events"), "event_type", ms, 40)


@query("""
select event_type, case when min(ts) <= timestamp '2024-01-02' and max(ts) >= timestamp '2024-01-20' then 'covered'
  when max(ts) < timestamp '2024-01-02' or min(ts) > timestamp '2024-01-20' then 'outside' else 'partial' end as coverage
from events group by 1""")
def source_coverage(spark, sf_dir):
    """How each source's records cover a requested period."""
    low, high = (F.expr(f"TIMESTAMP_NTZ'2024-01-{d} 00:00:00'") for d in ("02", "20"))
    return aggregates.coverage(table(spark, sf_dir, "events"), "event_type", "ts", low, high)


@query("""
with d as (select o_custkey, o_orderkey, count(*) as n from orders group by 1, 2),
g as (select *, coalesce(o_orderkey - lag(o_orderkey) over (partition by o_custkey order by o_orderkey) - 1, 0) as gap from d)
select o_custkey, sum(n) as records, min(o_orderkey) as lowest, max(o_orderkey) as highest, sum(gap) as missing,
       count(*) filter (gap > 0) as gaps, sum(n - 1) as duplicates from g group by 1""")
def record_numbers(spark, sf_dir):
    """Gaps and duplicates in each stream's record numbers."""
    return windows.number_gaps(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("""
with o as (select user_id, ts >= lag(ts) over w as up, ts <= lag(ts) over w as down from events window w as (partition by user_id order by event_id))
select user_id, case when coalesce(bool_and(up), true) then 'ascending' when coalesce(bool_and(down), true) then 'descending' else 'unordered' end as time_order
from o group by 1""")
def source_order(spark, sf_dir):
    """Whether a source's times follow its positions."""
    return windows.source_order(table(spark, sf_dir, "events"), "user_id", "event_id", "ts")


@query("""
with v as (select o_custkey, o_orderpriority, count(*) as c from orders group by 1, 2)
select o_custkey, o_orderpriority, cast(c as double) as rounded, rank() over (partition by o_orderpriority order by c desc) as place,
       count(*) over (partition by o_orderpriority, c) as ties from v""")
def investigation_order(spark, sf_dir):
    """Nodes ranked within their kind, equal values on one place."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("c"))
    out = windows.ranked(counts, "o_orderpriority", "c")
    return out.select("o_custkey", "o_orderpriority", "rounded", "place", "ties")


@query("""
select b.event_id from events a join events b on a.event_id = 100 and a.event_type = b.event_type
and abs(epoch_us(a.ts) // 1000000 - epoch_us(b.ts) // 1000000) <= 3600""")
def record_context(spark, sf_dir):
    """Records around one record, on its own terminal."""
    rows = table(spark, sf_dir, "events")
    return windows.context(rows, ["event_type"], epoch_s(F.col("ts")), 3600, "event_id", 100).select("event_id")


@query("""
select a.user_id, a.event_id as first, b.event_id as second, c.event_id as third
from events a join events b on a.user_id = b.user_id and a.event_type = 'signup' and b.event_type = 'view'
  and epoch_us(b.ts) // 1000000 - epoch_us(a.ts) // 1000000 between 0 and 86400
join events c on c.user_id = a.user_id and c.event_type in ('purchase', 'view') and c.event_id <> b.event_id and c.event_id <> a.event_id
  and epoch_us(c.ts) // 1000000 - epoch_us(b.ts) // 1000000 between 0 and 86400""")
def ordered_pattern(spark, sf_dir):
    """Three edges of one user in order, each within a day of the one before."""
    kind = F.col("event_type")
    roles = [("first", kind == "signup"), ("second", kind == "view"), ("third", kind.isin("purchase", "view"))]
    return detect.ordered_pattern(table(spark, sf_dir, "events"), roles, ["user_id"], epoch_s(F.col("ts")), "event_id", 86400)
