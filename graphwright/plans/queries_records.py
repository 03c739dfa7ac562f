"""Queries over single records: filters, search, scalar functions, rules, readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import network, search, times, values
from ..operators import aggregates, detect
from ..sources import lines
from .registry import query, table


def event_columns() -> dict[str, tuple[Column, str]]:
    """The fields of an event: columns by name."""
    return {
        "event.type": (F.col("event_type"), "string"),
        "event.user": (F.col("user_id"), "bigint"),
        "props.k": (F.get_json_object("props", "$.k"), "string"),
    }


def event_fields() -> Column:
    """The fields of an event as array<struct<name, value>>."""
    return F.array(
        *(F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, (c, _) in event_columns().items())
    )


@query("""
select event_id, event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events
where event_type in ('click', 'error') and try_cast(json_extract_string(props, '$.k') as bigint) between 10 and 60
  and epoch_us(ts) // 1000000 between epoch_us(timestamp '2024-01-01 06:00:00') // 1000000
                                  and epoch_us(timestamp '2024-01-20 18:30:00') // 1000000""")
def record_filter(spark, sf_dir):
    """Category, numeric action range and an inclusive period in whole seconds."""
    k = F.get_json_object("props", "$.k")
    number = F.when(k.rlike("^[0-9]+$"), k.cast("decimal(20,0)")).cast("long")
    period = times.in_period(
        F.col("ts"), *(F.expr(f"TIMESTAMP_NTZ'{t}'") for t in ("2024-01-01 06:00:00", "2024-01-20 18:30:00"))
    )
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("click", "error") & number.between(10, 60) & period)
        .select("event_id", "event_type", number.alias("k"))
    )


@query("""
select event_id from events
where (event_type like '%r%' or cast(json_extract_string(props, '$.k') as bigint) >= 90)
  and event_type <> 'purchase' and user_id <> 12""")
def search_expression(spark, sf_dir):
    """Search terms over the columns of a record."""

    def term(*of: str) -> Column:
        return search.term(event_columns(), *of)

    wanted = (term("type", "contains", "r") | term("k", ">=", "90")) & ~term("type", "==", "purchase") & term("event.user", "!=", "12")
    return table(spark, sf_dir, "events").where(wanted).select("event_id")


@query("""
select event_id from events
where (event_type like '%r%' or cast(json_extract_string(props, '$.k') as bigint) >= 90) and user_id <> 12 and
  (contains(event_type, '7') or contains(cast(user_id as varchar), '7') or contains(json_extract_string(props, '$.k'), '7'))""")
def search_own_fields(spark, sf_dir):
    """Search terms over fields that each record has of its own."""
    fields = event_fields()

    def term(*of: str) -> Column:
        return search.compare(fields, *of)

    wanted = (term("type", "contains", "r") | term("k", ">=", "90")) & term("event.user", "!=", "12") & search.mentions(fields, "7")
    return table(spark, sf_dir, "events").where(wanted).select("event_id")


@query("""
select l_orderkey, l_linenumber from lineitem where l_extendedprice > 50000.5 and l_discount <= 0.03""")
def search_decimals(spark, sf_dir):
    """Order of decimals on numeric columns; the filters reach the scan."""
    lines = table(spark, sf_dir, "lineitem")
    fields = search.named_fields(lines, l_extendedprice="line.price", l_discount="line.discount")
    wanted = search.term(fields, "price", ">", "50000.5") & search.term(fields, "discount", "<=", "0.03")
    return lines.where(wanted).select("l_orderkey", "l_linenumber")


@query("""
select l_orderkey, l_linenumber from lineitem where l_extendedprice > 50000.5 and l_discount <= 0.03""")
def search_decimal_texts(spark, sf_dir):
    """Order of decimals as text, of any number of digits."""
    fields = {
        n: (F.concat(F.lit("0" * 40), F.col(c).cast("decimal(20,4)").cast("string")), "string")
        for n, c in (("price", "l_extendedprice"), ("discount", "l_discount"))
    }
    wanted = search.term(fields, "price", ">", "50000.5") & search.term(fields, "discount", "<=", "0.03")
    return table(spark, sf_dir, "lineitem").where(wanted).select("l_orderkey", "l_linenumber")


_IP = "concat_ws('.', {p} % 3 * 63 + 1, {p} % 250, {p} % 7, {p} % 256)"


@query("""
with a as (select p_partkey, p_partkey % 3 * 63 + 1 as b0, p_partkey % 250 as b1, p_partkey % 7 as b2,
                  p_partkey % 256 as b3 from part)
select p_partkey, b0 = 64 and b1 between 64 and 127 as inside,
       not (b0 = 127) as reaches from a""")
def address_match(spark, sf_dir):
    """Addresses in a block and those that can be another terminal's."""
    ip = F.expr(_IP.format(p="p_partkey"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", network.in_cidr(ip, "64.64.0.0/10").alias("inside"), network.reaches_another(ip).alias("reaches")
    )


@query("""
select o_orderkey, sha256(unhex(lpad(to_hex(strlen(o_orderstatus)), 16, '0')) || encode(o_orderstatus)
  || unhex(lpad(to_hex(strlen(o_orderpriority)), 16, '0')) || encode(o_orderpriority)) as node_id from orders""")
def identity_digests(spark, sf_dir):
    """Node identities: a digest of length-prefixed parts."""
    node = values.identity_digest(F.col("o_orderstatus"), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", node.alias("node_id"))


@query("""
select o_orderkey, '0x' || lower(to_hex(o_orderkey)) as logon, cast(o_orderkey as varchar) as pid,
       lower('C:\\Users\\' || o_orderpriority) as path, o_orderpriority as base, 'host' || o_custkey as host
from orders""".replace("\\\\", "\\"))
def normalised_values(spark, sf_dir):
    """Logon ids, process ids, paths and host names in their normal forms."""
    padded = F.concat(F.lit("0x00"), F.hex("o_orderkey"))
    path = F.concat(F.lit("C:\\Users\\"), F.col("o_orderpriority"))
    host = F.concat(F.lit("HOST"), F.col("o_custkey").cast("string"), F.lit(".Example.org"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        values.logon_id(padded).alias("logon"),
        values.decimal_of_hex(padded).alias("pid"),
        values.path_key(path).alias("path"),
        values.basename(path).alias("base"),
        values.short_hostname(host).alias("host"),
    )


@query("""
select c_custkey, case when c_custkey % 3 = 0 then 'S-1-5-21-7-' || c_custkey
  else lower('DOM' || c_nationkey || '\\' || c_name) end as account, c_custkey % 3 = 1 as machine from customer""".replace("\\\\", "\\"))
def account_keys(spark, sf_dir):
    """Accounts by SID or domain and name, and machine accounts in free text."""
    sid = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("S-1-5-21-7-"), F.col("c_custkey").cast("string")))
    name = F.concat(F.lit("DOM"), F.col("c_nationkey").cast("string"), F.lit("\\"), F.col("c_name"))
    end = F.when(F.col("c_custkey") % 3 == 1, F.lit("$")).otherwise(F.lit(""))
    text = F.concat(F.lit("logon by WS"), F.col("c_custkey").cast("string"), end, F.lit(" to ADMIN$"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        values.account_key(sid, F.lit(None).cast("string"), name).alias("account"),
        (F.size(values.machine_accounts(text)) > 0).alias("machine"),
    )


@query("""
select p_partkey, timestamp '1601-01-01' + to_microseconds(13350000000000000 + p_partkey * 1000) as at,
       'a\\x0ab' || p_partkey as shown, case when p_partkey % 2 = 0 then 'base64' else 'base64url' end as alphabet,
       p_partkey as number, 'tok' || p_size as token from part""".replace("\\\\", "\\"))
def decoded_values(spark, sf_dir):
    """File times, control characters, fragments of encoded bodies."""
    key = F.col("p_partkey")
    ticks = F.lit(133500000000000000) + key * 10000
    mark = F.when(key % 2 == 0, F.lit("ab+/")).otherwise(F.lit("ab-_"))
    path = F.concat(F.lit("/up/"), key.cast("string"), F.lit("/tok"), F.col("p_size").cast("string"))
    part = values.numbered_fragment(path)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        values.filetime(ticks).cast("timestamp_ntz").alias("at"),
        values.sanitized(F.concat(F.lit("a\nb"), key.cast("string"))).alias("shown"),
        values.fragment_alphabet(mark).alias("alphabet"),
        part["number"].alias("number"),
        part["token"].alias("token"),
    )


@query("""select p_partkey, 'run ' || p_brand as command from part""")
def encoded_commands(spark, sf_dir):
    """The text behind an encoded command line argument."""
    raw = F.base64(F.encode(F.concat(F.lit("run "), F.col("p_brand")), "UTF-16LE"))
    line = F.concat(F.lit("shell.exe -NoProfile -enc "), raw)
    return table(spark, sf_dir, "part").select("p_partkey", values.encoded_command(line).alias("command"))


RULES = [
    {"title": "large click", "level": "high", "detection": {"sel": {"event_type": "click", "k|re": "^9[0-9]$"}, "condition": "sel"}},
    {"title": "not a view", "level": "low", "detection": {"a": {"event_type|startswith": "V"}, "b": {"event_type": ["sign*", "pur?hase"]}, "condition": "not a and b"}},
    {"title": "any of two", "level": "medium", "detection": {"s_one": [{"event_type": "error"}, {"k": "7"}], "s_two": {"k|endswith": ["3", "4"], "event_type|contains|all": ["c", "k"]}, "_no": {"k": "1"}, "condition": "1 of s_*"}},
    {"title": "unknown field", "level": "low", "detection": {"a": {"nothing": "x"}, "condition": "a"}},
]
_HITS = """
with r as (select *, json_extract_string(props, '$.k') as k from events),
h as (
  select event_id, 'large click' as rule, 'high' as level from r where event_type = 'click' and regexp_full_match(k, '9[0-9]')
  union all select event_id, 'not a view', 'low' from r where event_type not like 'v%' and (event_type like 'sign%' or event_type = 'purchase')
  union all select event_id, 'any of two', 'medium' from r
    where event_type = 'error' or k = '7' or ((k like '%3' or k like '%4') and event_type like '%c%' and event_type like '%k%'))
"""


def _rule_hits(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return detect.hits(events, RULES, ["event_id", "user_id"])[0]


@query(_HITS + "select event_id, rule, level from h")
def rule_matches(spark, sf_dir):
    """Every record with every rule it matches, in one pass."""
    return _rule_hits(spark, sf_dir).select("event_id", "rule", "level")


@query(_HITS + """
select rule, level, count(*) as records from h group by rule, level""")
def rule_counts(spark, sf_dir):
    return _rule_hits(spark, sf_dir).groupBy("rule", "level").agg(F.count("*").alias("records"))


def _access_lines(spark, sf_dir) -> DataFrame:
    line = F.format_string(
        '10.0.%d.%d - user%d [%s +0200] "GET http://h%d.example.org%s HTTP/1.1" %d %d "-" "agent \\"x\\"" TCP_MISS:HIER_DIRECT',
        (F.col("o_custkey") % 250).cast("int"), (F.col("o_custkey") % 256).cast("int"), F.col("o_custkey"),
        F.date_format("o_orderdate", "dd/MMM/yyyy:HH:mm:ss"),
        F.col("o_custkey") % 9, F.when(F.col("o_orderkey") % 2 == 0, F.lit(":8080/p")).otherwise(F.lit("/p")),
        F.lit(200), F.col("o_orderkey"),
    )
    line = F.when(F.col("o_orderkey") % 50 == 0, F.lit("broken")).otherwise(line)
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query("""
select o_orderkey, o_orderkey % 50 = 0 as failed,
  case when o_orderkey % 50 <> 0 then o_orderdate - interval 2 hour end as at,
  case when o_orderkey % 50 <> 0 then 'user' || o_custkey end as "user",
  case when o_orderkey % 50 <> 0 then 'h' || o_custkey % 9 || '.example.org' end as host,
  case when o_orderkey % 50 <> 0 then case when o_orderkey % 2 = 0 then 8080 else 80 end end as port,
  case when o_orderkey % 50 <> 0 then o_orderkey end as size,
  case when o_orderkey % 50 <> 0 then 'agent "x"' end as agent,
  case when o_orderkey % 50 <> 0 then 'TCP_MISS' end as result from orders""")
def access_log(spark, sf_dir):
    """Access and proxy log lines, their requests and failures."""
    rows = lines.access_records(_access_lines(spark, sf_dir))
    return rows.select("o_orderkey", "failed", F.col("instant").cast("timestamp_ntz").alias("at"), "user", "host", "port", "size", "agent", "result")


@query("""
select event_id, ts_ms as at, event_type as kind, case when event_id % 20 <> 0 then cast(user_id as varchar) end as usr,
       event_id % 20 = 0 as failed
from (select *, date_trunc('millisecond', ts) as ts_ms from events)""")
def endpoint_log(spark, sf_dir):
    """Endpoint log lines of key=value parts with required keys."""
    at = F.date_format(F.col("ts").cast("timestamp"), "MM/dd/yyyy HH:mm:ss.SSS")
    user = F.when(F.col("event_id") % 20 == 0, F.lit("")).otherwise(F.col("user_id").cast("string"))
    line = F.format_string('%s +0000 sn=%d evt=%s usr=%s note="a ""b"" c"', at, F.col("event_id"), F.col("event_type"), user)
    events = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    rows = lines.endpoint_records(events, ["sn", "evt", "usr"])
    usr = F.nullif(F.element_at("kv", "usr"), F.lit(""))
    return rows.select("event_id", F.col("instant").cast("timestamp_ntz").alias("at"), F.element_at("kv", "evt").alias("kind"), usr.alias("usr"), "failed")


@query("""
select event_type as category, cast(cast(json_extract_string(props, '$.k') as bigint) % 5 as varchar) as action,
       count(*) as records, event_type is not null as categorised
from events group by 1, 2, 4""")
def event_kinds(spark, sf_dir):
    """Records of each category and action."""
    action = (F.get_json_object("props", "$.k").cast("long") % 5).cast("string")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), action.alias("action"))
    return aggregates.event_kinds(events, "category", "action")


@query("""
select cast(user_id as varchar) as value, count(distinct event_id) as records, min(ts) as first_seen, max(ts) as last_seen
from events where event_type <> 'error' group by 1""")
def value_counts(spark, sf_dir):
    """Distinct records and range of each comparable value; unreadable ones are nothing."""
    state = F.when(F.col("event_type") == "error", F.lit("truncated")).otherwise(F.lit("present"))
    value = values.comparable(state, F.lit(None).cast("string"), F.col("user_id").cast("string"))
    return aggregates.value_counts(table(spark, sf_dir, "events"), value, "event_id", "ts")


@query("""
select user_id, count(*) filter (event_type = 'view') as proxy_requests, count(*) filter (event_type = 'click') as proxy_connections,
       count(*) filter (event_type = 'purchase') as direct_connections,
       count(distinct case when event_type = 'purchase' then json_extract_string(props, '$.k') end) as direct_targets
from events group by user_id""")
def proxy_bypass(spark, sf_dir):
    """Traffic of each client at, to and around the proxy."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    kind = F.col("event_type")
    return aggregates.bypass(events, "user_id", kind == "view", kind == "click", kind == "purchase", "k")


@query("""
with o as (select o_orderkey, case when o_orderstatus = 'F' then 'done' when o_orderstatus = 'O' then 'open' else 'other' end as outcome from orders),
k as (select unnest(['done', 'open', 'other', 'never']) as outcome)
select k.outcome, count(o.o_orderkey) as n from k left join o using (outcome) group by k.outcome""")
def outcome_counts(spark, sf_dir):
    """Counts of every outcome, zeros included."""
    s = F.col("o_orderstatus")
    outcome = F.when(s == "F", "done").when(s == "O", "open").otherwise("other")
    rows = table(spark, sf_dir, "orders").select(outcome.alias("outcome"))
    return aggregates.with_zeros(rows, "outcome", ["done", "open", "other", "never"])


@query("""
with t as (select l_suppkey as source, l_orderkey * 10 + l_linenumber % 2 as position from lineitem),
tw as (select distinct source from (select source from t group by source, position having count(*) > 1)),
dg as (select distinct s_suppkey as source from supplier where s_suppkey % 7 = 0)
select distinct t.source, case when tw.source is not null or dg.source is not null then 'withheld' else 'published' end as state
from t left join tw using (source) left join dg using (source)""")
def publication(spark, sf_dir):
    """Sources withheld for a position that comes twice or a dangling reference."""
    records = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") % 2).alias("position")
    )
    suppliers = table(spark, sf_dir, "supplier")
    references = suppliers.where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("source"), F.lit(-1).cast("long").alias("position"))
    return aggregates.withheld(records, "source", "position", references)


@query("""
select o_custkey as node, arg_min(o_orderpriority, o_orderkey) filter (o_orderkey % 3 = 0) as label,
       bool_or(o_orderstatus = 'F') as observed, count(*) as mentions from orders group by 1""")
def node_upsert(spark, sf_dir):
    """One node for each key: the first label in order of records, observed wins."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("node"),
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("label"),
        (F.col("o_orderstatus") == "F").alias("observed"),
    )
    return aggregates.upserted(rows, "node", ["o_orderkey"], "label", "observed")


@query("""
select event_id, ts from events where event_type = 'error' order by ts, event_id limit 50 offset 100""")
def timeline_page(spark, sf_dir):
    """A page of a timeline in its total order."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "ts")
    return aggregates.paged(rows, ["ts", "event_id"], 50, 2)
