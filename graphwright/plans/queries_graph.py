"""Queries over the derived graph: edges, summaries, traversal, reachability.

Edges: an order is placed by a customer, contains a part, and the part is
supplied by a supplier; records are order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import constraint, epoch_s
from ..operators import aggregates, graph, joins
from .registry import query, table


def _lines(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey").withColumn("record", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def evidence(spark, sf_dir) -> DataFrame:
    """(kind, src, dst, record, time) of all edges, in long form."""

    def node(kind: str, key: str):
        return F.concat(F.lit(kind), F.col(key).cast("string"))

    edges = F.array(
        F.struct(F.lit("placed").alias("kind"), node("c", "o_custkey").alias("src"), node("p", "l_partkey").alias("dst")),
        F.struct(F.lit("supplied").alias("kind"), node("s", "l_suppkey").alias("src"), node("p", "l_partkey").alias("dst")),
    )
    rows = _lines(spark, sf_dir).select(F.explode(edges).alias("e"), "record", F.col("l_shipdate").cast("timestamp_ntz").alias("time"))
    return rows.select("e.kind", "e.src", "e.dst", "record", "time")


_KINDS, _NODES = ("placed", "supplied"), ("c", "s", "p")


def numbered(spark, sf_dir) -> DataFrame:
    """The rows of ``evidence`` with numbers for kinds and nodes; those of a shuffle are half as wide. ``named`` names them."""

    def node(place: int, key: str):
        return F.col(key) * len(_NODES) + place

    edges = F.array(*(F.struct(F.lit(i).alias("kind"), node(i, key).alias("src")) for i, key in enumerate(("o_custkey", "l_suppkey"))))
    rows = _lines(spark, sf_dir).select(F.explode(edges).alias("e"), node(2, "l_partkey").alias("dst"), "record", F.col("l_shipdate").cast("timestamp_ntz").alias("time"))
    return rows.select("e.kind", "e.src", "dst", "record", "time")


def named(df: DataFrame) -> DataFrame:
    """df with the names of the kinds and nodes that it holds as numbers."""

    def of(names, place):
        return F.element_at(F.array(*map(F.lit, names)), (place + 1).cast("int"))

    n = len(_NODES)
    shown = {c: F.concat(of(_NODES, F.col(c) % n), F.floor(F.col(c) / n).cast("string")) for c in ("src", "dst", "node") if c in df.columns}
    if "kind" in df.columns:
        shown["kind"] = of(_KINDS, F.col("kind"))
    return df.withColumns(shown)


_EVIDENCE = """
with li as (select l.*, o_custkey, l_orderkey * 10 + l_linenumber as record from lineitem l join orders on o_orderkey = l_orderkey),
e as (select 'placed' as kind, 'c' || o_custkey as src, 'p' || l_partkey as dst, record, l_shipdate as time from li
      union all select 'supplied', 's' || l_suppkey, 'p' || l_partkey, record, l_shipdate from li)
"""


@query(_EVIDENCE + """
select kind, src, dst, count(distinct record) as records, min(time) as first_seen, max(time) as last_seen from e group by 1, 2, 3""")
def graph_edges(spark, sf_dir):
    """Edges by identity with their evidence and applicable range."""
    return named(aggregates.edge_summaries(numbered(spark, sf_dir)))


@query(_EVIDENCE + """
, w as (select src as node, kind, 'out' as direction, dst as other, record from e union all select dst, kind, 'in', src, record from e)
select node, kind, direction, count(distinct other) as n_edges, count(distinct record) as n_records from w group by 1, 2, 3""")
def node_edge_counts(spark, sf_dir):
    """Edges and evidence of each node by kind and direction."""
    return named(aggregates.edge_counts(numbered(spark, sf_dir)))


@query(_EVIDENCE + """
, n as (select src as node, record, time from e union select dst, record, time from e)
select node, count(*) as records, count(*) filter (time is null) as undated, min(time) as first_seen, max(time) as last_seen from n group by 1""")
def node_summaries(spark, sf_dir):
    """Records of each node over its own and its edges' evidence."""
    edges = evidence(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node"), "record", "time")
    return aggregates.node_summaries(nodes, edges, "time")


@query("""select min(p_partkey) over w as representative, p_partkey as member
from part window w as (partition by p_brand, p_type, p_size) qualify count(*) over w > 1""")
def content_matches(spark, sf_dir):
    """Classes of nodes with equal content."""
    return joins.equal_content(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])


@query("""
with r as (select o_orderkey * 0 + l_orderkey as record, o_custkey, l_suppkey, l_shipdate from lineitem join orders on o_orderkey = l_orderkey),
m as (select distinct record, 'c' || o_custkey as account, 'subject' as role from r union select distinct record, 's' || l_suppkey, 'target' from r),
t as (select record, min(l_shipdate) as time from r group by 1)
select a.account as a, b.account as b, a.role as a_role, b.role as b_role, count(distinct record) as records, min(time) as first_seen, max(time) as last_seen
from m a join m b using (record) join t using (record) where a.account <> b.account group by 1, 2, 3, 4""")
def account_relations(spark, sf_dir):
    """Accounts named together by a record, with their roles."""
    rows = _lines(spark, sf_dir)
    at = rows.groupBy(F.col("l_orderkey").alias("record")).agg(F.min("l_shipdate").cast("timestamp_ntz").alias("time"))
    named = F.array(
        F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("account"), F.lit("subject").alias("role")),
        F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("account"), F.lit("target").alias("role")),
    )
    roles = rows.select(F.col("l_orderkey").alias("record"), F.explode(named).alias("n")).select("record", "n.account", "n.role").distinct()
    return aggregates.relations(roles.join(at, "record"))


def _tree(spark, sf_dir) -> DataFrame:
    """Edges customer - nation - region."""
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst")
    )
    n = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst")
    )
    return c.union(n).withColumn("edge", F.concat_ws("-", "src", "dst"))


_TREE = """
with recursive t as (select 'c' || c_custkey as src, 'n' || c_nationkey as dst from customer
      union all select 'n' || n_nationkey, 'r' || n_regionkey from nation),
s as (select src, dst, src || '-' || dst as edge from t union all select dst, src, src || '-' || dst from t),
w(node, hops) as (select 'c1', 0 union select s.dst, hops + 1 from w join s on s.src = w.node where hops < {0})
"""


@query(_TREE.format(3) + "select node, cast(min(hops) as integer) as hops from w group by 1")
def reached_nodes(spark, sf_dir):
    """Nodes within three undirected hops."""
    origin = spark.range(1).select(F.lit("c1").alias("node"))
    return graph.reached(_tree(spark, sf_dir), origin, 3)


@query(_TREE.format(1) + "select distinct s.edge from s join w on s.src = w.node")
def reached_edges(spark, sf_dir):
    """Edges that a search of two hops meets."""
    origin = spark.range(1).select(F.lit("c1").alias("node"))
    return graph.reached_edges(_tree(spark, sf_dir), origin, 2).select("edge")


@query("""
with recursive p as (select 'n' || s_suppkey as a, 'n' || (s_suppkey // 3) as b from supplier),
l as (select a, b from p union select b, a from p),
w(name, other) as (select a, a from l union select w.name, l.b from w join l on l.a = w.other)
select name, min(other) as root from w group by 1""")
def rename_closure(spark, sf_dir):
    """Names of one machine over chains of renames."""
    key = F.col("s_suppkey")
    pairs = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("n"), key.cast("string")).alias("a"), F.concat(F.lit("n"), F.floor(key / 3).cast("string")).alias("b")
    )
    return graph.closure(pairs)


def contacts(spark, sf_dir) -> DataFrame:
    """Transfers between users: each purchase goes to the user of number k."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    at = epoch_s(F.col("ts"))
    return rows.select(
        F.col("event_id").alias("contact"), (F.col("user_id") % 50).alias("src"), (F.get_json_object("props", "$.k").cast("long") % 50).alias("dst"),
        at.alias("depart"), (at + 60).alias("arrive"),
    )


_CONTACTS = """
with recursive c as (select event_id as contact, user_id % 50 as src, cast(json_extract_string(props, '$.k') as bigint) % 50 as dst,
  epoch_us(ts) // 1000000 as depart, epoch_us(ts) // 1000000 + 60 as arrive from events where event_type = 'purchase'),
f(contact, node, tm) as (select contact, dst, arrive from c where src = 1 union select c.contact, c.dst, c.arrive from f join c on c.src = f.node and c.depart >= f.tm),
a as (select node, min(tm) as arrival from (select node, tm from f union all select 1, 0) group by 1)
"""


@query(_CONTACTS + "select node, arrival from a")
def earliest_arrivals(spark, sf_dir):
    """The earliest time each node can be influenced from one."""
    return graph.earliest_arrivals(contacts(spark, sf_dir), 1, 0)


@query(_CONTACTS + """
, b(contact, node, tm) as (select contact, src, depart from c where dst = 2 union select c.contact, c.src, c.depart from b join c on c.dst = b.node and c.arrive <= b.tm),
d as (select node, max(tm) as departure from (select node, tm from b union all select 2, 4102444800) group by 1)
select contact from c join a on a.node = c.src and c.depart >= a.arrival join d on d.node = c.dst and c.arrive <= d.departure""")
def influence_path(spark, sf_dir):
    """Transfers on some time-respecting path between two nodes."""
    return graph.path_contacts(contacts(spark, sf_dir), 1, 2, 0, 4102444800).select("contact")


@query(_CONTACTS.replace("where src = 1 union", "where src = 1 and depart >= 1706400000 union").replace("select 1, 0)", "select 1, 1706400000)") + """
select node, arrival from a where not exists (select 1 from c where c.src = a.node and c.depart >= a.arrival)""")
def influence_frontier(spark, sf_dir):
    """Reached nodes from which influence goes no further."""
    own = contacts(spark, sf_dir)
    return graph.frontier(own, graph.earliest_arrivals(own, 1, 1706400000))


@query("""
with e as (select event_id, event_type, epoch_us(ts) as u, case event_type when 'view' then 60000000 when 'click' then 1000000 when 'error' then 1000 else 1 end as w,
   event_id % 3 as sent, event_id % 2 as received from events)
select event_id, u // w * w as earliest, u // w * w + w - 1 as latest,
  case when event_type = 'purchase' then 'out' when event_type = 'signup' then 'in' when sent > 0 and received > 0 then 'both' when sent > 0 then 'out' when received > 0 then 'in' else 'none' end as flow
from e""")
def record_constraints(spark, sf_dir):
    """The span a record's time stands for, and its direction of influence."""
    kind = F.col("event_type")
    precision = F.when(kind == "view", "minute").when(kind == "click", "second").when(kind == "error", "millisecond").otherwise("microsecond")
    low, high = constraint(F.col("ts"), precision)
    operation = F.when(kind == "purchase", "write").when(kind == "signup", "read")
    way = graph.flow(F.col("event_id") % 3, F.col("event_id") % 2, operation)
    return table(spark, sf_dir, "events").select("event_id", low.alias("earliest"), high.alias("latest"), way.alias("flow"))
