"""Bounded traversal, closure and temporal reachability over edge tables.

Loops run on the driver over DataFrames; each round is a join whose result is
written to the shared folder, so plans stay short and a lost executor costs one
round. Frontiers are aggregated by node before they join edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import dropped, written


def both_ways(edges: DataFrame) -> DataFrame:
    """(edge, src, dst) in both directions."""
    back = edges.select("edge", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("edge", "src", "dst").union(back)


def reached(edges: DataFrame, origins: DataFrame, depth: int) -> DataFrame:
    """(node, hops): nodes within ``depth`` undirected hops of the origins (node)."""
    if not 0 <= depth <= 8:
        raise ValueError("depth is 0 to 8")
    seen = written(origins.select("node").distinct().withColumn("hops", F.lit(0)), "reached")
    steps = both_ways(edges)
    for hop in range(1, depth + 1):
        frontier = seen.where(F.col("hops") == hop - 1).select(F.col("node").alias("src"))
        new = (
            steps.join(frontier, "src", "left_semi")
            .select(F.col("dst").alias("node"))
            .distinct()
            .join(seen, "node", "left_anti")
            .withColumn("hops", F.lit(hop))
        )
        following = written(seen.union(new), "reached")
        dropped(seen)
        seen = following
    return seen


def reached_edges(edges: DataFrame, origins: DataFrame, depth: int) -> DataFrame:
    """Edges with an end within depth - 1 hops of the origins: those a search of depth meets."""
    if depth < 1:
        return edges.limit(0)
    inner = reached(edges, origins, depth - 1).select("node")
    ends = edges.select("edge", F.explode(F.array("src", "dst")).alias("node"))
    own = written(ends.join(inner, "node", "left_semi").select("edge").distinct(), "met")
    return edges.join(own, "edge", "left_semi")


def expanded(edges: DataFrame, nodes: DataFrame, origins: DataFrame, depth: int, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The edges (edge) that a search of ``depth`` steps from the origins meets, and (node, hops).

    edges (edge, kind, src, dst and others), nodes (node, node_kind and others).
    keep: which edges the search follows, over the columns of edges and those of
    both ends with the prefixes src_ and dst_ (src_node_kind, ...). A terminal
    that is not an origin is not followed to the records that name it: all
    records of a terminal name it.
    """
    if not 0 <= depth <= 8:
        raise ValueError("depth is 0 to 8")
    own = [c for c in nodes.columns if c != "node"]
    ends = [nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in own)) for side in ("src", "dst")]
    known = edges.join(ends[0], "src").join(ends[1], "dst")
    if keep is not None:
        known = known.where(F.coalesce(keep, F.lit(False)))
    there = known.select("edge", "kind", "src", F.col("src_node_kind").alias("from_kind"), "dst")
    back = known.select("edge", "kind", F.col("dst").alias("src"), F.col("dst_node_kind").alias("from_kind"), F.col("src").alias("dst"))
    ways = written(there.union(back), "ways")
    seen = written(origins.select("node").distinct().withColumn("hops", F.lit(0)), "reached")
    met = []
    for hop in range(1, depth + 1):
        frontier = seen.where(F.col("hops") == hop - 1).select(F.col("node").alias("src"))
        steps = ways.join(frontier, "src", "left_semi")
        if hop > 1:
            steps = steps.where(~((F.col("from_kind") == "terminal") & (F.col("kind") == "record_names_object")))
        steps = written(steps.select("edge", "dst").distinct(), "steps")
        met.append(steps.select("edge"))
        new = steps.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hop))
        following = written(seen.union(new), "reached")
        dropped(seen)
        seen = following
    found = edges.select("edge").limit(0)
    for part in met:
        found = found.union(part)
    return found.distinct(), seen


def record_elements(node_evidence: DataFrame, edge_evidence: DataFrame, records: DataFrame) -> DataFrame:
    """(element, id, records): nodes and edges with evidence among the records (record)."""
    nodes = node_evidence.select(F.lit("node").alias("element"), F.col("node").alias("id"), "record")
    edges = edge_evidence.select(F.lit("edge"), F.col("edge"), "record")
    own = nodes.union(edges).join(records.select("record").distinct(), "record", "left_semi")
    return own.groupBy("element", "id").agg(F.count_distinct("record").alias("records"))


def closure(pairs: DataFrame) -> DataFrame:
    """(name, root): least name of each component of linked names (a, b)."""
    links = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a")))
    links = written(links.where("a is not null and b is not null").distinct(), "names")
    root = written(links.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        # the least root among neighbours, then the root's own root: halves long chains
        near = links.join(root.select(F.col("name").alias("b"), "root"), "b").groupBy(F.col("a").alias("name")).agg(F.min("root").alias("near"))
        step = root.join(near, "name").select("name", F.least("root", "near").alias("root"))
        jump = step.select(F.col("name").alias("root"), F.col("root").alias("further"))
        new = written(
            step.join(jump, "root", "left").select("name", F.least("root", "further").alias("root")), "roots"
        )
        changed = not new.exceptAll(root).isEmpty()
        dropped(root)
        root = new
        if not changed:
            return root


def earliest_arrivals(contacts: DataFrame, origin, start) -> DataFrame:
    """(node, arrival): the earliest time each node is reached from origin at start.

    contacts (src, dst, depart, arrive). A step is taken only at or after the
    arrival at its source. Rounds go on until no arrival changes.
    """
    return first_arrivals(contacts, origin, start).select("node", "arrival")


def first_arrivals(contacts: DataFrame, origin, start) -> DataFrame:
    """(node, arrival, hops): earliest arrivals, and the fewest steps of those that give them."""
    spark = contacts.sparkSession
    kind = dict(contacts.dtypes)
    seed = spark.range(1).select(
        F.lit(origin).cast(kind["src"]).alias("node"), F.lit(start).cast(kind["arrive"]).alias("arrival"), F.lit(0).alias("hops")
    )
    best, turn = written(seed.withColumn("turn", F.lit(0)), "arrivals"), 0
    while True:
        # only nodes that the last round changed are gone on from
        front = best.where(F.col("turn") == turn)
        turn += 1
        steps = (
            contacts.join(front, contacts.src == front.node)
            .where("depart >= arrival")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min(F.struct(F.col("arrive").alias("arrival"), (F.col("hops") + 1).alias("hops"))).alias("first"))
            .select("node", "first.*", F.lit(turn).alias("turn"))
        )
        # of equal arrivals the older one stays, so a node is in front only if it changed
        least = best.union(steps).groupBy("node").agg(F.min(F.struct("arrival", "hops", "turn")).alias("first"))
        new = written(least.select("node", "first.*"), "arrivals")
        dropped(best)
        best = new
        if best.where(F.col("turn") == turn).isEmpty():
            return best.drop("turn")


def earliest_route(contacts: DataFrame, origin, target, start, end) -> list:
    """The contacts (contact) of one path that reaches target first, from origin on; empty if none by end.

    Of equally early paths it takes one of the fewest steps, and the least
    contacts from the end on. The route is one path, so the driver follows it
    back step by step.
    """
    arrivals = first_arrivals(contacts, origin, start)
    before = arrivals.select(F.col("node").alias("src"), F.col("arrival").alias("__left"), F.col("hops").alias("__hops"))
    came = contacts.join(before, "src").where("depart >= __left")
    reached_at = arrivals.select(F.col("node").alias("dst"), "arrival", "hops")
    via = came.join(reached_at, "dst").where("arrive = arrival and hops = __hops + 1")
    via = written(via.groupBy("dst").agg(F.min(F.struct("contact", "src", "arrival")).alias("v")).select("dst", "v.*"), "routes")
    route, node = [], target
    while node != origin:
        step = via.where(F.col("dst") == F.lit(node)).first()
        if step is None or (not route and step.arrival > end):
            return []
        route.append(step.contact)
        node = step.src
    return route[::-1]


def separated(contacts: DataFrame, sends: DataFrame, receives: DataFrame, origin, target) -> DataFrame:
    """Contacts in which alternative matches of one record are no way from one to another.

    sends (contact, record, candidate): contacts from a candidate to a record;
    receives (contact): those from a record back to a candidate. A record of
    two or more candidates gets a vertex of its own for each, record#candidate,
    which a candidate's contacts enter and from which the record's others leave.
    The records origin and target stay whole: the target only loses its contacts
    back to candidates, and the origin those that its candidates send to it.
    """
    name = F.concat_ws("#", F.col("record").cast("string"), F.col("candidate").cast("string"))
    own = sends.select("contact", F.col("record").cast("string").alias("record"), F.col("candidate").cast("string").alias("candidate"))
    many = own.groupBy("record").agg(F.count_distinct("candidate").alias("__n")).where("__n > 1").select("record")
    many = written(many, "records")
    ends = [F.lit(str(end)) for end in (origin, target)]
    split = own.join(many.where(~F.col("record").isin(*ends)), "record", "left_semi")
    plain = contacts.withColumns({"src": F.col("src").cast("string"), "dst": F.col("dst").cast("string")})
    back = receives.select("contact").distinct().withColumn("__back", F.lit(True))
    # the ends are two values, so these are no joins of tables
    to_origin = own.where(F.col("record") == ends[0]).join(many, "record", "left_semi").select("contact").distinct()
    target_split = many.where(F.col("record") == ends[1]).select(F.col("record").alias("src"), F.lit(True).alias("__target"))
    known = (
        plain.join(back, "contact", "left")
        .join(target_split, "src", "left")
        .where("__back is null or __target is null")
        .drop("__target")
        .join(to_origin, "contact", "left_anti")
    )
    entered = known.join(split.select("contact", name.alias("__to")), "contact", "left")
    entered = entered.withColumn("dst", F.coalesce("__to", "dst")).select(*contacts.columns)
    doors = split.select("record", "candidate").distinct()
    copies = known.where("__back is null").join(doors, F.col("src") == F.col("record")).withColumn("src", name)
    return entered.unionByName(copies.select(*contacts.columns))


def latest_departures(contacts: DataFrame, target, end) -> DataFrame:
    """(node, departure): the latest time to be at each node and still reach target by end."""
    turned = contacts.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("arrive")).alias("depart"), (-F.col("depart")).alias("arrive")
    )
    out = earliest_arrivals(turned, target, -end)
    return out.select("node", (-F.col("arrival")).alias("departure"))


def path_contacts(contacts: DataFrame, origin, target, start, end) -> DataFrame:
    """Contacts on some time-respecting path from origin to target within the times."""
    ahead = earliest_arrivals(contacts, origin, start)
    behind = latest_departures(contacts, target, end)
    return (
        contacts.join(ahead, contacts.src == ahead.node)
        .where("depart >= arrival")
        .drop("node", "arrival")
        .join(behind, F.col("dst") == behind.node)
        .where("arrive <= departure")
        .drop("node", "departure")
    )


def frontier(contacts: DataFrame, arrivals: DataFrame) -> DataFrame:
    """(node, arrival): reached nodes from which no contact goes on."""
    onward = contacts.select(F.col("src").alias("node"), "depart")
    on = (arrivals.node == onward.node) & (F.col("depart") >= F.col("arrival"))
    return arrivals.join(onward, on, "left_anti")


def path_state(contacts: DataFrame, origin, target, start, end) -> str:
    """Why there is no path: no_contact_at_origin, no_contact_at_target, not_in_time or path."""
    if contacts.where(F.col("src") == origin).isEmpty():
        return "no_contact_at_origin"
    if contacts.where(F.col("dst") == target).isEmpty():
        return "no_contact_at_target"
    reached_at = earliest_arrivals(contacts, origin, start).where((F.col("node") == target) & (F.col("arrival") <= end))
    return "not_in_time" if reached_at.isEmpty() else "path"


def flow(sent: Column, received: Column, operation: Column) -> Column:
    """Direction of influence of a record: by its operation, else by the bytes it moved."""
    # fixed values: operations whose direction is declared
    declared = F.when(operation == "write", "out").when(operation == "read", "in")
    by_bytes = F.when((sent > 0) & (received > 0), "both").when(sent > 0, "out").when(received > 0, "in")
    return F.coalesce(declared, by_bytes, F.lit("none"))
