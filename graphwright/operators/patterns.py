"""Patterns of several nodes and edges, compiled to equality joins.

    nodes:  {role: {kind: k, where: {attribute: {predicate: value}}}}
    edges:  {role: {kind: k, from: node role, to: node role}}
    distinct: [[node role, node role]]
    joins:  [{equal | ieq | has_token | contains: [role.attribute, role.attribute]}]
    order:  [{before: [edge role, edge role], within: seconds}]
    inputs: [names that must have been observed]

Every edge must share a node role with those before it, so that each join has
an equality; a pattern that falls apart is an error, not a cross join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .detect import RuleError

_BREAKS = r"[\s\"'(),;=|&]+"


def _basename(v: Column) -> Column:
    return F.lower(F.element_at(F.split(v, r"[\\/]"), -1))


def _number(v: Column) -> Column:
    """An unsigned number, hexadecimal after 0x."""
    digits = F.regexp_extract(v, "^0[xX]([0-9a-fA-F]{1,15})$", 1)
    return F.coalesce(F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("long"), v.try_cast("long"))


def _has_token(v: Column, token: Column) -> Column:
    return F.array_contains(F.transform(F.split(v, _BREAKS), F.lower), F.lower(token))


#: One value against what a rule asks for.
_TESTS = {
    "eq": lambda v, w: v == w,
    "ieq": lambda v, w: F.lower(v) == w.lower(),
    "in": lambda v, w: v.isin(list(w)),
    "basename_in": lambda v, w: _basename(v).isin([x.lower() for x in w]),
    "has_token": lambda v, w: _has_token(v, F.lit(w)),
    "prefix": lambda v, w: F.startswith(v, F.lit(w)),
    "contains": lambda v, w: F.contains(v, F.lit(w)),
    "regex": lambda v, w: v.rlike(w),
    "mask_any": lambda v, w: reduce(
        lambda a, b: a | b, (F.coalesce(_number(v).bitwiseAND(F.lit(int(m, 0))) != 0, F.lit(False)) for m in w)
    ),
}
_JOINS = {
    "equal": lambda a, b: a == b,
    "ieq": lambda a, b: F.lower(a) == F.lower(b),
    "has_token": _has_token,
    "contains": F.contains,
}


def predicate(spec: dict, values: Column) -> Column:
    """Whether some value (array) meets the one test of spec; present and absent ask for any."""
    if len(spec) != 1:
        raise RuleError("one predicate expected")
    (name, want), = spec.items()
    some = F.coalesce(F.size(values) > 0, F.lit(False))
    if name == "present":
        return some
    if name == "absent":
        return ~some
    if name not in _TESTS:
        raise RuleError(f"predicate {name}")
    return F.coalesce(F.exists(values, lambda v: F.coalesce(_TESTS[name](v, want), F.lit(False))), F.lit(False))


def _meet(name: str, left: Column, right: Column) -> Column:
    """Whether some value of left meets some value of right (arrays) by the named test."""

    def some(v: Column) -> Column:
        return F.exists(right, lambda w: F.coalesce(_JOINS[name](v, w), F.lit(False)))

    return F.coalesce(F.exists(left, some), F.lit(False))


def validate(pattern: dict) -> list[str]:
    """Names of the edge roles in an order in which each shares a node with those before it."""
    nodes, edges = pattern["nodes"], pattern["edges"]
    for role, e in edges.items():
        for end in ("from", "to"):
            if e[end] not in nodes:
                raise RuleError(f"edge {role}: no node {e[end]}")
    for pair in pattern.get("distinct", []):
        if set(pair) - set(nodes):
            raise RuleError("distinct names no node")
    for o in pattern.get("order", []):
        if set(o["before"]) - set(edges) or len(o["before"]) != 2:
            raise RuleError("order names two edges")
    order, seen = [], set()
    left = list(edges)
    while left:
        following = next((r for r in left if not order or {edges[r]["from"], edges[r]["to"]} & seen), None)
        if following is None:
            raise RuleError("the pattern is not connected")
        order.append(following)
        left.remove(following)
        seen |= {edges[following]["from"], edges[following]["to"]}
    return order


def _possible(pattern: dict, of_role, edges: DataFrame) -> DataFrame:
    """Rows of edges of the kinds asked for, but those with an end where the kind allows one node role only and that role not this node."""
    asked = list(pattern["edges"].values())
    kinds = sorted({e["kind"] for e in asked})
    out = edges.where(F.col("kind").isin(kinds))
    for end, column in (("from", "src"), ("to", "dst")):
        roles = {k: {e[end] for e in asked if e["kind"] == k} for k in kinds}
        fixed = {k: next(iter(r)) for k, r in roles.items() if len(r) == 1 and pattern["nodes"][next(iter(r))].get("where")}
        if not fixed:
            continue
        allowed = [of_role(role).select(F.lit(k).alias("kind"), F.col(role).alias(column)) for k, role in fixed.items()]
        met = out.join(reduce(DataFrame.union, allowed), ["kind", column], "left_semi")
        rest = out.where(~F.col("kind").isin(list(fixed)))
        out = (met if len(fixed) == len(kinds) else met.unionByName(rest)).select(*edges.columns)
    return out


def matches(
    pattern: dict, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, observed_inputs: set[str] = frozenset()
) -> tuple[DataFrame | None, str | None]:
    """(bindings, None) with a column for each role, or (None, why not evaluated).

    nodes (node, kind, attributes map<string, array<string>>), edges (edge,
    kind, src, dst), evidence (edge, time in seconds). An edge binds one role
    only. Order asks for evidence of both edges in order, within the seconds.

    edges (kind, src, dst, time) without an evidence table are the evidence in
    long form, and an edge is its kind and ends. Rows with an end that no node
    can be are left out first, and only the others are made distinct.
    """
    missing = sorted(set(pattern.get("inputs", [])) - set(observed_inputs))
    if missing:
        return None, f"input not observed: {missing[0]}"
    order = validate(pattern)
    asked = {tuple(p.split(".", 1)) for j in pattern.get("joins", []) for pair in j.values() for p in pair}

    def of_role(role: str) -> DataFrame:
        spec = pattern["nodes"][role]
        rows = nodes.where(F.col("kind") == spec["kind"])
        for name, test in spec.get("where", {}).items():
            rows = rows.where(predicate(test, F.col("attributes")[name]))
        own = [F.col("attributes")[f].alias(f) for r, f in sorted(asked) if r == role]
        return rows.select(F.col("node").alias(role), *([F.struct(*own).alias(f"__{role}")] if own else []))

    if evidence is None and "time" in edges.columns:
        held = written(_possible(pattern, of_role, edges), "edges").withColumn("edge", F.struct("kind", "src", "dst"))
        edges, evidence = held.select("edge", "kind", "src", "dst").distinct(), held.select("edge", "time").distinct()

    out, bound = None, set()
    for role in order:
        e = pattern["edges"][role]
        rows = edges.where(F.col("kind") == e["kind"]).select(
            F.col("edge").alias(role), F.col("src").alias(e["from"]), F.col("dst").alias(e["to"])
        )
        ends = list(dict.fromkeys((e["from"], e["to"])))
        for end in ends:
            if end not in bound:
                rows = rows.join(of_role(end), end)
        out = rows if out is None else out.join(rows, [x for x in ends if x in bound])
        bound |= set(ends)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if pattern["edges"][a]["kind"] == pattern["edges"][b]["kind"]:
                out = out.where(F.col(a) != F.col(b))
    for a, b in pattern.get("distinct", []):
        out = out.where(F.col(a) != F.col(b))
    for j in pattern.get("joins", []):
        for name, (a, b) in j.items():
            (ra, fa), (rb, fb) = a.split(".", 1), b.split(".", 1)
            out = out.where(_meet(name, F.col(f"__{ra}")[fa], F.col(f"__{rb}")[fb]))
    roles = [*order, *pattern["nodes"]]
    out = out.select(*roles)
    for o in pattern.get("order", []):
        a, b = o["before"]
        left = evidence.select(F.col("edge").alias(a), F.col("time").alias("__a"))
        right = evidence.select(F.col("edge").alias(b), F.col("time").alias("__b"))
        gap = F.col("__b") - F.col("__a")
        timed = out.join(left, a).join(right, b).where((gap > 0) & (gap <= o.get("within", 1 << 60)))
        out = timed.select(*roles).distinct()
    return out, None
