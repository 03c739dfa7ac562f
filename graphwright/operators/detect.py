"""Per-record detection rules compiled to columns, and ordered patterns.

A rule is a mapping of the public Sigma form: named selections and a condition.
A selection maps ``field|modifier|...`` to a value or a list of values; a list
of such mappings is their disjunction. All rules are evaluated in one pass over
the records.
"""

from __future__ import annotations

import ast
import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import in_cidr
from . import logsource

#: Ranks of rule levels.
LEVELS = {"informational": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


class RuleError(ValueError):
    """Why a rule cannot be evaluated."""


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def pattern(value: Column, text: str) -> Column:
    """Match of a pattern with * and ? (\\ escapes), without case."""
    low, subject = text.lower(), F.lower(value)
    inner = low.strip("*")
    if "?" not in low and "*" not in inner and "\\" not in low:
        starts, ends = low.endswith("*"), low.startswith("*")
        if starts and ends:
            return F.contains(subject, F.lit(inner))
        if starts:
            return F.startswith(subject, F.lit(inner))
        if ends:
            return F.endswith(subject, F.lit(inner))
        return subject == low
    out, k = "", 0
    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text) and text[k + 1] in "*?\\":
            out += re.escape(text[k + 1])
            k += 1
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        k += 1
    return value.rlike(f"(?is)^{out}$")


def _term(field: str, modifiers: list[str], value) -> Column:
    column = F.col(field).cast("string")
    if value is None:
        return column.isNull()
    text = str(value)
    if "exists" in modifiers:
        return column.isNotNull() if text.lower() == "true" else column.isNull()
    if "cidr" in modifiers:
        return in_cidr(column, text)
    if "re" in modifiers:
        flags = "".join(m for m in modifiers if m in ("i", "m", "s"))
        return column.rlike(f"(?{flags}){text}" if flags else text)
    forms = [text]
    if "windash" in modifiers:
        forms += [re.sub(r"(^|\s)-", r"\1/", text)]
    around = ("*" if {"contains", "endswith"} & set(modifiers) else "", "*" if {"contains", "startswith"} & set(modifiers) else "")
    return _any([pattern(column, around[0] + f + around[1]) for f in forms])


def selection(spec) -> Column:
    if isinstance(spec, list):
        return _any([selection(s) for s in spec])
    parts = []
    for key, value in spec.items():
        field, *modifiers = key.split("|")
        unknown = set(modifiers) - {"contains", "startswith", "endswith", "all", "windash", "re", "i", "m", "s", "cidr", "exists"}
        if unknown:
            raise RuleError(f"modifier {sorted(unknown)[0]}")
        terms = [_term(field, modifiers, v) for v in (value if isinstance(value, list) else [value])]
        parts.append((_all if "all" in modifiers else _any)(terms))
    return F.coalesce(_all(parts), F.lit(False))


def condition(text: str, selections: dict[str, Column]) -> Column:
    """and / or / not / parentheses, ``1 of`` and ``all of`` a name pattern or them.

    Names are put in the form of Python names, and Python reads the expression.
    """
    known = dict(selections)

    def chosen(m: re.Match) -> str:
        wanted = "*" if m[2] == "them" else m[2]
        got = [c for n, c in selections.items() if fnmatch.fnmatch(n, wanted) and (m[2] != "them" or not n.startswith("_"))]
        if not got:
            raise RuleError(f"no selection {m[2]}")
        known[m[0]] = (_any if m[1] == "1" else _all)(got)
        return m[0]

    names: list[str] = []

    def named(m: re.Match) -> str:
        word = re.sub(r"^(1|all)\s+of\s+(\S+)$", chosen, m[0], flags=re.IGNORECASE)
        if word.lower() in ("and", "or", "not"):
            return word.lower()
        names.append(word)
        return f"n{len(names) - 1}"

    try:
        tree = ast.parse(re.sub(r"(?i)\b(?:1|all)\s+of\s+[^\s()]+|[^\s()]+", named, text).strip(), mode="eval").body
    except SyntaxError as e:
        raise RuleError(f"condition: {e.msg}") from e

    def column(node: ast.expr) -> Column:
        if isinstance(node, ast.BoolOp):
            return (_all if isinstance(node.op, ast.And) else _any)([column(v) for v in node.values])
        if isinstance(node, ast.UnaryOp):
            return ~column(node.operand)
        if not isinstance(node, ast.Name):
            raise RuleError("condition: a name expected")
        word = names[int(node.id[1:])]
        if word not in known:
            raise RuleError(f"no selection {word}")
        return known[word]

    return column(tree)


def fields_of(rule: dict) -> set[str]:
    """Names of the fields that a rule looks at."""
    spec = rule["detection"]
    parts = [s for n in spec if n != "condition" for s in (spec[n] if isinstance(spec[n], list) else [spec[n]])]
    return {key.split("|")[0] for s in parts for key in s}


def compiled(rule: dict, columns: list[str], names: dict[str, str] | None = None) -> Column:
    """A rule as a Column; RuleError if a field is unknown to the records.

    names: what the records call a rule's fields, where it differs.
    """
    names = names or {}
    for field in sorted(fields_of(rule)):
        if names.get(field, field) not in columns:
            raise RuleError(f"field {field}")

    def renamed(spec):
        if isinstance(spec, list):
            return [renamed(s) for s in spec]
        return {"|".join([names.get(k.split("|")[0], k.split("|")[0]), *k.split("|")[1:]]): v for k, v in spec.items()}

    spec = rule["detection"]
    return condition(spec["condition"], {n: selection(renamed(spec[n])) for n in spec if n != "condition"})


def targeted(rule: dict, columns: list[str], service: Column, event_id: Column) -> Column:
    """A rule as a Column over the records that its logsource names only."""
    try:
        own = logsource.recorded(logsource.targets(rule.get("logsource", {})), fields_of(rule))
    except logsource.SourceError as e:
        raise RuleError(f"logsource: {e}") from e
    parts, why = [], None
    for target in own:
        try:
            hit = compiled(rule, columns, target.names)
        except RuleError as e:
            why = e
            continue
        parts.append(logsource.of_target(target, service, event_id, columns) & hit)
    if not parts:
        raise why
    return _any(parts)


def load(folder: str) -> tuple[list[dict], dict[str, str]]:
    """Rules of a folder of YAML files, and why others could not be read."""
    from pathlib import Path

    import yaml

    rules, skipped = [], {}
    for path in sorted(Path(folder).rglob("*.y*ml")):
        try:
            rule = yaml.safe_load(path.read_text())
            if not isinstance(rule, dict) or "condition" not in rule.get("detection", {}):
                raise RuleError("no detection")
            rules.append(rule)
        except (yaml.YAMLError, RuleError, OSError) as e:
            skipped[str(path)] = str(e)
    return rules, skipped


def hits(
    records: DataFrame, rules: list[dict], keep: list[str], service: Column | None = None, event_id: Column | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """(keep, rule, level) of each record and rule that matches, and rules not evaluated.

    With the service and event id of a record, a rule looks at the records of
    its logsource only.
    """
    found, skipped = [], {}
    for rule in rules:
        try:
            hit = compiled(rule, records.columns) if service is None else targeted(rule, records.columns, service, event_id)
        except RuleError as e:
            skipped[rule["title"]] = str(e)
            continue
        named = F.struct(F.lit(rule["title"]).alias("rule"), F.lit(rule.get("level", "informational")).alias("level"))
        found.append(F.when(hit, named))
    if not found:
        return records.select(*keep, F.lit("").alias("rule"), F.lit("").alias("level")).limit(0), skipped
    own = F.filter(F.array(*found), lambda x: x.isNotNull())
    return records.select(*keep, F.explode(own).alias("h")).select(*keep, "h.rule", "h.level"), skipped


def hits_within(found: DataFrame, records: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Hits (record, rule) on the records (record) that a search selects, and (rule, hits) of them."""
    own = found.join(records.where(predicate).select("record").distinct(), "record", "left_semi")
    return own, own.groupBy("rule").agg(F.count("*").alias("hits"))


def ordered_pattern(
    edges: DataFrame, roles: list[tuple[str, Column]], keys: list[str], time: Column, edge_id: str, within: int
) -> DataFrame:
    """Bindings of edges to roles in time order on the same keys, each edge once.

    roles: (name, predicate) in order; each edge comes not before the one bound
    before it and at most ``within`` whole seconds after.
    """
    from .joins import band_join

    out = None
    for name, predicate in roles:
        own = edges.where(predicate).select(*keys, F.col(edge_id).alias(name), time.alias(f"__{name}"))
        if out is None:
            out, before = own, name
            continue
        near = band_join(out, own, keys, F.col(f"__{before}"), F.col(f"__{name}"), within)
        out = near.where((F.col(f"__{name}") >= F.col(f"__{before}")) & (F.col(name) != F.col(before)))
        before = name
    names = [n for n, _ in roles]
    out = out.select(*keys, *names)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            out = out.where(F.col(a) != F.col(b))
    return out
