"""Details of nodes, edges, records and matches, and how they are explained."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .joins import band_join, interval_candidates, merged_spans

#: Outcomes of an origin of matching, the one that counts first first.
OUTCOMES = (
    "matched",
    "candidate_set_failed",
    "node_unresolved",
    "source_declaration_conflict",
    "destination_ip_absent",
    "destination_port_absent",
    "terminal_undetermined",
    "terminal_id_absent",
    "origin_item_unreadable",
    "no_candidate_in_window",
    "no_candidate_matching_conditions",
    "candidate_item_unreadable",
    "proxy_address_unknown",
    "no_compared_condition",
    "no_candidate_record",
)
#: What a pair of records may be matched by.
CONDITIONS = (
    "terminal_ip_assignment", "terminal_identity_matches", "parent_process_id_matches", "destination_ip", "destination_port",
    "destination_authority", "second_of_time", "sub_second_of_time", "client_port", "process", "user",
)
#: Provider, event id, category and outcome of records about a terminal.
TERMINAL_EVENTS = (
    ("Microsoft-Windows-Security-Auditing", "4625", "remote_logon", "failure"),
    ("Microsoft-Windows-Security-Auditing", "4624", "remote_logon", "success"),
    ("Microsoft-Windows-RemoteDesktopServices-RdpCoreTS", "131", "remote_logon", "connection"),
    ("Microsoft-Windows-TerminalServices-RemoteConnectionManager", "1149", "remote_logon", "success"),
    ("Microsoft-Windows-TerminalServices-LocalSessionManager", "21", "remote_logon", "success"),
    ("Microsoft-Windows-TerminalServices-LocalSessionManager", "25", "remote_logon", "success"),
    ("Microsoft-Windows-Security-Auditing", "4720", "account_management", None),
    ("Microsoft-Windows-Security-Auditing", "4722", "account_management", None),
    ("Microsoft-Windows-Security-Auditing", "4724", "account_management", None),
    ("Microsoft-Windows-Security-Auditing", "4726", "account_management", None),
    ("Microsoft-Windows-Security-Auditing", "4728", "account_management", None),
    ("Microsoft-Windows-Security-Auditing", "4732", "account_management", None),
    ("Microsoft-Windows-Security-Auditing", "4738", "account_management", None),
    ("Microsoft-Windows-Security-Auditing", "4756", "account_management", None),
    ("Microsoft-Windows-TaskScheduler", "106", "task_service_registration", None),
    ("Microsoft-Windows-Security-Auditing", "4698", "task_service_registration", None),
    ("Service Control Manager", "7045", "task_service_registration", None),
    ("Microsoft-Windows-PowerShell", "4104", "powershell", None),
    ("MsiInstaller", "1033", "installation", None),
    ("MsiInstaller", "1040", "installation", None),
    ("MsiInstaller", "11707", "installation", None),
    ("Microsoft-Windows-Windows Defender", "5001", "defense_evasion", None),
    ("Microsoft-Windows-Eventlog", "1102", "defense_evasion", None),
    ("Microsoft-Windows-Eventlog", "104", "defense_evasion", None),
)
#: Categories of records that are artifacts.
ARTIFACTS = {"prefetch": "program_execution", "amcache": "program_execution", "task_cache": "task_service_registration"}
#: Logon types of a logon from another terminal.
REMOTE_LOGON_TYPES = ("3", "10")


def event_kind(category: Column, action: Column, has_category: Column, provider: Column, event_id: Column) -> tuple[Column, Column]:
    """Category and action of a record: of its own fields if it has that of the category, else provider and event id."""
    other = ~has_category & (F.coalesce(provider, F.lit("")) != "") & (F.coalesce(event_id, F.lit("")) != "")
    return F.when(has_category, category).when(other, provider), F.when(has_category, action).when(other, event_id)


def kind_passes(kind: Column, kinds: list[str], objects: bool) -> Column:
    """Whether a node passes a choice of kinds (none: all); a search for objects hides records."""
    out = kind.isin(kinds) if kinds else F.lit(True)
    return out & (kind != "record") if objects else out


def step_predicate(conditions: Column, filters: Column, origins_only: bool) -> Column:
    """What the evidence of a followed edge must meet: the filters alone where conditions choose origins only."""
    return filters if origins_only else conditions & filters


def checked_search(words: list[str], origins: list, depth: int) -> None:
    """ValueError unless a search keeps to the limits: 16 words of 1024 bytes, 32 origins, depth 0 to 8."""
    if len(words) > 16 or any(len(w.encode()) > 1024 or not w for w in words):
        raise ValueError("up to 16 words of 1 to 1024 bytes")
    if len(origins) > 32:
        raise ValueError("up to 32 origins")
    if not 0 <= depth <= 8:
        raise ValueError("depth is 0 to 8")


def classified(records: DataFrame) -> DataFrame:
    """records (provider, event_id, logon_type, artifact and others) with category and outcome; null if none."""
    table = records.sparkSession.createDataFrame(list(TERMINAL_EVENTS), "provider string, event_id string, category string, outcome string")
    joined = records.join(F.broadcast(table), ["provider", "event_id"], "left")  # a fixed table of a few rows
    local = (F.col("event_id") == "4624") & ~F.coalesce(F.trim("logon_type").isin(*REMOTE_LOGON_TYPES), F.lit(False))
    artifact = F.lit(None).cast("string")
    for kind, category in ARTIFACTS.items():
        artifact = F.when(F.col("artifact") == kind, F.lit(category)).otherwise(artifact)
    named = artifact.isNotNull()
    return joined.select(
        *records.columns,
        F.when(named, artifact).when(~F.coalesce(local, F.lit(False)), F.col("category")).alias("category"),
        F.when(~named & ~F.coalesce(local, F.lit(False)), F.col("outcome")).alias("outcome"),
    )


def terminal_events(records: DataFrame, terminal, category: str | None = None, source_ip: str | None = None) -> DataFrame:
    """The classified records of one terminal, of a category and from an address if given."""
    own = classified(records).where((F.col("terminal") == F.lit(terminal)) & F.col("category").isNotNull())
    if category:
        own = own.where(F.col("category") == category)
    return own.where(F.col("src_ip") == source_ip) if source_ip else own


def original_name_differs(name: Column, original: Column) -> Column:
    """Whether two file names differ without their last extension and case; not if one is blank."""

    def stem(c: Column) -> Column:
        return F.lower(F.regexp_replace(F.trim(c), r"\.[^./]*$", ""))

    blank = (F.trim(F.coalesce(name, F.lit(""))) == "") | (F.trim(F.coalesce(original, F.lit(""))) == "")
    return ~blank & F.coalesce(stem(name) != stem(original), F.lit(False))


def recorded_start(end: Column, wall: Column, offset_minutes: Column) -> Column:
    """Start that a logoff itself records, a local wall time read under the offset of its own time; null if later."""
    start = F.timestamp_add("MINUTE", -offset_minutes, wall)
    return F.when(start <= end, start)


def interpreted_range(low: Column, high: Column, offset_minutes: Column) -> tuple[Column, Column]:
    """A range of local times as instants under an offset within 18 hours."""
    ok = F.abs(offset_minutes) <= 18 * 60
    return tuple(F.when(ok, F.timestamp_add("MINUTE", -offset_minutes, c)) for c in (low, high))


def node_label(label: Column, identity: Column, kind: Column) -> tuple[Column, Column]:
    """Label of a node, and whether it is derived: what a record calls it, else the last part of a file's path."""
    tail = F.regexp_extract(identity, r"([^\\/]*)$", 1)
    derived = label.isNull() & (kind == "file") & (tail != "")
    return F.coalesce(label, F.when(kind == "file", F.nullif(tail, F.lit(""))).otherwise(identity)), derived


def best_outcomes(outcomes: DataFrame) -> DataFrame:
    """(origin, outcome): of an origin's outcomes over candidate sets, the one that comes first in OUTCOMES."""
    ranked = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome")), F.lit(0)), F.lit(len(OUTCOMES) + 1))
    return outcomes.groupBy("origin").agg(F.min(F.struct(ranked.alias("rank"), "outcome")).alias("o")).select("origin", "o.outcome")


def derivations(records: DataFrame, best: DataFrame) -> DataFrame:
    """(record, outcome): how each record fared as an origin; not_used_as_origin for the others."""
    joined = records.join(best.withColumnRenamed("origin", "record"), "record", "left")
    return joined.select("record", F.coalesce("outcome", F.lit("not_used_as_origin")).alias("outcome"))


def match_outcome(*rules: tuple[Column, str]) -> Column:
    """Outcome of a match request: that of the first rule that holds, in the order given, else matched."""
    out = None
    for holds, name in rules:
        if name not in OUTCOMES:
            raise ValueError(f"outcome {name}")
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return F.lit("matched") if out is None else out.otherwise("matched")


def selected_conditions(chosen: list[tuple[str, int]]) -> dict[str, int]:
    """The chosen conditions with their tolerances, in their own order.

    Each comes once; a tolerance, in seconds, belongs to second_of_time alone.
    """
    names = [name for name, _ in chosen]
    if set(names) - set(CONDITIONS) or len(set(names)) < len(names):
        raise ValueError(f"conditions {names}")
    if any(t < 0 or (t and name != "second_of_time") for name, t in chosen):
        raise ValueError("a tolerance in seconds comes with second_of_time")
    return {c: dict(chosen)[c] for c in CONDITIONS if c in names}


def condition_trail(
    origins: DataFrame, candidates: DataFrame, origin: str, conditions: list[tuple[str, str, str]], times: tuple[str, str], radius: int
) -> DataFrame:
    """(origin, stage, condition, stays, state): how many candidates are left after each condition, in order.

    conditions: (name, column of origins, column of candidates), each on top of
    those before it; stage 0 is all candidates, and the last stage is those
    within ``radius`` of the origin by the whole numbers of ``times``. state is
    kept, emptied (the first stage with none), empty (later ones), or unread (the
    origin has no value to compare, which keeps none). Candidates are counted
    by the prefixes of their conditions, and by time within all of them, so no
    pair is listed.
    """
    names, own, theirs = (list(x) for x in zip(*conditions, strict=True))
    at, when = times
    # grouping_id has a bit for each column that a total leaves out
    totals = candidates.rollup(*theirs).agg(F.count("*").alias("stays"), F.grouping_id().alias("left_out"))
    stage = F.lit(len(theirs)) - F.bit_count("left_out")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    prefix = lambda cols, n: F.slice(F.array(*map(text, cols)), F.lit(1), n)
    keyed = totals.select(stage.cast("int").alias("stage"), "stays", *theirs)
    keyed = written(keyed.select("stage", prefix(theirs, F.col("stage")).alias("key"), "stays"), "prefixes")
    stages = origins.select(origin, *own, at, F.explode(F.sequence(F.lit(0), F.lit(len(own)))).alias("stage"))
    readable = F.forall(F.slice(F.array(*(F.col(c).isNotNull() for c in own)), F.lit(1), F.col("stage")), lambda x: x)
    asked = stages.select(origin, "stage", prefix(own, F.col("stage")).alias("key"), readable.alias("readable"))
    met = asked.join(keyed, ["stage", "key"], "left").select(origin, "stage", "readable", F.when(F.col("readable"), F.col("stays")).alias("stays"))

    seconds = candidates.where(F.col(when).isNotNull()).groupBy(*(F.col(c).alias(o) for c, o in zip(theirs, own, strict=True)), F.col(when).alias("__when")).agg(F.count("*").alias("__n"))
    near = band_join(origins.select(origin, *own, at), seconds, own, F.col(at), F.col("__when"), radius)
    last = near.groupBy(origin).agg(F.sum("__n").alias("stays"))
    timed = origins.select(origin, F.lit(len(own) + 1).alias("stage"), F.forall(F.array(*(F.col(c).isNotNull() for c in (*own, at))), lambda x: x).alias("readable"))
    rows = met.unionByName(timed.join(last, origin, "left")).withColumn("stays", F.coalesce("stays", F.lit(0)))
    # the stages of one origin are few rows
    before = F.lag("stays").over(Window.partitionBy(origin).orderBy("stage"))
    state = F.when(F.col("stays") > 0, "kept").when(~F.col("readable"), "unread").when(F.coalesce(before, F.lit(1)) > 0, "emptied").otherwise("empty")
    name = F.get(F.array(F.lit("all"), *map(F.lit, names), F.lit("time")), F.col("stage"))
    return rows.select(origin, "stage", name.alias("condition"), "stays", state.alias("state"))


def match_sides(records: DataFrame) -> DataFrame:
    """records with side: origin (a connection and no process), candidate (a process, a connection and a terminal) or null.

    records (process, src_port, dst_ip, dst_port, terminal, at); a record
    without a time is on neither side.
    """
    dated = F.col("at").isNotNull()
    connection = F.col("dst_ip").isNotNull() & (F.col("src_port").isNotNull() | F.col("dst_port").isNotNull())
    held = dated & connection
    side = F.when(held & F.col("process").isNull(), "origin").when(held & F.col("process").isNotNull() & F.col("terminal").isNotNull(), "candidate")
    return records.withColumn("side", side)


def explained_pairs(pairs: DataFrame, conditions: dict[str, tuple[str, str]], times: tuple[str, str], window_s: int) -> DataFrame:
    """(origin, candidate, condition, left, right, holds, delta_s): how each pair of records compares.

    conditions: name to the columns of both sides; times: columns of both
    sides in whole seconds, of which delta_s is the difference.
    """
    rows = [
        F.struct(
            F.lit(name).alias("condition"), F.col(a).cast("string").alias("left"), F.col(b).cast("string").alias("right"),
            F.coalesce(F.col(a) == F.col(b), F.lit(False)).alias("holds"), F.lit(None).cast("long").alias("delta_s"),
        )
        for name, (a, b) in conditions.items()
    ]
    delta = (F.col(times[1]) - F.col(times[0])).cast("long")
    rows.append(
        F.struct(
            F.lit("second_of_time").alias("condition"), F.col(times[0]).cast("string").alias("left"), F.col(times[1]).cast("string").alias("right"),
            F.coalesce(F.abs(delta) <= window_s, F.lit(False)).alias("holds"), delta.alias("delta_s"),
        )
    )
    return pairs.select("origin", "candidate", F.explode(F.array(*rows)).alias("r")).select("origin", "candidate", "r.*")


def by_tier(candidates: DataFrame, key: str, tier: str, order: str) -> DataFrame:
    """candidates with place: 1, 2, ... of each key by tier, then as they came."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(tier, order)))


def node_details(summaries: DataFrame, edge_counts: DataFrame, attributes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row for each node: its summary, edges by kind and direction, attributes and outcome.

    summaries (node and others), edge_counts (node, kind, direction, n_edges),
    attributes (node, attribute, values), outcomes (node, outcome). The lists
    are as long as there are kinds and attributes, not as there are edges.
    """
    edges = edge_counts.groupBy("node").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "direction", F.col("n_edges").cast("string")))), ",").alias("edges")
    )
    named = attributes.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "attribute", "values"))), ";").alias("attributes"))
    joined = summaries.join(edges, "node", "left").join(named, "node", "left").join(outcomes, "node", "left")
    return joined.withColumn("outcome", F.coalesce("outcome", F.lit("not_used_as_origin")))


def edge_details(evidence: DataFrame, groups: list[str]) -> DataFrame:
    """(edge, records, undated, first_seen, last_seen, groups): edges over their evidence (edge, record, time, group columns).

    Evidence is dealt out by edge once, for its groups too.
    """
    by_group = evidence.repartition("edge").groupBy("edge", *groups).agg(
        F.count("*").alias("n"), F.count_if(F.col("time").isNull()).alias("u"), F.min("time").alias("lo"), F.max("time").alias("hi")
    )
    return by_group.groupBy("edge").agg(
        F.sum("n").alias("records"), F.sum("u").alias("undated"), F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"), F.count("*").alias("groups")
    )


def group_accounts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, account, records): accounts that the evidence of each group names."""
    return df.where("account is not null").groupBy(*keys, "account").agg(F.count_distinct("record").alias("records"))


def edge_ranges(edges: DataFrame, evidence: DataFrame, assignments: DataFrame, leases: DataFrame) -> DataFrame:
    """(edge, low, high, basis): range of an edge by its evidence, else its assignments, else its lease.

    evidence (edge, time), assignments and leases (edge, low, high).
    """
    spans = [
        evidence.where("time is not null").groupBy("edge").agg(F.min("time").alias("lo"), F.max("time").alias("hi")).withColumn("basis", F.lit("evidence")),
        assignments.groupBy("edge").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).withColumn("basis", F.lit("assignment")),
        leases.groupBy("edge").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).withColumn("basis", F.lit("lease")),
    ]
    rank = F.when(F.col("basis") == "evidence", 0).when(F.col("basis") == "assignment", 1).otherwise(2)
    best = reduce(DataFrame.unionByName, spans).groupBy("edge").agg(F.min_by(F.struct("lo", "hi", "basis"), rank).alias("s"))
    joined = edges.select("edge").join(best, "edge", "left")
    return joined.select("edge", F.col("s.lo").alias("low"), F.col("s.hi").alias("high"), F.col("s.basis").alias("basis"))


def by_position(records: DataFrame, order: str) -> DataFrame:
    """The first record of each (source, position_kind, position)."""
    rest = [c for c in records.columns if c not in ("source", "position_kind", "position")]
    first = F.min_by(F.struct(*rest), order).alias("r")
    return records.groupBy("source", "position_kind", "position").agg(first).select("source", "position_kind", "position", "r.*")


def raw_texts(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record, text) of the wanted records (record)."""
    return records.select("record", "text").join(wanted.select("record").distinct(), "record", "left_semi")


def converted_texts(fields: DataFrame) -> DataFrame:
    """(record, text): searchable text of records without lines, a field a line, in order."""
    lines = F.array_sort(F.collect_list(F.struct("ord", F.concat_ws("=", "name", "value").alias("line"))))
    return fields.where("value is not null").groupBy("record").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def unrendered(records: DataFrame, most: int) -> DataFrame:
    """(record): the first ``most`` records, by their number, without a rendered message. The limit is the feature."""
    return records.where("message is null").orderBy("record").limit(most).select("record")


def header_comparison(records: DataFrame, headers: DataFrame) -> DataFrame:
    """(source, highest, next, unreadable, comparison): record numbers of a file against the next one its header holds.

    records (source, number as text), headers (source, next as text).
    """
    number = F.when(F.col("number").rlike(r"^\d{1,18}$"), F.col("number").cast("long"))
    seen = records.groupBy("source").agg(F.max(number).alias("highest"), F.count_if(number.isNull()).alias("unreadable"))
    next_ = F.when(F.col("next").rlike(r"^\d{1,18}$"), F.col("next").cast("long"))
    joined = headers.select("source", next_.alias("next")).join(seen, "source", "left")
    comparison = (
        F.when(F.col("next").isNull(), "unreadable")
        .when(F.col("highest").isNull(), "no_record_numbers")
        .when(F.col("next") == F.col("highest") + 1, "agrees")
        .otherwise("differs")
    )
    return joined.select("source", "highest", "next", F.coalesce("unreadable", F.lit(0)).cast("long").alias("unreadable"), comparison.alias("comparison"))


def run_times(records: DataFrame) -> DataFrame:
    """(record, at, position): a row for each further run time (an array) of a record."""
    return records.select("record", F.posexplode("more").alias("position", "at")).where("at is not null")


def supplemented(records: DataFrame, assignments: DataFrame, bucket: int = 86_400) -> DataFrame:
    """records with terminal_items: the terminals that assignments of their address give at their time, in order.

    records (record, address, at), assignments (address, start_s, end_s, terminal).
    Those of one address and terminal are merged first, so that a record meets a
    terminal once.
    """
    spans = merged_spans(assignments.select("address", "terminal", "start_s", "end_s"), ["address", "terminal"], "start_s", "end_s", bucket)
    held = interval_candidates(records.select("record", "address", "at"), spans, ["address"], "at", "start_s", "end_s", bucket)
    items = held.groupBy("record").agg(F.array_sort(F.collect_set("terminal")).alias("terminal_items"))
    joined = records.join(items, "record", "left")
    return joined.withColumn("terminal_items", F.coalesce("terminal_items", F.array().cast("array<string>")))


def node_hosts(edges: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, host): the one host of a node by its ran_on edges and by its key; nodes of several have none.

    edges (kind, src, dst), keyed (node, host).
    """
    by_edge = edges.where("kind = 'ran_on'").select(F.col("src").alias("node"), F.col("dst").alias("host"))
    both = by_edge.unionByName(keyed.select("node", "host")).where("host is not null")
    return both.groupBy("node").agg(F.count_distinct("host").alias("n"), F.min("host").alias("host")).where("n = 1").select("node", "host")


def match_ids(bindings: DataFrame, rule: str, roles: list[str]) -> DataFrame:
    """bindings with id: a digest of the rule and the element of each role, in the order of the role names."""
    parts = [F.concat_ws("=", F.lit(r), F.col(r).cast("string")) for r in sorted(roles)]
    return bindings.withColumn("id", F.sha2(F.concat_ws("\n", F.lit(rule), *parts), 256))


def capability(channel: Column, provider: Column) -> Column:
    """What input a record shows to be there: its channel, else its provider, in lower case."""
    return F.lower(F.coalesce(F.nullif(channel, F.lit("")), F.nullif(provider, F.lit(""))))
