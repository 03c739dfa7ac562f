"""Profiles of terminals from the values of their registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written

# fixed values: keys and value names that describe a terminal
_SELECT = r"(?i)^\\Select$"
_VERSION = r"(?i)^\\Microsoft\\Windows NT\\CurrentVersion$"
_ZONE = r"(?i)^\\(ControlSet\d{3})\\Control\\TimeZoneInformation$"
_INTERFACE = r"(?i)^\\(ControlSet\d{3})\\Services\\Tcpip\\Parameters\\Interfaces\\([^\\]+)$"
_NAMES = {
    "operating_system": ("ProductName", "DisplayVersion", "CurrentBuild", "UBR", "EditionID", "SystemRoot"),
    "time_zone": ("TimeZoneKeyName", "Bias", "ActiveTimeBias"),
    "address": ("DhcpIPAddress", "IPAddress", "LeaseObtainedTime"),
}


def dword(text: Column) -> Column:
    """The number before the first space of a value's text, if it fits 32 bits."""
    digits = F.substring_index(text, " ", 1)
    number = F.when(digits.rlike(r"^\d{1,10}$"), digits.cast("long"))
    return F.when(number < 1 << 32, number)


def control_sets(values: DataFrame) -> DataFrame:
    """(terminal, control_set): the set that a terminal's registry names as current, where it names just one."""
    chosen = values.where(F.col("path").rlike(_SELECT) & (F.col("name") == "Current")).select(
        "terminal", F.format_string("controlset%03d", dword(F.col("value"))).alias("control_set"), dword(F.col("value")).alias("n")
    )
    one = chosen.where("n is not null").groupBy("terminal").agg(F.count_distinct("control_set").alias("sets"), F.min("control_set").alias("control_set"))
    return one.where("sets = 1").select("terminal", "control_set")


def profile_values(values: DataFrame) -> DataFrame:
    """(terminal, part, interface, record, name, value): the values that describe a terminal.

    values (terminal, record, path, name, value): a record is one key with its
    values. Parts: operating_system, time_zone and address; the last two only of
    the terminal's current control set. Empty values are left out.
    """
    path = F.col("path")
    zone, interface = F.regexp_extract(path, _ZONE, 1), F.regexp_extract(path, _INTERFACE, 1)
    part = F.when(path.rlike(_VERSION), "operating_system").when(zone != "", "time_zone").when(interface != "", "address")
    known = F.lit(False)
    for key, names in _NAMES.items():
        known = known | ((F.col("part") == key) & F.col("name").isin(*names))
    own = values.where("value <> ''").select(
        "terminal", part.alias("part"), F.lower(F.concat(zone, interface)).alias("own_set"),
        F.nullif(F.regexp_extract(path, _INTERFACE, 2), F.lit("")).alias("interface"), "record", "name", "value",
    )
    current = control_sets(values)
    chosen = own.where(known).join(current, "terminal", "left")
    return chosen.where("own_set = '' or own_set = control_set").drop("own_set", "control_set")


def leases(values: DataFrame, last: DataFrame) -> DataFrame:
    """(terminal, interface, record, name, ip, lease_from, lease_to): the addresses of a terminal's interfaces.

    last (terminal, last): the last moment of the terminal's records, in
    seconds. A lease runs from the time that its key states, if it does, to that
    moment; 0.0.0.0 is no address. The rows are assignments for ``resolved``.
    """
    own = written(profile_values(values).where("part = 'address'"), "addresses")
    begun = own.where("name = 'LeaseObtainedTime'").select("terminal", "record", dword(F.col("value")).alias("obtained")).where("obtained > 0")
    named = own.where("name <> 'LeaseObtainedTime'").withColumn("ip", F.explode(F.split(F.trim("value"), r"\s+"))).where("ip not in ('', '0.0.0.0')")
    held = named.join(begun, ["terminal", "record"], "left").join(last.select("terminal", "last"), "terminal", "left")
    both = F.col("obtained").isNotNull() & F.col("last").isNotNull()
    return held.select(
        "terminal", "interface", "record", "name", "ip", F.when(both, F.col("obtained")).alias("lease_from"), F.when(both, F.col("last")).alias("lease_to")
    )


def address_edges(held: DataFrame) -> DataFrame:
    """(terminal, ip, records, lease_from, lease_to): one edge for each address of a terminal, its first lease on."""
    return held.groupBy("terminal", "ip").agg(
        F.count_distinct("record").alias("records"), F.min("lease_from").alias("lease_from"), F.max("lease_to").alias("lease_to")
    )


def summaries(values: DataFrame, facts: DataFrame) -> DataFrame:
    """(terminal, operating_system, records, categorized): terminals with a profile or with classified records.

    facts (terminal, record, categories): the records placed on a terminal.
    operating_system joins product, version and build.revision of its first key
    that has each.
    """
    own = profile_values(values)
    first = own.where("part = 'operating_system'").groupBy("terminal", "name").agg(F.min_by("value", "record").alias("value"))
    named = first.groupBy("terminal").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("v"))  # six names at most
    build = F.concat_ws(".", F.element_at("v", "CurrentBuild"), F.when(F.element_at("v", "CurrentBuild").isNotNull(), F.substring_index(F.element_at("v", "UBR"), " ", 1)))
    text = F.concat_ws(" ", F.element_at("v", "ProductName"), F.element_at("v", "DisplayVersion"), F.nullif(build, F.lit("")))
    systems = named.select("terminal", text.alias("operating_system"))
    profiled = values.select("terminal").distinct().join(systems, "terminal", "left")
    tallies = facts.groupBy("terminal").agg(F.count("*").alias("records"), F.count_if(F.size("categories") > 0).alias("categorized"))
    both = profiled.withColumn("profile", F.lit(True)).join(tallies, "terminal", "full")
    out = both.na.fill(0, ["records", "categorized"]).where("profile or categorized > 0")
    return out.select("terminal", F.coalesce("operating_system", F.lit("")).alias("operating_system"), "records", "categorized")


def fact_nodes(facts: DataFrame, node_evidence: DataFrame) -> DataFrame:
    """(terminal, record, node): the nodes that each classified record of a terminal names, but terminals and records.

    node_evidence (node, kind, record).
    """
    events = facts.where(F.size("categories") > 0).select("terminal", "record").distinct()
    named = written(node_evidence.where("kind not in ('terminal', 'record')").select("node", "record").distinct(), "named")
    return events.join(named, "record").select("terminal", "record", "node")
