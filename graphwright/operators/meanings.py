"""Meanings of the data of system monitor events, and which names an event could carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the provider, and what its data means by event and name
PROVIDER = "Microsoft-Windows-Sysmon"
#: Of every event below but the start of a process.
OPERATION = {
    "UtcTime": "event.operation_start_time",
    "ProcessGuid": "process.id",
    "ProcessId": "process.pid",
    "Image": "process.binary_path",
}
BY_EVENT = {
    1: {
        "UtcTime": "process.start_time",
        "ProcessGuid": "process.id",
        "ProcessId": "process.pid",
        "Image": "process.binary_path",
        "CommandLine": "process.command_line",
        "FileVersion": "process_binary.file_version",
        "Description": "process_binary.description",
        "Product": "process_binary.product",
        "Company": "process_binary.company",
        "TerminalSessionId": "process.session_id",
        "ParentProcessGuid": "parent_process.id",
        "ParentProcessId": "parent_process.pid",
        "ParentImage": "parent_process.binary_path",
    },
    2: {"TargetFilename": "file.path", "CreationUtcTime": "file.created_time"},
    3: {
        "Protocol": "connection.protocol",
        "SourceIp": "connection.source_address",
        "SourcePort": "connection.source_port",
        "DestinationIp": "connection.destination_address",
        "DestinationPort": "connection.destination_port",
        "DestinationHostname": "connection.destination_reverse_lookup_name",
    },
    11: {"TargetFilename": "file.path", "CreationUtcTime": "file.created_time"},
    12: {"EventType": "event.action", "TargetObject": "registry_value.key_path"},
    13: {"EventType": "event.action", "TargetObject": "registry_value.key_path", "Details": "registry_value.data"},
    14: {"EventType": "event.action", "TargetObject": "registry_value.key_path"},
}
#: Endpoints of a connection (event 3); they mean nothing if the terminal did not initiate it.
ENDPOINTS = ("SourceIp", "SourcePort", "DestinationIp", "DestinationPort", "DestinationHostname")
TIMES = ("process.start_time", "event.operation_start_time", "file.created_time")
#: Meanings that identify something, for which the values below say that there is nothing.
IDENTIFYING = (
    "process.id", "parent_process.id", "file.path", "registry_value.key_path", "connection.source_address",
    "connection.destination_address", "connection.destination_reverse_lookup_name",
)
NOTHING = ("", "-", "{00000000-0000-0000-0000-000000000000}")
#: Names of the system part of an event.
SYSTEM = (
    "Provider@Name", "Provider@Guid", "Provider@EventSourceName", "EventID", "EventID@Qualifiers", "Version", "Level", "Task",
    "Opcode", "Keywords", "TimeCreated@SystemTime", "EventRecordID", "Correlation@ActivityID", "Correlation@RelatedActivityID",
    "Execution@ProcessID", "Execution@ThreadID", "Channel", "Computer", "Security@UserID",
)
#: The format whose rows show only what a viewer rendered.
RENDERED = "windows_event_viewer_csv"
_DATA, _UNNAMED = "EventData.", "EventData.Data"


def event_meanings(events: DataFrame) -> DataFrame:
    """(record, name, semantic, value, state, instant): the data of events, a row for each name.

    events (record, provider, event_id, data map). semantic is null for a name
    that means nothing here: another provider's, one not in the table, the
    endpoints of a connection that the terminal did not initiate, or a time
    that is none. state is absent where an identifying value says that there is
    nothing (a null GUID, a dash, an empty text), else present. instant is that
    of times, which are UTC without an offset.
    """
    table = {f"{e}\0{n}": m for e, own in BY_EVENT.items() for n, m in ({**(OPERATION if e != 1 else {}), **own}).items()}
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    rows = events.select("record", "provider", "event_id", F.col("data")["Initiated"].alias("initiated"), F.explode("data").alias("name", "value"))
    loose = (F.col("event_id") == 3) & F.col("name").isin(*ENDPOINTS) & ~F.coalesce(F.col("initiated") == "true", F.lit(False))
    meaning = F.when((F.col("provider") == PROVIDER) & ~loose, known[F.concat_ws("\0", F.col("event_id").cast("string"), "name")])
    plain = F.col("value").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,7})?$")
    instant = F.when(F.col("semantic").isin(*TIMES) & plain, F.try_to_timestamp("value"))
    timed = rows.withColumn("semantic", meaning).withColumn("instant", instant)
    semantic = F.when(F.col("semantic").isin(*TIMES) & F.col("instant").isNull(), None).otherwise(F.col("semantic"))
    absent = F.col("semantic").isin(*IDENTIFYING) & F.coalesce(F.col("value").isin(*NOTHING), F.lit(True))
    return timed.withColumn("semantic", semantic).select(
        "record", "name", "semantic", "value", F.when(absent, "absent").otherwise("present").alias("state"), "instant"
    )


def field_name(name: str) -> str:
    """The field that a name asks for: a system one, also with _ for @, else one of the event's data."""
    own = {n.replace("@", "_", 1): n for n in SYSTEM} | {n: n for n in SYSTEM}
    return own.get(name, _DATA + name)


def knowledge(name: str, names: Column, form: Column, provider: Column) -> Column:
    """What a record's fields (names, an array) say of a name: known, absent, or unknowable.

    A field that is there is known. A system name can always be known, so it is
    absent otherwise. Data that came several times (name#2), or as rendered text
    without names, is unknowable; of formats that keep all data a missing name
    is absent, and of rendered rows only where the provider names all its data.
    """
    field = field_name(name)
    if not field.startswith(_DATA):
        return F.when(F.array_contains(names, field), "known").otherwise("absent")
    repeated = F.exists(names, lambda n: n.rlike(r"^[^#]*#\d+$") & (F.substring_index(n, "#", 1) == field))
    rendered, unnamed = form == RENDERED, F.array_contains(names, _UNNAMED)
    data = F.exists(names, lambda n: F.startswith(n, F.lit(_DATA)))
    whole = ~rendered | (F.coalesce(provider == PROVIDER, F.lit(False)) & data & ~unnamed)
    there = F.array_contains(names, field)
    return F.when(repeated | (rendered & unnamed), "unknowable").when(there, "known").when(whole, "absent").otherwise("unknowable")


def when_known(name: str, holds: Column, names: Column, form: Column, provider: Column) -> Column:
    """A term over a field in three values: holds where it is known, false where absent, null where unknowable.

    Terms of this kind combine with &, | and ~ as rules need it: a rule that is
    null for a record cannot be decided on it.
    """
    state = knowledge(name, names, form, provider)
    return F.when(state == "known", F.coalesce(holds, F.lit(False))).when(state == "absent", False)
