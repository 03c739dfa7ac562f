"""Which records a detection rule is about: services, categories and their events.

A rule's ``logsource`` names a service (a channel of the event log) or a category
(events by id, in one or more services). A target is a service with event ids,
values that a field must have, and, where the event records a known set of
fields, the names that it gives to a rule's fields.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channels of the services.
CHANNELS = {
    "security": ["Security"],
    "system": ["System"],
    "application": ["Application"],
    "sysmon": ["Microsoft-Windows-Sysmon/Operational"],
    "powershell": ["Microsoft-Windows-PowerShell/Operational", "PowerShellCore/Operational"],
    "powershell-classic": ["Windows PowerShell"],
    "taskscheduler": ["Microsoft-Windows-TaskScheduler/Operational"],
    "windefend": ["Microsoft-Windows-Windows Defender/Operational"],
    "wmi": ["Microsoft-Windows-WMI-Activity/Operational"],
    "ntlm": ["Microsoft-Windows-NTLM/Operational"],
    "codeintegrity-operational": ["Microsoft-Windows-CodeIntegrity/Operational"],
    "bits-client": ["Microsoft-Windows-Bits-Client/Operational"],
    "dns-client": ["Microsoft-Windows-DNS Client Events/Operational"],
    "firewall-as": ["Microsoft-Windows-Windows Firewall With Advanced Security/Firewall"],
    "terminalservices-localsessionmanager": ["Microsoft-Windows-TerminalServices-LocalSessionManager/Operational"],
    "smbclient-security": ["Microsoft-Windows-SmbClient/Security"],
    "smbclient-connectivity": ["Microsoft-Windows-SmbClient/Connectivity"],
    "smbserver-connectivity": ["Microsoft-Windows-SMBServer/Connectivity"],
    "openssh": ["OpenSSH/Operational"],
    "appxdeployment-server": ["Microsoft-Windows-AppXDeploymentServer/Operational"],
    "appxpackaging-om": ["Microsoft-Windows-AppxPackaging/Operational"],
    "appmodel-runtime": ["Microsoft-Windows-AppModel-Runtime/Admin"],
    "capi2": ["Microsoft-Windows-CAPI2/Operational"],
    "certificateservicesclient-lifecycle-system": ["Microsoft-Windows-CertificateServicesClient-Lifecycle-System/Operational"],
    "diagnosis-scripted": ["Microsoft-Windows-Diagnosis-Scripted/Operational"],
    "dns-server": ["DNS Server"],
    "driver-framework": ["Microsoft-Windows-DriverFrameworks-UserMode/Operational"],
    "iis-configuration": ["Microsoft-IIS-Configuration/Operational"],
    "ldap": ["Microsoft-Windows-LDAP-Client/Debug"],
    "lsa-server": ["Microsoft-Windows-LSA/Operational"],
    "msexchange-management": ["MSExchange Management"],
    "printservice-admin": ["Microsoft-Windows-PrintService/Admin"],
    "printservice-operational": ["Microsoft-Windows-PrintService/Operational"],
    "security-mitigations": ["Microsoft-Windows-Security-Mitigations/Kernel Mode", "Microsoft-Windows-Security-Mitigations/User Mode"],
    "servicebus-client": ["Microsoft-ServiceBus-Client/Admin", "Microsoft-ServiceBus-Client/Operational"],
    "shell-core": ["Microsoft-Windows-Shell-Core/Operational"],
    "applocker": [
        "Microsoft-Windows-AppLocker/MSI and Script",
        "Microsoft-Windows-AppLocker/EXE and DLL",
        "Microsoft-Windows-AppLocker/Packaged app-Deployment",
        "Microsoft-Windows-AppLocker/Packaged app-Execution",
    ],
}
#: Providers of records without a channel: service, and its event ids if not all.
PROVIDERS = {
    "Microsoft-Windows-Security-Auditing": ("security", []),
    "Microsoft-Windows-Eventlog": ("security", ["1100", "1101", "1102", "1104", "1105", "1108"]),
    "Microsoft-Windows-Sysmon": ("sysmon", []),
    "Microsoft-Windows-PowerShell": ("powershell", []),
    "PowerShell": ("powershell-classic", []),
    "Microsoft-Windows-TaskScheduler": ("taskscheduler", []),
    "Microsoft-Windows-Windows Defender": ("windefend", []),
}
#: Event ids of the sysmon service by category.
SYSMON = {
    "process_creation": ["1"],
    "file_change": ["2"],
    "network_connection": ["3"],
    "sysmon_status": ["4", "16"],
    "process_termination": ["5"],
    "driver_load": ["6"],
    "image_load": ["7"],
    "create_remote_thread": ["8"],
    "raw_access_thread": ["9"],
    "process_access": ["10"],
    "file_event": ["11"],
    "registry_event": ["12", "13", "14"],
    "registry_set": ["13"],
    "registry_rename": ["14"],
    "create_stream_hash": ["15"],
    "pipe_created": ["17", "18"],
    "wmi_event": ["19", "20", "21"],
    "dns_query": ["22"],
    "file_delete": ["23"],
    "clipboard_change": ["24"],
    "process_tampering": ["25"],
    "file_delete_detected": ["26"],
    "file_block_executable": ["27"],
    "file_block_shredding": ["28"],
    "file_executable_detected": ["29"],
    "sysmon_error": ["255"],
}
#: Fields of every event, beside those of its data.
SYSTEM_FIELDS = (
    "EventID", "Channel", "Provider_Name", "Computer", "Level", "Task", "Opcode", "Keywords", "Version", "EventRecordID",
    "Provider_Guid", "Execution_ProcessID", "Execution_ThreadID", "Security_UserID",
)


@dataclass(frozen=True)
class Target:
    """Records of a service with one of the event ids (all, if none) and values; fields None: unknown."""

    service: str
    event_ids: tuple[str, ...] = ()
    equals: dict[str, list[str]] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    fields: tuple[str, ...] | None = None


#: Further events of categories.
OTHER = {
    "process_creation": [
        Target(
            "security",
            ("4688",),
            names={"Image": "NewProcessName", "ParentImage": "ParentProcessName", "ProcessId": "NewProcessId", "ParentProcessId": "ProcessId"},
            fields=(
                "SubjectUserSid", "SubjectUserName", "SubjectDomainName", "SubjectLogonId", "NewProcessId", "NewProcessName",
                "TokenElevationType", "ProcessId", "CommandLine", "TargetUserSid", "TargetUserName", "TargetDomainName",
                "TargetLogonId", "ParentProcessName", "MandatoryLabel",
            ),
        )
    ],
    "registry_add": [Target("sysmon", ("12",), {"EventType": ["CreateKey"]})],
    "registry_delete": [Target("sysmon", ("12",), {"EventType": ["DeleteKey", "DeleteValue"]})],
    "ps_module": [Target("powershell", ("4103",))],
    "ps_script": [Target("powershell", ("4104",))],
    "ps_classic_start": [Target("powershell-classic", ("400",))],
    "ps_classic_provider_start": [Target("powershell-classic", ("600",))],
    "ps_classic_script": [Target("powershell-classic", ("800",))],
}


class SourceError(ValueError):
    """Why no records belong to a logsource."""


def service_of(channel: Column, provider: Column, event_id: Column) -> Column:
    """The service of a record: by its channel, and only without one by its provider and event id."""
    by_channel = {c.lower(): s for s, channels in CHANNELS.items() for c in channels}
    found = F.element_at(_map(by_channel), F.lower(channel))
    named = F.lit(None).cast("string")
    for name, (service, ids) in PROVIDERS.items():
        own = F.lower(provider) == name.lower()
        named = F.when(own & event_id.isin(ids) if ids else own, F.lit(service)).otherwise(named)
    return F.when(channel.isNotNull(), found).otherwise(named)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def targets(source: dict) -> list[Target]:
    """The targets of a rule's logsource; SourceError if it has none."""
    if str(source.get("product", "")).lower() != "windows":
        raise SourceError(f"product {source.get('product', '')}")
    service, category = source.get("service"), source.get("category")
    if not category:
        if not service:
            raise SourceError("neither service nor category")
        if service not in CHANNELS:
            raise SourceError(f"service {service}")
        return [Target(service)]
    found = [Target("sysmon", tuple(SYSMON[category]))] if category in SYSMON else []
    found += OTHER.get(category, [])
    if not found:
        raise SourceError(f"category {category}")
    found = [t for t in found if not service or t.service == service]
    if not found:
        raise SourceError(f"category {category} in service {service}")
    return found


def recorded(of: list[Target], names: set[str]) -> list[Target]:
    """The targets whose events record all the fields a rule names; SourceError if none does.

    A field that an event never records is not an absent value: its target is out.
    """
    kept, missing = [], []
    for t in of:
        lacking = sorted(n for n in names if t.fields is not None and n not in SYSTEM_FIELDS and t.names.get(n, n) not in t.fields)
        if lacking:
            missing.append(f"{t.service} {','.join(t.event_ids)} lacks {', '.join(lacking)}")
        else:
            kept.append(t)
    if not kept:
        raise SourceError("; ".join(missing))
    return kept


def of_target(target: Target, service: Column, event_id: Column, known: list[str]) -> Column:
    """Whether a record belongs to a target; known: the columns of the records."""
    parts = [service == target.service]
    if target.event_ids:
        parts.append(event_id.isin(list(target.event_ids)))
    for name, values in target.equals.items():
        parts.append(F.lower(F.col(name)).isin([v.lower() for v in values]) if name in known else F.lit(False))
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))
