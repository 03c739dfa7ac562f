"""Readers of XML events and of proxy logs with a described format; sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import sanitized
from .lines import line_parts

#: Format codes of the proxy's log line and what they name.
CODES = {
    ">a": "client", ">p": "client_port", ">A": "client_name", "<a": "server", "<p": "server_port", "<A": "server_name",
    ">la": "client_local_address", "la": "listening_address", ">lp": "client_local_port", "lp": "listening_port",
    "<la": "server_local_address", "oa": "server_local_address", "<lp": "server_local_port",
    "ts": "seconds", "tu": "milliseconds", "tl": "local_time", "tg": "gmt_time", "tS": "started", "tr": "elapsed",
    "<pt": "peer_elapsed", "<tt": "forwarding_elapsed", "dt": "dns_elapsed", "busy_time": "busy_time",
    "un": "user", "ul": "login", "ue": "external_user", "ui": "ident", "credentials": "credentials",
    ">Hs": "status", "Hs": "status", "<Hs": "server_status", "<bs": "server_body_size", "Ss": "result", "Sh": "hierarchy", "mt": "content_type",
    "rm": "method", "ru": "target", "rp": "path", "rv": "version", "rG": "target_group", ">v": "version",
    ">rm": "client_method", ">ru": "client_target", ">rs": "client_scheme", ">rd": "client_domain", ">rP": "client_target_port",
    ">rp": "client_path", ">rv": "client_version", "<rm": "server_method", "<ru": "server_target", "<rs": "server_scheme",
    "<rd": "server_domain", "<rP": "server_target_port", "<rp": "server_path", "<rv": "server_version",
    ">st": "request_size", ">sh": "request_header_size", "<st": "size", "<sH": "reply_high_offset", "<sS": "server_object_size",
    "<sh": "reply_header_size", "st": "total_size", "et": "acl_tag", "ea": "acl_log", "sn": "sequence", ">eui": "client_eui",
    ">qos": "client_tos", "<qos": "server_tos", ">nfmark": "client_mark", "<nfmark": "server_mark", ">handshake": "client_handshake",
    "err_code": "error_code", "err_detail": "error_detail", "request_attempts": "attempts", "note": "notes", "master_xaction": "transaction",
    ">h": "request_headers", "<h": "response_headers", ">ha": "adapted_request_headers",
    "adapt::all_trs": "adaptation_times", "adapt::sum_trs": "adaptation_sums",
    "icap::tr": "icap_elapsed", "icap::to": "icap_outcome", "icap::Hs": "icap_status", "icap::<st": "icap_size",
    "icap::rm": "icap_method", "icap::ru": "icap_target", "icap::<A": "icap_server", "icap::>st": "icap_request_size",
}
#: Codes that an argument in braces tells apart.
_ARGUED = (">h", "<h", ">ha", "note", "adapt::all_trs", "adapt::sum_trs")
#: Short names of two headers.
_HEADERS = {"{Referer}>h": "referer", "{User-Agent}>h": "agent"}
#: Built-in formats.
FORMATS = {
    "squid": "%ts.%03tu %6tr %>a %Ss/%03>Hs %<st %rm %ru %[un %Sh/%<a %mt",
    "common": '%>a - %[un [%tl] "%rm %ru HTTP/%rv" %>Hs %<st %Ss:%Sh',
    "combined": '%>a - %[un [%tl] "%rm %ru HTTP/%rv" %>Hs %<st "%{Referer}>h" "%{User-Agent}>h" %Ss:%Sh',
    "referrer": "%ts.%03tu %>a %{Referer}>h %ru",
    "useragent": '%>a [%tl] "%{User-Agent}>h"',
    "icap_squid": "%ts.%03tu %6icap::tr %>A %icap::to/%03icap::Hs %icap::<st %icap::rm %icap::ru %un -/%icap::<A -",
}
_CODE = re.compile(r"%(?:%|[-'#/\"\[]?(?:0?\d+)?(?:\.\d+)?(?P<arg>\{[^}]*\})?(?P<code>(?:[a-z]+::)?[<>]?[A-Za-z_]+))")


def _code_name(arg: str, run: str) -> tuple[str, str]:
    """The longest code that a run of letters begins with, and the name of its column."""
    for end in range(len(run), 0, -1):
        code = run[:end]
        if code in CODES:
            break
    else:
        raise ValueError(f"unknown format code %{arg}{run}")
    if arg and code in _ARGUED:
        name = re.sub(r"\W+", "_", arg[1:-1].lower()).strip("_")
        return code, _HEADERS.get(arg + code, f"{CODES[code].removesuffix('s')}_{name}")
    return code, CODES[code]


def layout_of(spec: str) -> str:
    """The format that a name, a ``logformat name format`` line or a format itself stands for."""
    m = re.match(r"logformat\s+\S+\s+(.*)$", spec.strip())
    return FORMATS.get(m[1] if m else spec.strip(), m[1] if m else spec.strip())


def compiled_format(layout: str) -> tuple[str, list[str]]:
    """A log format as one regular expression and the names of its groups.

    An item reaches to the literal behind it; white space in the format stands
    for any run of blanks.
    """
    out, names, at = "", [], 0
    layout = layout_of(layout)

    def literal(text: str) -> str:
        return re.sub(r"(?:\\ )+", r" +", re.escape(text))

    for m in _CODE.finditer(layout):
        out += literal(layout[at : m.start()])
        at = m.end()
        if m[0] == "%%":
            out += "%"
            continue
        code, name = _code_name(m["arg"] or "", m["code"])
        at = m.start("code") + len(code)
        follows = layout[at : at + 1]
        stop = follows if follows and follows != "%" else " "
        out += " *" if re.match(r"%\d", m[0]) and out.endswith("+") else ""
        out += "([^]]*)" if stop == "]" else f"([^{re.escape(stop)}]*)"
        names.append(name)
    return "^" + out + literal(layout[at:]) + "$", names


def time_arguments(layout: str) -> dict[str, str]:
    """The strftime formats of local_time and gmt_time in a log format, where it gives one."""
    found = {}
    for m in _CODE.finditer(layout_of(layout)):
        if m["arg"] and m["code"] in ("tl", "tg"):
            found[CODES[m["code"]]] = m["arg"][1:-1]
    return found


def proxy_records(lines: DataFrame, layout: str, line: str = "line") -> DataFrame:
    """Columns of proxy log lines under a format, with failed for lines that differ.

    instant is that of the seconds, else of local_time or gmt_time if their
    strftime format (or the usual one) fixes one; a local time without an
    offset gives none.
    """
    pattern, names = compiled_format(layout)
    out = lines.withColumn("__parts", line_parts(F.col(line), pattern, len(names)))
    part = {n: F.get("__parts", F.lit(i)) for i, n in enumerate(names)}
    out = out.withColumn("failed", F.col("__parts").isNull()).withColumns({n: F.when(c != "-", c) for n, c in part.items()}).drop("__parts")
    if "seconds" in part:
        ms = F.coalesce(F.col("milliseconds").cast("long"), F.lit(0)) if "milliseconds" in part else F.lit(0)
        return out.withColumn("instant", F.timestamp_millis(F.try_multiply(F.col("seconds").try_cast("long"), F.lit(1000)) + ms))
    formats = time_arguments(layout)
    for name in ("gmt_time", "local_time"):
        if name in part:
            time, zoned = strftime_time(F.col(name), formats.get(name, "%d/%b/%Y:%H:%M:%S %z"))
            if zoned or name == "gmt_time":
                return out.withColumn("instant", time)
    return out


#: What the conversions of strftime read, as expressions of one group each.
_CONVERSIONS = {
    "Y": r"(\d{4})", "y": r"(\d{2})", "C": r"(\d{2})", "m": r"(\d{2})", "d": r"(\d{2})", "e": r"([ \d]\d)", "j": r"(\d{3})",
    "H": r"(\d{2})", "k": r"([ \d]\d)", "I": r"(\d{2})", "l": r"([ \d]\d)", "M": r"(\d{2})", "S": r"(\d{2})", "p": "(AM|PM)",
    "b": "([A-Z][a-z]{2})", "h": "([A-Z][a-z]{2})", "B": "([A-Z][a-z]+)", "a": "([A-Z][a-z]{2})", "A": "([A-Z][a-z]+)",
    "z": r"([+-]\d{4})", "s": r"(\d+)", "u": "([1-7])", "w": "([0-6])", "Z": "([A-Za-z]+)",
}
#: Conversions that stand for others.
_COMPOSITES = {
    "c": "%a %b %e %H:%M:%S %Y", "D": "%m/%d/%y", "x": "%m/%d/%y", "F": "%Y-%m-%d", "r": "%I:%M:%S %p", "R": "%H:%M", "T": "%H:%M:%S", "X": "%H:%M:%S",
}
#: Names of the months.
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def strftime_time(text: Column, fmt: str) -> tuple[Column, bool]:
    """Time (zone-less; UTC if the format holds an offset or an epoch) of a text, and whether it does.

    ValueError if the format doesn't fix a time to the second.
    """
    for _ in range(2):
        fmt = re.sub(r"%[EO]?([cDxFrRTX])", lambda m: _COMPOSITES[m[1]], fmt)
    pattern, names, at = "", [], 0
    for m in re.finditer(r"%[EO]?(.)", fmt):
        pattern += re.escape(fmt[at : m.start()])
        at = m.end()
        if m[1] in "%nt":
            pattern += {"%": "%", "n": r"\n", "t": r"\t"}[m[1]]
        elif m[1] in _CONVERSIONS:
            pattern += _CONVERSIONS[m[1]]
            names.append(m[1])
        else:
            raise ValueError(f"unknown conversion %{m[1]}")
    parts = line_parts(text, f"^{pattern}{re.escape(fmt[at:])}$", len(names))
    have = {n: F.get(parts, F.lit(i)) for i, n in enumerate(names)}

    def number(*of: str) -> Column | None:
        return next((F.trim(have[n]).cast("int") for n in of if n in have), None)

    if "s" in have:
        return F.timestamp_add("SECOND", have["s"].try_cast("int"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")), True
    year, short = number("Y"), number("y")
    if year is None and short is not None:
        century = number("C")
        year = century * 100 + short if century is not None else short + F.when(short < 69, 2000).otherwise(1900)
    month, day = number("m"), number("d", "e")
    name = next((have[n] for n in ("b", "h", "B") if n in have), None)
    if month is None and name is not None:
        month = F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(name, 1, 3))), F.lit(0)).cast("int")
    in_year = number("j")
    hour, half = number("H", "k"), number("I", "l")
    if hour is None and half is not None and "p" in have:
        hour = half % 12 + F.when(have["p"] == "PM", 12).otherwise(0)
    minute, second = number("M"), number("S")
    if any(x is None for x in (year, hour, minute, second)) or ((month is None or day is None) and in_year is None):
        raise ValueError(f"{fmt} does not fix a time")
    if month is None or day is None:
        first = F.try_make_timestamp_ntz(year, F.lit(1), F.lit(1), hour, minute, second.cast("decimal(16,6)"))
        time = F.timestamp_add("DAY", in_year - 1, first)
        time = F.when(F.year(time) == year, time)
    else:
        time = F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)"))
    if "z" not in have:
        return time, False
    offset = F.substring(have["z"], 2, 2).cast("int") * 60 + F.substring(have["z"], 4, 2).cast("int")
    sign = F.when(F.startswith(have["z"], F.lit("-")), 1).otherwise(-1)
    return F.timestamp_add("MINUTE", sign * offset, time), True


#: The single values of an event and where they stand.
_EVENT_PARTS = {
    "provider": "/Event/System/Provider/@Name",
    "event_id": "/Event/System/EventID",
    "computer": "/Event/System/Computer",
    "record_number": "/Event/System/EventRecordID",
    "channel": "/Event/System/Channel",
    "instant": "/Event/System/TimeCreated/@SystemTime",
    "odd": "count(/Event/EventData/Data[text()][count(text()) != 1 or not(@Name)])",
}
_DATA_NAMES, _DATA_TEXTS = "/Event/EventData/Data[text()]/@Name", "/Event/EventData/Data/text()"


def event_records(xml: DataFrame, column: str = "xml") -> DataFrame:
    """provider, event_id, computer, record_number, instant and data of event XML.

    Every path that is asked for reads the whole text anew, so the single values
    are one path, between characters that no XML may hold, and so are the names
    and values of the data, which take turns where each value is one text with a name.
    """
    c = F.col(column)
    whole = F.xpath_string(c, F.lit("concat(" + ", '\x01', ".join(_EVENT_PARTS.values()) + ")"))
    out = xml.withColumn("__parts", F.split(whole, "\x01")).withColumn("__turns", F.xpath(c, F.lit(f"{_DATA_NAMES} | {_DATA_TEXTS}")))
    part = {n: F.nullif(F.get("__parts", F.lit(i)), F.lit("")) for i, n in enumerate(_EVENT_PARTS)}
    names, texts = F.filter("__turns", lambda _, i: i % 2 == 0), F.filter("__turns", lambda _, i: i % 2 == 1)
    apart = F.map_from_arrays(F.xpath(c, F.lit(_DATA_NAMES)), F.xpath(c, F.lit(_DATA_TEXTS)))
    return out.withColumns(
        {
            "provider": part["provider"],
            "event_id": part["event_id"].cast("int"),
            "computer": part["computer"],
            "record_number": part["record_number"].cast("long"),
            "channel": part["channel"],
            "instant": F.try_to_timestamp(part["instant"]),
            "data": F.when(part["odd"] == "0", F.map_from_arrays(names, texts)).otherwise(apart),
        }
    ).drop("__parts", "__turns")


def rename_of(events: DataFrame) -> DataFrame:
    """(previous, current) names of a machine from its rename events."""
    # fixed values: the event that records a computer's new name
    return events.where("provider = 'EventLog' and event_id = 6011").select(
        F.element_at("data", "OldName").alias("previous"), F.element_at("data", "NewName").alias("current")
    )


def redacted(column: Column) -> Column:
    """XML without the contents of credential passwords."""
    return F.regexp_replace(column, r"(?s)(<(Credential)?Password>).*?(</(Credential)?Password>)", "$1$3")


def connection_objects(xml: DataFrame, column: str = "xml") -> DataFrame:
    """name, host, port and redacted text of remote connection objects."""
    c = redacted(F.col(column))

    def text(tag: str) -> Column:
        return F.nullif(F.xpath_string(c, F.lit(f"/*/{tag}")), F.lit(""))

    return xml.withColumns({column: c, "name": text("Name"), "host": text("URI"), "port": text("Port").cast("int")})


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in which no control character is left in a string."""
    clean = {c: sanitized(F.col(c)) for c, t in df.dtypes if t == "string"}
    df.withColumns(clean).write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, for spreadsheets."""
    df.write.option("header", True).csv(path)
