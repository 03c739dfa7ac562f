"""Scalar functions over record values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The states in which a value can be compared.
COMPARABLE_STATES = ("present", "derived")


def comparable(state: Column, normalized: Column, raw: Column) -> Column:
    """The normalised value, else the raw one; null in any state that is not comparable."""
    return F.when(state.isin(*COMPARABLE_STATES), F.coalesce(normalized, raw))


def identity_digest(*parts: Column) -> Column:
    """SHA-256 over the parts, each preceded by its length as 8 big-endian bytes."""

    def framed(p: Column) -> Column:
        text = F.encode(p, "UTF-8")
        size = F.unhex(F.lpad(F.hex(F.octet_length(text)), 16, "0"))
        return F.concat(size, text)

    return F.sha2(F.concat(*map(framed, parts)), 256)


def logon_id(value: Column) -> Column:
    """A hexadecimal logon id in lower case without leading zeros; else null."""
    digits = F.regexp_extract(value, r"^0[xX]0*([0-9a-fA-F]{1,16})$", 1)
    return F.when(digits != "", F.concat(F.lit("0x"), F.lower(digits)))


def logon_guid(value: Column) -> Column:
    """A GUID without its braces, in lower case; null if it is not one or all zeros."""
    bare = F.when(value.rlike(r"^\{.*\}$"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    low = F.lower(bare)
    shape = low.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return F.when(shape & ~low.rlike("^[0-]+$"), low)


def path_key(path: Column) -> Column:
    """Windows paths compare in lower case; others as they are."""
    return F.when(path.rlike(r"^([A-Za-z]:\\|\\\\)"), F.lower(path)).otherwise(path)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def short_hostname(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", 1))


def same_host(name: Column, other: Column) -> Column:
    """Equal without case, or one is the other's short name."""
    a, b = F.lower(name), F.lower(other)
    short = ~a.contains(".") | ~b.contains(".")
    return (a == b) | (short & (F.substring_index(a, ".", 1) == F.substring_index(b, ".", 1)))


def account_key(sid: Column, domain: Column, name: Column) -> Column:
    """A domain account's SID, else DOMAIN\\name in lower case, split off the name if need be."""
    joined = name.contains("\\")
    d = F.when(domain.isNull() & joined, F.substring_index(name, "\\", 1)).otherwise(domain)
    n = F.when(joined, F.substring_index(name, "\\", -1)).otherwise(name)
    by_name = F.when(d.isNotNull() & n.isNotNull(), F.lower(F.concat_ws("\\", d, n)))
    return F.coalesce(F.when(sid.rlike(r"^S-1-5-21(-[0-9]+)+$"), sid), by_name)


def decimal_of_hex(value: Column) -> Column:
    """0x-prefixed hexadecimal as decimal digits; decimal digits without leading zeros."""
    hexed = F.regexp_extract(value, "^0[xX]([0-9a-fA-F]+)$", 1)
    plain = F.regexp_replace(value, "^0+(?=[0-9])", "")
    return F.when(hexed != "", F.conv(hexed, 16, 10)).when(value.rlike("^[0-9]+$"), plain)


def filetime(ticks: Column) -> Column:
    """Timestamp of 100-nanosecond ticks since 1601; 0 is none."""
    # fixed value: seconds from 1601 to 1970
    return F.when(ticks != 0, F.timestamp_micros(F.floor(ticks / 10) - F.lit(11644473600000000)))


def machine_accounts(text: Column) -> Column:
    """Names that end in $ in free text, but the administrative shares."""
    names = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9-]*\$)"), F.lit(1))
    # fixed values: names of administrative shares
    shares = F.array(*map(F.lit, ("ADMIN$", "IPC$", "PRINT$", "C$", "D$", "E$")))
    return F.filter(F.array_distinct(names), lambda n: ~F.array_contains(shares, F.upper(n)))


def sanitized(text: Column) -> Column:
    """Control characters as \\xNN for each of their UTF-8 bytes."""

    def shown(c: Column) -> Column:
        code = F.lower(F.hex(F.encode(c, "UTF-8")))
        return F.when(c.rlike(r"\p{Cc}"), F.regexp_replace(code, "(..)", r"\\x$1")).otherwise(c)

    spelt = F.array_join(F.transform(F.split(text, ""), shown), "")
    return F.when(text.rlike(r"\p{Cc}"), spelt).otherwise(text)


def encoded_command(command: Column) -> Column:
    """Text of a command line's base64 UTF-16LE argument; null without one."""
    # fixed pattern: any beginning of the switch name counts
    words = F.split(command, r"\s+")
    switch = r"(?i)^[-/]e(n(c(o(d(e(d(c(o(m(m(a(n(d)?)?)?)?)?)?)?)?)?)?)?)?)?$"
    at = F.array_position(F.transform(words, lambda w: w.rlike(switch)), F.lit(True))
    raw = F.when(at > 0, F.get(words, at.cast("int")))
    binary = F.try_to_binary(raw, F.lit("base64"))
    return F.when(raw.rlike("^[A-Za-z0-9+/]+={0,2}$"), F.decode(binary, "UTF-16LE"))


def fragment_alphabet(text: Column) -> Column:
    std, url = text.rlike("[+/]"), text.rlike("[-_]")
    return F.when(std & ~url, "base64").when(url & ~std, "base64url").otherwise("undetermined")


def numbered_fragment(path: Column) -> Column:
    """number and token of a path /N/token; null without one."""
    n = F.regexp_extract(path, r"/([0-9]{1,9})/([A-Za-z0-9+_=-]+)$", 1)
    token = F.regexp_extract(path, r"/([0-9]{1,9})/([A-Za-z0-9+_=-]+)$", 2)
    return F.when(n != "", F.struct(n.cast("long").alias("number"), token.alias("token")))


def rounded_significant(value: Column, digits: int = 10) -> Column:
    """Value rounded to significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, 0.0).otherwise(F.rint(value * scale) / scale)
