"""Predicates of IPv4 and IPv6 addresses without any user-defined function."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_V4 = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"


def is_ip(text: Column) -> Column:
    """Whether the text is an IP literal: IPv4, or IPv6 by its form."""
    return text.rlike(_V4) | (text.rlike(r"^\[?[0-9a-fA-F:.]+\]?$") & text.contains(":"))


def ipv4(text: Column) -> Column:
    """The address as a number; null if it is not IPv4."""
    part = F.split(text, r"\.")
    number = sum(F.get(part, F.lit(k)).cast("long") * F.lit(256 ** (3 - k)) for k in range(4))
    return F.when(text.rlike(_V4), number)


def ipv6(text: Column) -> Column:
    """The address as 32 hexadecimal digits; null if it is not IPv6 in hexadecimal groups."""
    halves = F.split(F.lower(F.regexp_replace(text, r"^\[|\]$", "")), "::")
    left, right = (F.filter(F.split(F.coalesce(F.get(halves, F.lit(k)), F.lit("")), ":"), lambda g: g != "") for k in (0, 1))
    given = F.size(left) + F.size(right)
    whole = F.when(F.size(halves) == 2, given < 8).otherwise((F.size(halves) == 1) & (given == 8))
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), right)
    shape = text.rlike(r"^\[?[0-9A-Fa-f:]+\]?$") & ~text.rlike(r"(^|[^:]):\]?$|^\[?:([^:]|$)|:::")
    digits = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(shape & whole & F.forall(groups, lambda g: F.length(g) <= 4), digits)


def in_cidr(text: Column, cidr: str) -> Column:
    """Whether an address lies in the block; false if it is of the other family or none."""
    block = ipaddress.ip_network(cidr, strict=False)
    if block.version == 4:
        size = 32 - block.prefixlen
        hit = F.shiftright(ipv4(text), size) == F.lit(int(block.network_address) >> size)
    else:
        first = f"{int(block.network_address):032x}"
        whole, rest = divmod(block.prefixlen, 4)
        hit = F.startswith(ipv6(text), F.lit(first[:whole]))
        if rest:
            digit = F.conv(F.substr(ipv6(text), F.lit(whole + 1), F.lit(1)), 16, 10).cast("int")
            hit = hit & (F.shiftright(digit, 4 - rest) == F.lit(int(first[whole], 16) >> (4 - rest)))
    return F.coalesce(hit, F.lit(False))


def passes_blocks(kind: Column, text: Column, inside: str | None = None, outside: str | None = None) -> Column:
    """Whether a node passes the address blocks of a search; only ip nodes are asked, unreadable ones fail."""
    out = ipv4(text).isNotNull() | ipv6(text).isNotNull()
    if inside:
        out = out & in_cidr(text, inside)
    if outside:
        out = out & ~in_cidr(text, outside)
    return F.when(kind == "ip", out).otherwise(F.lit(True)) if inside or outside else F.lit(True)


#: Blocks that stay on the terminal itself.
LOCAL_BLOCKS = ("127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/32")
#: Further blocks that name no other terminal.
GROUP_BLOCKS = ("224.0.0.0/4", "255.255.255.255/32")


def terminal_local(text: Column) -> Column:
    out = F.lit(False)
    for block in LOCAL_BLOCKS:
        out = out | in_cidr(text, block)
    return out


def reaches_another(text: Column) -> Column:
    """Whether the address can be another terminal's."""
    out = text.rlike(_V4) & ~terminal_local(text)
    for block in GROUP_BLOCKS:
        out = out & ~in_cidr(text, block)
    return out
