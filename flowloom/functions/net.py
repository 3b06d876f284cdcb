"""Addresses, session keys and small scalar rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


_V4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def _v4(ip: Column) -> Column:
    part = lambda i: F.split(ip, r"\.")[i].try_cast("bigint")
    return ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value's expression in the plan once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _groups(text: Column) -> Column:
    return F.filter(F.split(text, ":"), lambda g: g != "")


def _v6_hex(low: Column) -> Column:
    """32 digits of an IPv6 text in lower case without IPv4 part, or null."""

    def whole(halves: Column) -> Column:
        left, right = _groups(halves[0]), _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        lacking = F.lit(8) - F.size(left) - F.size(right)
        return F.when((F.size(halves) == 2) & (lacking >= 1), F.concat(left, F.array_repeat(F.lit("0"), lacking), right)).when((F.size(halves) == 1) & (lacking == 0), left)

    digits = lambda gs: F.when(F.forall(gs, lambda g: F.length(g) <= 4), F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(low.rlike("^(?!.*:::)[0-9a-f:]*:[0-9a-f:]*:[0-9a-f:]*$"), _let(_let(F.split(low, "::", -1), whole), digits))


def ip_hex(ip: Column) -> Column:
    """An address as 32 hexadecimal digits, whose order is that of the numbers; null for null and what is no address.

    IPv6 with one `::` at most, a zone after % left out, the last 32 bits in hexadecimal or as IPv4.
    """
    tail = r"(?:\d{1,3}\.){3}\d{1,3}$"

    def any_hex(low: Column) -> Column:
        four = lambda h: F.concat(F.regexp_replace(low, tail, ""), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4))
        mixed = _let(F.lpad(F.lower(F.hex(_v4(F.regexp_extract(low, tail, 0)))), 8, "0"), four)
        return F.when(low.rlike(_V4), F.lpad(F.lower(F.hex(_v4(low))), 32, "0")).otherwise(_let(F.when(low.rlike(":" + tail), mixed).otherwise(low), _v6_hex))

    return _let(F.lower(F.regexp_replace(F.trim(ip), "%.*$", "")), any_hex)


def _ranked(ip: Column) -> Column:
    """(order, text) of an address in session keys: IPv4 as its number, IPv6 as 32 hexadecimal digits, anything else by crc32 (stable across runs)."""
    other = lambda n: F.struct(F.lpad(F.lower(F.hex(n)), 32, "0").alias("o"), n.cast("string").alias("n"))
    found = lambda h: F.when(h.isNull(), _let(F.crc32(ip.cast("binary")), other)).otherwise(F.struct(h.alias("o"), F.when(ip.rlike(_V4), _v4(ip).cast("string")).otherwise(h).alias("n")))
    return F.when(ip.isNotNull(), _let(ip_hex(ip), found))


def address_columns(columns: list[str]) -> tuple[str, str, str, str]:
    """Source and destination address and port columns: source_*/destination_* if whole, else src_*/dst_*."""
    for a, b in (("source", "destination"), ("src", "dst")):
        names = (f"{a}_ip", f"{b}_ip", f"{a}_port", f"{b}_port")
        if set(names) <= set(columns):
            return names
    raise KeyError("no complete pair of address and port columns")


def session_key(columns: list[str]) -> Column:
    """min(ip)_max(ip)_protocol_min(port)_max(port); both directions of a flow get one key.

    Addresses are ordered by value: IPv4 and IPv6 alike, texts that are no address by their crc32; nulls are left out.
    """
    sip, dip, sport, dport = address_columns(columns)
    p, q = F.col(sport).try_cast("bigint"), F.col(dport).try_cast("bigint")
    protocol = F.col("protocol").cast("string") if "protocol" in columns else F.lit("0")
    key = lambda a, b: F.concat_ws("_", a, b, protocol, F.least(p, q), F.greatest(p, q))
    a, b = _v4(F.col(sip)), _v4(F.col(dip))
    other = lambda two: key(F.array_min(two)["n"], F.array_max(two)["n"])
    return F.when(F.col(sip).rlike(_V4) & F.col(dip).rlike(_V4), key(F.least(a, b), F.greatest(a, b))).otherwise(_let(F.transform(F.array(F.col(sip), F.col(dip)), _ranked), other))


def no_nan(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """NaN and both infinities as null."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)
