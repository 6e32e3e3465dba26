"""IP addresses as sortable keys, ranges and text, all in Spark expressions.

The key of an address is '4' or '6' and its bytes in lower-case hex. Keys sort as addresses
do: IPv4 before IPv6, then by number, which the addresses' text does not.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value written once in the plan, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def v4_key(ip: Column) -> Column:
    """'4' and eight hex digits, or null if ip is not four plain numbers up to 255."""
    number = "^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
    digits = lambda p: F.array_join(F.transform(p, lambda x: F.lpad(F.lower(F.hex(x.try_cast("int"))), 2, "0")), "")
    return let(F.split(F.trim(ip), r"\."), lambda p: F.when(F.size(p) == 4, F.when(F.forall(p, lambda x: x.rlike(number)), F.concat(F.lit("4"), digits(p)))))


def v6_key(ip: Column) -> Column:
    """'6' and 32 hex digits, or null; '::' and a last part in IPv4 form are understood."""
    dotted = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"

    def plain(s: Column) -> Column:
        tail = v4_key(F.regexp_extract(s, f"({dotted})", 1))
        return F.when(F.contains(s, F.lit(".")), let(tail, lambda k: F.concat(F.regexp_replace(s, dotted, ""), F.substring(k, 2, 4), F.lit(":"), F.substring(k, 6, 4)))).otherwise(s)

    def key(s: Column) -> Column:
        side = lambda n: F.when(F.substring_index(s, "::", n) == "", F.array().cast("array<string>")).otherwise(F.split(F.substring_index(s, "::", n), ":"))
        both = F.struct(side(1).alias("l"), side(-1).alias("r"))
        filled = let(both, lambda x: F.when(F.size(x["l"]) + F.size(x["r"]) <= 7, F.concat(x["l"], F.array_repeat(F.lit("0"), 8 - F.size(x["l"]) - F.size(x["r"])), x["r"])))
        groups = F.when(s.rlike("::.*::|:::"), F.lit(None)).when(F.contains(s, F.lit("::")), filled).otherwise(F.split(s, ":"))
        joined = lambda g: F.concat(F.lit("6"), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))
        return let(groups, lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), joined(g)))

    return let(let(F.lower(F.trim(ip)), plain), key)


def ip_key(ip: Column) -> Column:
    """The key of an IPv4 or IPv6 address, null if it is neither."""
    return F.when(F.contains(ip, F.lit(":")), v6_key(ip)).otherwise(v4_key(ip))


def v6_text(digits: Column) -> Column:
    """Text of 32 hex digits: no leading zeros, the longest run of zero groups as '::'."""
    groups = [F.regexp_replace(F.substring(digits, 4 * i + 1, 4), "^0{1,3}", "") for i in range(8)]

    def shortened(full: Column) -> Column:
        out = full
        for n in range(2, 9):  # the longest is tried first: it is the outermost
            pattern = rf"^((?:[0-9a-f]+:)*?)0(?::0){{{n - 1}}}(?=:|$)"
            out = F.when(full.rlike(pattern), F.regexp_replace(F.regexp_replace(full, pattern, "$1::"), ":{3,}", "::")).otherwise(out)
        return out

    return let(F.lower(F.concat_ws(":", *groups)), shortened)


def key_of(text: str) -> str:
    """The key of one address, on the driver; ValueError if it is none."""
    ip = ipaddress.ip_address(text)
    return f"{ip.version}{ip.packed.hex()}"


def key_range(cidr: str) -> tuple[str, str, int]:
    """Lowest and highest key of a network, and its prefix length."""
    net = ipaddress.ip_network(cidr, strict=False)
    return f"{net.version}{net.network_address.packed.hex()}", f"{net.version}{net.broadcast_address.packed.hex()}", net.prefixlen


def key_prefix(key: Column, bits: Column) -> Column:
    """A key cut to its first bits, as text that is equal for addresses of the same network.

    Whole hex digits are kept; the digit that the prefix cuts keeps its upper bits.
    """
    whole = F.floor(bits / 4).cast("int")
    part = (bits % 4).cast("int")
    digit = F.conv(F.substring(key, whole + 2, F.lit(1)), 16, 10).cast("int")
    kept = F.when(part == 0, F.lit("")).otherwise(F.lower(F.hex(digit - digit % F.pow(F.lit(2), 4 - part).cast("int"))))
    return F.concat(F.substring(key, F.lit(1), whole + 1), F.lit("/"), bits.cast("string"), F.lit("/"), kept)
