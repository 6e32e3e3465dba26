"""Filter texts as column expressions, so that Catalyst pushes them to the scan.

Missing values compare as unequal and `not` makes that true, so leaves are null-safe.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.errors import FilterSyntaxError
from ..functions.ip import ip_key, key_of, key_range

PROTOS = {"tcp": "Tcp", "udp": "Udp", "icmp": "Icmp"}
APPS = {"http": "Http", "https": "Https", "dns": "Dns", "ssh": "Ssh", "ftp": "Ftp"}
#: Key of an atom: (columns of which one must be equal, position that a bad value is reported at).
VALUES = {"ip.src": (["src_ip"], 7), "ip.dst": (["dst_ip"], 7), "port": (["src_port", "dst_port"], 7), "src.port": (["src_port"], 11), "dst.port": (["dst_port"], 11)}


def accept_all() -> Column:
    return F.lit(True)


def is_ip(column: str, text: str) -> Column:
    """Null-safe equality with an address in any spelling; IPv4 compares as text, which reaches the scan."""
    key = key_of(text)
    if key[0] == "4":
        return F.col(column).eqNullSafe(str(ipaddress.ip_address(text)))
    return ip_key(F.col(column)).eqNullSafe(key)


def display_filter(text: str, parens: bool = False) -> Column:
    """A predicate over packets.

    `or` binds least, then `and`, then a leading `not `; atoms are tcp, udp, icmp, http, https,
    dns, ssh, ftp, `ip.src == A`, `ip.dst == A`, `port == N`, `src.port == N`, `dst.port == N`.
    With parens, a whole part may stand in parentheses; without, parentheses only keep what
    they enclose from being split, as users of the plain grammar expect, and are an error then.
    """
    if not text.isascii():
        raise FilterSyntaxError(next(i for i, c in enumerate(text) if ord(c) > 127), "only ASCII is allowed")
    return parsed(text.strip(), parens)


def parsed(text: str, parens: bool) -> Column:
    for word, join in ((" or ", lambda a, b: a | b), (" and ", lambda a, b: a & b)):
        at = split_at(text, word)
        if at >= 0:
            return join(parsed(text[:at].strip(), parens), parsed(text[at + len(word) :].strip(), parens))
    if text.startswith("not "):
        return ~parsed(text[4:].strip(), parens)
    if parens and text.startswith("(") and text.endswith(")") and text:
        return parsed(text[1:-1].strip(), parens)
    return atom(text)


def split_at(text: str, word: str) -> int:
    """The first place of word outside parentheses."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0 and text.startswith(word, i):
            return i
    return -1


def atom(text: str) -> Column:
    if text in PROTOS:
        return F.col("l4").eqNullSafe(PROTOS[text])
    if text in APPS:
        return F.col("app").eqNullSafe(APPS[text])
    name, found, value = text.partition(" == ")
    if not found or name not in VALUES:
        raise FilterSyntaxError(0, f"unknown: {text!r}")
    columns, pos = VALUES[name]
    value = value.strip()
    if name.startswith("ip."):
        try:
            return is_ip(columns[0], value)
        except ValueError:
            raise FilterSyntaxError(pos, f"not an address: {value!r}") from None
    if not re.fullmatch(r"\+?[0-9]+", value) or int(value) > 65535:
        raise FilterSyntaxError(pos, f"not a port: {value!r}")
    out = F.col(columns[0]).eqNullSafe(int(value))
    for c in columns[1:]:
        out = out | F.col(c).eqNullSafe(int(value))
    return out


def capture_filter(text: str) -> Column:
    """A predicate from a subset of the capture filter language.

    Primitives: tcp, udp, icmp, icmp6, ip, ip6; [proto] [src|dst] host A, port N, portrange N-M,
    net A/LEN; and, or, not (also &&, ||, !) with parentheses. `and` and `or` bind alike, from
    left to right; `not` binds tightest. The empty text accepts all.
    """
    tokens = re.findall(r"\(|\)|&&|\|\||!|[^\s()!&|]+", text)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise FilterSyntaxError(len(text), "the filter ends too soon")
        at += 1
        return tokens[at - 1]

    def expression() -> Column:
        left = unary()
        while peek() in ("and", "or", "&&", "||"):
            both = take() in ("and", "&&")
            right = unary()
            left = left & right if both else left | right
        return left

    def unary() -> Column:
        if peek() in ("not", "!"):
            take()
            return ~unary()
        if peek() == "(":
            take()
            inner = expression()
            if take() != ")":
                raise FilterSyntaxError(len(text), "missing )")
            return inner
        return primitive()

    def primitive() -> Column:
        out: Column | None = None
        word = take()
        kinds = {"tcp": ("l4", "Tcp"), "udp": ("l4", "Udp"), "icmp": ("l4", "Icmp"), "icmp6": ("l4", "IcmpV6"), "ip": ("l3", "IPv4"), "ip6": ("l3", "IPv6")}
        if word in kinds:
            column, value = kinds[word]
            out = F.col(column).eqNullSafe(value)
            if peek() not in ("src", "dst", "host", "port", "portrange", "net"):
                return out
            word = take()
        sides = ["src", "dst"]
        if word in sides:
            sides = [word]
            word = take()
        make: dict[str, Callable[[str, str], Column]] = {"host": host, "port": port, "portrange": portrange, "net": net}
        if word not in make:
            raise FilterSyntaxError(text.find(word), f"unknown: {word!r}")
        value = take()
        try:
            found = [make[word](side, value) for side in sides]
        except ValueError:
            raise FilterSyntaxError(text.find(value), f"bad value: {value!r}") from None
        either = found[0] if len(found) == 1 else found[0] | found[1]
        return either if out is None else out & either

    def host(side: str, value: str) -> Column:
        return is_ip(f"{side}_ip", value)

    def number(value: str) -> int:
        if not value.isdigit() or int(value) > 65535:
            raise ValueError(value)
        return int(value)

    def port(side: str, value: str) -> Column:
        return F.col(f"{side}_port").eqNullSafe(number(value))

    def portrange(side: str, value: str) -> Column:
        low, _, high = value.partition("-")
        return F.coalesce(F.col(f"{side}_port").between(number(low), number(high)), F.lit(False))

    def net(side: str, value: str) -> Column:
        low, high, _ = key_range(value)
        return F.coalesce(ip_key(F.col(f"{side}_ip")).between(low, high), F.lit(False))

    if not tokens:
        return accept_all()
    out = expression()
    if at < len(tokens):
        raise FilterSyntaxError(text.find(tokens[at]), f"unexpected: {tokens[at]!r}")
    return out
