"""DNS question names and TLS server names, in Arrow-batched functions: both walk variable-length data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_POINTERS, MOST_NAME = 10, 254


def dns_name(message: bytes, at: int = 12) -> tuple[str | None, int]:
    """(name, where it ends in the message) or (None, 0); pointers are followed up to MOST_POINTERS."""
    labels, size, jumps, end = [], 0, 0, None
    while True:
        if at >= len(message):
            return None, 0
        n = message[at]
        if n == 0:
            return b".".join(labels).decode("utf-8", "replace"), (at + 1 if end is None else end)
        if n & 0xC0 == 0xC0:
            jumps += 1
            if at + 1 >= len(message) or jumps > MOST_POINTERS:
                return None, 0
            end = at + 2 if end is None else end
            at = (n & 0x3F) << 8 | message[at + 1]
            continue
        if at + 1 + n > len(message) or size + n + 1 >= MOST_NAME:
            return None, 0
        labels.append(message[at + 1 : at + 1 + n])
        size += n + 1
        at += 1 + n


def dns_query(message: bytes | None) -> str | None:
    if message is None or len(message) < 12 or not int.from_bytes(message[4:6], "big"):
        return None
    return dns_name(message)[0]


def client_hello(record: bytes | None, compat: bool = False) -> dict | None:
    """content_type, version, length; and of a ClientHello its server_name and highest offered version.

    With compat the last offered version is passed over, as some tools do.
    """
    if record is None or len(record) < 5:
        return None
    length = int.from_bytes(record[3:5], "big")
    if 5 + length > len(record):
        return None
    out = {"content_type": record[0], "version": int.from_bytes(record[1:3], "big"), "length": length, "is_client_hello": False, "server_name": None, "highest_version": 0}
    body = record[5 : 5 + length]
    if record[0] != 22 or len(body) < 4 or body[0] != 1 or 4 + int.from_bytes(body[1:4], "big") > len(body):
        return out
    out["is_client_hello"] = True
    body = body[: 4 + int.from_bytes(body[1:4], "big")]
    at = 38  # after the version and the random bytes
    for width in (1, 2, 1):  # session, cipher suites, compression methods
        if at + width > len(body):
            return out
        at += width + int.from_bytes(body[at : at + width], "big")
        if at > len(body):
            return out
    if at + 2 > len(body):
        return out
    end = min(len(body), at + 2 + int.from_bytes(body[at : at + 2], "big"))
    at += 2
    while at + 4 <= end:
        kind, size = int.from_bytes(body[at : at + 2], "big"), int.from_bytes(body[at + 2 : at + 4], "big")
        data = body[at + 4 : at + 4 + size]
        if len(data) < size:
            break
        if kind == 0 and size >= 5 and data[2] == 0:
            n = int.from_bytes(data[3:5], "big")
            if 5 + n <= size and n < 256:
                out["server_name"] = data[5 : 5 + n].decode("utf-8", "replace") or None
        if kind == 43 and size >= 1:
            offered = data[1 : 1 + data[0]]
            pairs = [int.from_bytes(offered[i : i + 2], "big") for i in range(0, len(offered) - 1, 2)]
            out["highest_version"] = max(pairs[: len(pairs) - 1] if compat else pairs, default=0)
        at += 4 + size
    return out


TLS = "content_type int, version int, length int, is_client_hello boolean, server_name string, highest_version int"


@F.pandas_udf(T.StringType())
def dns_query_name(messages: pd.Series) -> pd.Series:
    """The first question's name, null if there is none or it is broken."""
    return messages.map(dns_query)


def tls_fields(records: Column, compat: bool = False) -> Column:
    """A struct of TLS, null if the record is not whole."""

    @F.pandas_udf(TLS)
    def read(values: pd.Series) -> pd.DataFrame:
        rows = [client_hello(v, compat) or {} for v in values]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in TLS.split(", ")]).astype({"content_type": "Int32", "version": "Int32", "length": "Int32", "highest_version": "Int32", "is_client_hello": "boolean"})

    got = read(records)
    return F.when(got["content_type"].isNotNull(), got)


def tls_server_name(records: Column) -> Column:
    return tls_fields(records)["server_name"]
