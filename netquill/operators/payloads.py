"""Classification of payloads by their first bytes; the first rule that matches wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HTTP_STARTS = ["GET ", "POST ", "HEAD ", "PUT ", "HTTP/"]


def starts(payload: Column, prefix: bytes) -> Column:
    return F.substring(payload, 1, len(prefix)) == F.lit(bytearray(prefix))


def on_port(port: int, src: str, dst: str) -> Column:
    return F.col(src).eqNullSafe(port) | F.col(dst).eqNullSafe(port)


def classify(payload: Column, src_port: str = "src_port", dst_port: str = "dst_port") -> Column:
    """A struct of protocol and confidence, or null for unknown."""
    size = F.coalesce(F.length(payload), F.lit(0))
    found = lambda protocol, confidence: F.struct(F.lit(protocol).alias("protocol"), F.lit(confidence).alias("confidence"))
    http = F.lit(False)
    for prefix in HTTP_STARTS:
        http = http | starts(payload, prefix.encode())
    version = F.substring(payload, 2, 4)
    first = F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).cast("int")
    quic = (size >= 5) & (first.bitwiseAND(0xC0) == 0xC0) & ((version == F.lit(bytearray(b"\0\0\0\1"))) | (F.substring(payload, 2, 3) == F.lit(bytearray(b"\xff\0\0"))))
    return (
        F.when(http, found("HTTP", "High"))
        .when((size >= 3) & starts(payload, b"\x16\x03"), found("TLS", "High"))
        .when((size >= 12) & on_port(53, src_port, dst_port), found("DNS", "Medium"))
        .when(starts(payload, b"SSH-"), found("SSH", "High"))
        .when(quic, found("QUIC", "High"))
        .when((size >= 4) & starts(payload, b"\1\0\0\0") & on_port(51820, src_port, dst_port), found("WireGuard", "Medium"))
    )
