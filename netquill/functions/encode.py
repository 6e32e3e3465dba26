"""Frames and messages made from columns: the reverse of decode and names, for fixtures and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decode import checksum

PROTOCOLS = {"Tcp": 6, "Udp": 17, "Icmp": 1}


def big_endian(value: Column, n: int) -> Column:
    """n bytes, as hex text."""
    return F.lpad(F.hex(F.coalesce(value, F.lit(0)).cast("bigint")), 2 * n, "0")


def fixed(*values: tuple[int, int]) -> Column:
    return F.lit("".join(f"{v:0{2 * n}x}" for v, n in values))


def frame(payload_hex: Column) -> Column:
    """An Ethernet frame of a packet (IPv4; TCP, UDP or ICMP; checksums 0) with this payload."""
    flags = sum((F.when(F.col(c), F.lit(mask)).otherwise(F.lit(0)) for c, mask in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32))), F.lit(0))
    ports = F.concat(big_endian(F.col("src_port"), 2), big_endian(F.col("dst_port"), 2))
    body_size = F.length(payload_hex) / 2
    tcp = F.concat(ports, big_endian(F.col("tcp_seq"), 4), fixed((0, 4), (0x50, 1)), big_endian(flags, 1), fixed((1024, 2), (0, 2), (0, 2)))
    udp = F.concat(ports, big_endian(body_size + 8, 2), fixed((0, 2)))
    top = F.when(F.col("l4") == "Tcp", tcp).when(F.col("l4") == "Udp", udp).otherwise(fixed((8, 1), (0, 1), (0, 2), (1, 4)))
    number = F.when(F.col("l4") == "Tcp", 6).when(F.col("l4") == "Udp", 17).otherwise(1)
    address = lambda c: F.array_join(F.transform(F.split(c, r"\."), lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")), "")
    body = F.concat(top, payload_hex)
    ip = F.concat(fixed((0x45, 1), (0, 1)), big_endian(F.length(body) / 2 + 20, 2), fixed((0, 4)), big_endian(F.col("ttl"), 1), big_endian(number, 1), fixed((0, 2)), address("src_ip"), address("dst_ip"))
    return F.unhex(F.concat(fixed((0xAA, 6), (0xBB, 6), (0x0800, 2)), ip, body))


def dns_question(name: Column) -> Column:
    """A query message for a name."""
    labels = F.transform(F.split(name, r"\."), lambda x: F.concat(big_endian(F.octet_length(x), 1), F.hex(x)))
    return F.unhex(F.concat(fixed((7, 2), (0x0100, 2), (1, 2), (0, 2), (0, 2), (0, 2)), F.array_join(labels, ""), fixed((0, 1), (1, 2), (1, 2))))


def hello(name: Column) -> Column:
    """A TLS record with a ClientHello for a server name, offering versions 1.2 and 1.3."""
    size = F.octet_length(name)
    server = F.concat(fixed((0, 2)), big_endian(size + 5, 2), big_endian(size + 3, 2), fixed((0, 1)), big_endian(size, 2), F.hex(name))
    extensions = F.concat(server, fixed((43, 2), (5, 2), (4, 1), (0x0303, 2), (0x0304, 2)))
    body = F.concat(fixed((0x0303, 2), (0, 32), (0, 1), (2, 2), (0x1301, 2), (1, 1), (0, 1)), big_endian(F.length(extensions) / 2, 2), extensions)
    return F.unhex(F.concat(fixed((22, 1), (0x0301, 2)), big_endian(F.length(body) / 2 + 4, 2), fixed((1, 1)), big_endian(F.length(body) / 2, 3), body))


def with_checksum(frame: Column, wrong: Column) -> Column:
    """An untagged IPv4 frame with the header checksum filled in, off by one bit where wrong."""
    right = checksum(F.substring(frame, 15, 20))
    value = F.when(wrong, right.bitwiseXOR(F.lit(0x0100).cast("bigint"))).otherwise(right)
    return F.concat(F.substring(frame, 1, 24), F.unhex(big_endian(value, 2)), F.substring(frame, F.lit(27), F.length(frame)))


def frame6(src: Column, dst: Column, payload_hex: Column, tags: Column, vlan: Column) -> Column:
    """An Ethernet frame of a packet over IPv6 between addresses of 32 hex digits, with so many VLAN tags, of which the innermost has this number."""
    tcp = F.concat(big_endian(F.col("src_port"), 2), big_endian(F.col("dst_port"), 2), big_endian(F.col("tcp_seq"), 4), fixed((0, 4), (0x50, 1), (0, 1), (1024, 2), (0, 2), (0, 2)))
    udp = F.concat(big_endian(F.col("src_port"), 2), big_endian(F.col("dst_port"), 2), big_endian(F.length(payload_hex) / 2 + 8, 2), fixed((0, 2)))
    top = F.when(F.col("l4") == "Tcp", tcp).when(F.col("l4") == "Udp", udp).otherwise(fixed((128, 1), (0, 1), (0, 2), (1, 4)))
    number = F.when(F.col("l4") == "Tcp", 6).when(F.col("l4") == "Udp", 17).otherwise(58)
    body = F.concat(top, payload_hex)
    outer = F.when(tags > 1, F.repeat(fixed((0x88A8, 2), (7, 2)), tags - 1)).otherwise(F.lit(""))
    inner = F.when(tags > 0, F.concat(fixed((0x8100, 2)), big_endian(vlan, 2))).otherwise(F.lit(""))
    ip = F.concat(fixed((0x60000000, 4)), big_endian(F.length(body) / 2, 2), big_endian(number, 1), big_endian(F.col("ttl"), 1), src, dst, body)
    return F.unhex(F.concat(fixed((0xAA, 6), (0xBB, 6)), outer, inner, fixed((0x86DD, 2)), ip))


def dns_compressed(name: Column) -> Column:
    """A query message for www under a name that stands behind the question, where a pointer leads."""
    labels = F.transform(F.split(name, r"\."), lambda x: F.concat(big_endian(F.octet_length(x), 1), F.hex(x)))
    question = F.concat(fixed((3, 1)), F.lit(b"www".hex()), fixed((0xC000 + 12 + 6 + 4, 2), (1, 2), (1, 2)))
    return F.unhex(F.concat(fixed((7, 2), (0x0100, 2), (1, 2), (0, 2), (0, 2), (0, 2)), question, F.array_join(labels, ""), fixed((0, 1))))
