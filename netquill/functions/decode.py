"""Headers decoded from frames with binary expressions, and helpers to read big-endian numbers.

A struct is null where its header is too short or inconsistent. Guards are CASE branches, as
the order of conditions under AND is not fixed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ip import let, v6_text
from .protocols import app_of_port

VLAN_TAGS = [0x8100, 0x88A8]


def cut(data: Column, at: Column | int, n: Column | int) -> Column:
    """n bytes from an offset; fewer at the end."""
    at = F.lit(at) if isinstance(at, int) else at
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(data, (at + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))


def number(data: Column, at: Column | int, n: int) -> Column:
    """An unsigned big-endian number of n bytes, as bigint."""
    return F.conv(F.hex(cut(data, at, n)), 16, 10).cast("bigint")


def bit(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask).cast("bigint")) != 0


def named(**columns: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def checksum(data: Column) -> Column:
    """The one's-complement sum of 16-bit words, complemented; an odd last byte counts as its word's high byte. 0: valid."""
    words = F.floor((F.length(data) + 1) / 2).cast("int")
    zero = F.lit(0).cast("bigint")
    total = let(F.concat(data, F.lit(bytearray(1))), lambda d: F.when(F.length(d) > 1, F.aggregate(F.sequence(F.lit(0), F.greatest(words, F.lit(1)) - 1), zero, lambda a, i: a + number(d, i * 2, 2))).otherwise(zero))
    fold = lambda x: F.shiftright(x, 16) + x.bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    return F.lit(0xFFFF).cast("bigint") - let(let(let(total, fold), fold), fold)


def ethernet(data: Column) -> Column:
    """dst, src, ethertype, vlan_id (of the innermost tag) and consumed; any number of tags is stripped."""
    tags = F.sequence(F.lit(0), F.greatest(F.floor((F.length(data) - 14) / 4).cast("int"), F.lit(0)))
    at = F.aggregate(tags, F.lit(12), lambda a, _: F.when(number(data, a, 2).isin(VLAN_TAGS), a + 4).otherwise(a))
    inner = let(at, lambda a: F.when(a + 2 <= F.length(data), named(
        dst=F.lower(F.hex(cut(data, 0, 6))), src=F.lower(F.hex(cut(data, 6, 6))), ethertype=number(data, a, 2).cast("int"),
        vlan_id=F.when(a > 12, number(data, a - 2, 2) % 4096).cast("int"), consumed=a + 2)))
    return F.when(F.length(data) >= 14, inner)


def ipv4(data: Column, at: Column | int = 0) -> Column:
    byte = lambda i, n=1: number(data, at + i, n)
    size = (byte(0) % 16 * 4).cast("int")
    address = lambda i: F.concat_ws(".", *[byte(i + j).cast("string") for j in range(4)])
    left = F.length(data) - at
    header = named(
        ihl=size, dscp=F.shiftright(byte(1), 2).cast("int"), ecn=(byte(1) % 4).cast("int"), total_length=byte(2, 2).cast("int"), identification=byte(4, 2).cast("int"),
        flags=F.shiftright(byte(6), 5).cast("int"), fragment_offset=(byte(6, 2) % 8192).cast("int"), ttl=byte(8).cast("int"), protocol=byte(9).cast("int"), checksum=byte(10, 2).cast("int"),
        checksum_ok=checksum(cut(data, at, size)) == 0, src=address(12), dst=address(16), consumed=size,
    )
    return F.when(left >= 20, F.when((size >= 20) & (size <= left), header))


def ipv6(data: Column, at: Column | int = 0) -> Column:
    first = number(data, at, 4)
    address = lambda i: v6_text(F.lower(F.hex(cut(data, at + i, 16))))
    header = named(
        traffic_class=(F.shiftright(first, 20) % 256).cast("int"), flow_label=(first % (1 << 20)).cast("int"), payload_length=number(data, at + 4, 2).cast("int"),
        next_header=number(data, at + 6, 1).cast("int"), hop_limit=number(data, at + 7, 1).cast("int"), src=address(8), dst=address(24), consumed=F.lit(40),
    )
    return F.when(F.length(data) - at >= 40, header)


def tcp(data: Column, at: Column | int = 0) -> Column:
    byte = lambda i, n=1: number(data, at + i, n)
    size = (F.shiftright(byte(12), 4) * 4).cast("int")
    left = F.length(data) - at
    header = named(src_port=byte(0, 2).cast("int"), dst_port=byte(2, 2).cast("int"), seq=byte(4, 4), ack=byte(8, 4), data_offset=size, flags=byte(13).cast("int"), window=byte(14, 2).cast("int"), checksum=byte(16, 2).cast("int"), urgent=byte(18, 2).cast("int"), consumed=size)
    return F.when(left >= 20, F.when((size >= 20) & (size <= left), header))


def udp(data: Column, at: Column | int = 0) -> Column:
    byte = lambda i: number(data, at + i, 2).cast("int")
    return F.when(F.length(data) - at >= 8, named(src_port=byte(0), dst_port=byte(2), length=byte(4), checksum=byte(6), consumed=F.lit(8)))


def icmp(data: Column, at: Column | int = 0) -> Column:
    return F.when(F.length(data) - at >= 8, named(type=number(data, at, 1).cast("int"), code=number(data, at + 1, 1).cast("int"), checksum=number(data, at + 2, 2).cast("int"), rest=number(data, at + 4, 4), consumed=F.lit(8)))


def dns_header(data: Column) -> Column:
    flags = number(data, 2, 2)
    count = lambda i: number(data, i, 2).cast("int")
    return F.when(F.length(data) >= 12, named(id=count(0), qr=bit(flags, 0x8000), opcode=(F.shiftright(flags, 11) % 16).cast("int"), aa=bit(flags, 0x400), tc=bit(flags, 0x200), rd=bit(flags, 0x100), ra=bit(flags, 0x80), rcode=(flags % 16).cast("int"), qdcount=count(4), ancount=count(6), nscount=count(8), arcount=count(10)))


def transport(d: Column, proto: Column, top: Column, end: Column) -> Column:
    """t, u and i: the TCP, UDP or ICMP header, whichever the protocol says; end is where the packet ends."""
    body = cut(d, 0, end)
    return let(body, lambda b: named(t=F.when(proto == 6, tcp(b, top)), u=F.when(proto == 17, udp(b, top)), i=F.when(proto.isin(1, 58), icmp(b, top)), proto=proto, top=top, end=F.length(b)))


def packet_struct(d: Column) -> Column:
    """The decoded packet as one struct, null if the frame does not decode.

    Each layer is bound by let, so the plan stays small.
    """

    def of_layers(e: Column, v4: Column, v6: Column, x: Column) -> Column:
        t, u, i = x["t"], x["u"], x["i"]
        l4 = F.when(t.isNotNull(), "Tcp").when(u.isNotNull(), "Udp").when(i.isNotNull() & (x["proto"] == 1), "Icmp").when(i.isNotNull(), "IcmpV6")
        start = x["top"] + F.coalesce(t["consumed"], u["consumed"], i["consumed"])
        payload = F.coalesce(F.when(l4.isNotNull(), cut(d, start, x["end"] - start)), F.lit(bytearray()))
        flag = lambda mask: F.coalesce(bit(t["flags"].cast("bigint"), mask), F.lit(False))
        dst_port = F.coalesce(t["dst_port"], u["dst_port"])
        broken = ((x["proto"] == 6) & t.isNull()) | ((x["proto"] == 17) & u.isNull())
        out = let(payload, lambda p: named(
            l3=F.when(v4.isNotNull(), "IPv4").when(v6.isNotNull(), "IPv6").otherwise("Other(0)"), l4=l4, app=app_of_port(dst_port), src_ip=F.coalesce(v4["src"], v6["src"]), dst_ip=F.coalesce(v4["dst"], v6["dst"]),
            src_port=F.coalesce(t["src_port"], u["src_port"]), dst_port=dst_port, ttl=v4["ttl"], syn=flag(2), ack=flag(16), fin=flag(1), rst=flag(4), psh=flag(8), urg=flag(32),
            payload_len=F.length(p).cast("bigint"), payload=p, tcp_seq=t["seq"],
        ))
        return F.when(F.coalesce(broken, F.lit(False)), F.lit(None)).otherwise(out)

    def of_ip(e: Column, v4: Column, v6: Column) -> Column:
        at = e["consumed"]
        proto = F.when(v4.isNotNull(), F.when(v4["fragment_offset"] == 0, v4["protocol"])).otherwise(v6["next_header"])
        top = at + F.coalesce(v4["consumed"], v6["consumed"])
        end = F.least(F.length(d), F.when(v4.isNotNull(), at + F.greatest(v4["total_length"], v4["consumed"])).otherwise(at + 40 + v6["payload_length"]))
        return let(named(proto=proto, top=top, end=end), lambda h: let(transport(d, h["proto"], h["top"], h["end"]), lambda x: of_layers(e, v4, v6, x)))

    def of_frame(e: Column) -> Column:
        both = named(v4=F.when(e["ethertype"] == 0x0800, ipv4(d, e["consumed"])), v6=F.when(e["ethertype"] == 0x86DD, ipv6(d, e["consumed"])))
        broken = lambda x: ((e["ethertype"] == 0x0800) & x["v4"].isNull()) | ((e["ethertype"] == 0x86DD) & x["v6"].isNull())
        return let(both, lambda x: F.when(broken(x), F.lit(None)).otherwise(of_ip(e, x["v4"], x["v6"])))

    return let(ethernet(d), lambda e: F.when(e.isNotNull(), of_frame(e)))


def decode_frames(raw):
    """raw (pkt_id, ts_us, interface, data) as packets; frames that do not decode are left out.

    len is the captured length. The hop limit of IPv6 is no ttl, and the application comes from
    the destination port alone. Bytes after the length that the IP header gives are padding.
    """
    # The generator keeps filters above it: pushed below, they would repeat the whole decoding.
    rows = raw.select("pkt_id", "ts_us", "interface", F.length("data").alias("len"), F.explode_outer(F.array(packet_struct(F.col("data")))).alias("p"))
    return rows.where("p is not null").select("pkt_id", "ts_us", "interface", "len", "p.*")
