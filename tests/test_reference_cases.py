"""The small cases that the survey lists, and a fold that flows are held against."""

import random

import pytest
from pyspark.sql import functions as F

from netquill.functions.errors import FilterSyntaxError
from netquill.functions.ip import ip_key, key_of, v6_text
from netquill.operators import alerts, enrich, flows, payloads, reassembly
from netquill.operators.filters import capture_filter, display_filter
from netquill.sources import lists
from netquill.sources.packet_view import PACKETS

FIELDS = [x.split()[0] for x in PACKETS.split(", ")]
PLAIN = {"pkt_id": 0, "ts_us": 0, "interface": "t", "len": 60, "l3": "IPv4", "app": "Unknown", "syn": False, "ack": False, "fin": False, "rst": False, "psh": False, "urg": False, "payload_len": 0}


def packets(spark, *rows):
    return spark.createDataFrame([tuple((PLAIN | r).get(c) for c in FIELDS) for r in rows], PACKETS)


@pytest.mark.parametrize(("text", "row", "hit"), [
    ("tcp", {"l4": "Tcp"}, True), ("tcp", {"l4": "Udp"}, False), ("tcp or udp", {"l4": "Udp"}, True), ("port == 443", {"l4": "Tcp", "dst_port": 443}, True),
    ("not tcp", {"l4": "Tcp"}, False), ("not tcp", {"l4": None}, True), ("not port == 443", {"l4": "Tcp"}, True), ("tcp and not port == 80", {"l4": "Tcp", "src_port": 80}, False),
    ("ip.src == ::1", {"src_ip": "0:0:0:0:0:0:0:1"}, True), ("ip.dst == 1.2.3.4", {"src_ip": "1.2.3.4"}, False),
])
def test_display_filter(spark, text, row, hit):
    assert packets(spark, row).where(display_filter(text)).count() == hit


def test_filter_errors():
    for text, pos in (("ip.src == not-an-ip", 7), ("port == 70000", 7), ("src.port == x", 11), ("(tcp)", 0), ("tcp and", 0), ("TCP", 0)):
        with pytest.raises(FilterSyntaxError) as e:
            display_filter(text)
        assert e.value.pos == pos
    with pytest.raises(FilterSyntaxError):
        display_filter("tcp or ü")
    for text in ("host", "port x", "tcp or", "(tcp", "tcp)"):
        with pytest.raises(FilterSyntaxError):
            capture_filter(text)


def test_parentheses(spark):
    p = packets(spark, {"l4": "Tcp", "dst_port": 80}, {"l4": "Udp", "dst_port": 80}, {"l4": "Tcp", "dst_port": 22})
    assert p.where(display_filter("(tcp or udp) and port == 80", parens=True)).count() == 2
    assert p.where(capture_filter("not (tcp and dst port 22)")).count() == 2
    assert p.where(capture_filter("")).count() == 3


def test_payload_classes(spark):
    cases = [(b"GET / HTTP/1.1\r\n", None, "HTTP"), (b"\x16\x03\x03\0\0", None, "TLS"), (b"\0\0\0", None, None), (bytes(12), 53, "DNS"), (b"SSH-2.0", None, "SSH"), (b"\xc3\0\0\0\1", None, "QUIC"),
             (b"\xc3\xff\0\0\x1d", None, "QUIC"), (b"\1\0\0\0", 51820, "WireGuard"), (b"\1\0\0\0", 1, None), (None, None, None), (b"", 53, None), (b"DELETE /", None, None)]
    df = spark.createDataFrame([(i, bytearray(p) if p is not None else None, port) for i, (p, port, _) in enumerate(cases)], "i int, payload binary, src_port int").withColumn("dst_port", F.lit(None).cast("int"))
    got = {r.i: r.p for r in df.select("i", payloads.classify(F.col("payload"))["protocol"].alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for *_, want in cases]


def test_blocklist(spark):
    text = ["8.8.8.8", "fe80::99", "# no", "", " 1.2.3.0/24 ", "::123", "Malware.Example.COM", "1.2.3.4 ; note", "10.0.0.0/33"]
    rows = {r.entry: (r.kind, r.bits) for r in lists.classified(spark.createDataFrame([(x,) for x in text], "value string")).collect()}
    assert rows == {"8.8.8.8": ("ip", None), "fe80::99": ("ip", None), "1.2.3.0/24": ("net", 24), "::123": ("ip", None), "malware.example.com": ("domain", None), "1.2.3.4 ; note": ("domain", None), "10.0.0.0/33": ("domain", None)}
    listed = lists.blocklist(spark.createDataFrame([("1.2.3.4",), ("10.0.0.0/8",), ("fe80::/10",), ("192.168.4.0/23",)], "value string"))
    addresses = spark.createDataFrame([(x,) for x in ("1.2.3.4", "5.6.7.8", "10.1.2.3", "192.168.1.1", "fe9f::1", "fec0::1", "192.168.5.9", "192.168.6.1")], "ip string").withColumn("key", ip_key(F.col("ip")))
    assert {r.ip for r in enrich.listed_addresses(addresses, listed["ips"], listed["nets"]).collect()} == {"1.2.3.4", "10.1.2.3", "fe9f::1", "192.168.5.9"}
    names = spark.createDataFrame([("malware.example.com",), ("safe.example.com",)], "domain string")
    banned = spark.createDataFrame([("Malware.Example.COM",)], "domain string")
    assert [r.domain for r in enrich.listed_domains(names, banned).collect()] == ["malware.example.com"]


def test_rules(spark):
    rules = lists.parse_rules(['alert tcp any any -> any 80 (msg:"HTTP probe"; sid:1001; rev:1;)', "# x", "short (sid:1;)", "alert tcp any [80,443] -> !1.2.3.4 1024: (msg:\"m\"; sid:bad;)"])
    assert [(r["sid"], r["msg"], r["proto"], r["dst_lo"]) for r in rules] == [(1001, "HTTP probe", "Tcp", 80), (0, "m", "Tcp", None)]
    p = packets(spark, {"l4": "Tcp", "dst_port": 80}, {"l4": "Udp", "dst_port": 80})
    assert [r.message for r in enrich.rule_alerts(p, rules[:1]).collect()] == ["[sid:1001] HTTP probe"]
    assert enrich.rule_alerts(p, []).count() == 0


def test_reassembly(spark):
    end = {"l4": "Tcp", "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 1234, "dst_port": 80}
    seg = lambda i, seq, data, **k: end | {"pkt_id": i, "ts_us": i, "tcp_seq": seq, "payload": bytearray(data)} | k
    p = packets(spark, seg(0, 0, b"", syn=True), seg(1, 1, b"Hello "), seg(2, 7, b"World"), seg(3, 20, b"late"), seg(4, 12, b"12345678"), seg(5, 15, b"dup"))
    assert [(r.pkt_id, bytes(r.data)) for r in reassembly.reassemble(p).orderBy("pkt_id").collect()] == [(1, b"Hello "), (2, b"World"), (4, b"12345678late")]
    half = reassembly.HalfStream()
    half.feed((1 << 32) - 3, True, False, False, b"")
    assert half.feed(1, False, False, False, b"cd") == b"" and half.feed((1 << 32) - 2, False, False, False, b"XYZ") == b"XYZcd"
    assert reassembly.HalfStream(compat=True).feed(5, False, False, False, b"x") == b""


def fold(rows):
    """Flows packet by packet: (key, first, last, packets, state)."""
    live, done = {}, []
    limit = {"New": 60, "Established": 300, "Closing": 15}
    for r in sorted(rows, key=lambda r: (r["ts_us"], r["pkt_id"])):
        a, b = (key_of(r["src_ip"]), r["src_port"]), (key_of(r["dst_ip"]), r["dst_port"])
        key = (min(a, b), max(a, b), r["l4"])
        f = live.get(key)
        idle = {"Udp": 30, "Icmp": 10}.get(r["l4"]) or (limit[f[4]] if f else 0)
        if f and r["ts_us"] - f[2] >= idle * 10**6:
            done.append(live.pop(key))
            f = None
        f = f or [key, r["ts_us"], 0, 0, "New"]
        f[2], f[3] = r["ts_us"], f[3] + 1
        if r["l4"] == "Tcp":
            f[4] = "New" if r["syn"] and not r["ack"] else "Established" if r["ack"] and not r["fin"] and not r["rst"] else "Closing" if r["fin"] or r["rst"] else f[4]
        live[key] = f
    return sorted(map(tuple, [*done, *live.values()]))


@pytest.mark.parametrize("seed", range(3))
def test_flows_against_fold(spark, seed):
    rng = random.Random(seed)
    rows, now = [], 0
    for i in range(1500):
        now += rng.choice([0, 10**6, 7 * 10**6, 20 * 10**6, 60 * 10**6, 130 * 10**6]) // rng.choice([1, 1, 3])
        ips = rng.sample(["9.0.0.1", "10.0.0.2", "192.168.0.3"], 2)
        flag = rng.choice(["", "", "syn", "ack", "fin", "rst", "syn ack"])
        rows.append(PLAIN | {"pkt_id": i, "ts_us": now, "l4": rng.choice(["Tcp", "Tcp", "Tcp", "Udp", "Icmp"]), "src_ip": ips[0], "dst_ip": ips[1], "src_port": rng.choice([1, 2]), "dst_port": 2} | {f: True for f in flag.split()})
    got = flows.flow_table(packets(spark, *rows)).collect()
    assert sorted((((r.key_a, r.port_a), (r.key_b, r.port_b), r.proto), r.first_us, r.last_us, r.packets_fwd + r.packets_rev, r.state) for r in got) == fold(rows)


def test_alert_thresholds(spark):
    syn = [{"pkt_id": i, "ts_us": i, "l4": "Tcp", "syn": True, "src_ip": "1.1.1.1", "dst_ip": "2.2.2.2", "dst_port": i % 4} for i in range(10)]
    p = packets(spark, *syn)
    assert [r.pkt_id for r in alerts.syn_flood(p, 5).collect()] == [4]
    assert sorted(r.pkt_id for r in alerts.vertical_scan(p, 4).collect()) == [3, 4, 5, 6, 7, 8, 9]  # raises again while the count stays
    assert alerts.packet_alerts(p.limit(0)).count() == 0


def test_addresses(spark):
    texts = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "::", "fe80::1", "::ffff:1.2.3.4", "1:::2", "a::b::c", "1:2:3:4:5:6:7:8", "x", None]
    want = []
    for t in texts:
        try:
            want.append(key_of(t))
        except (ValueError, TypeError):
            want.append(None)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, ip string").withColumn("k", ip_key(F.col("ip")))
    got = df.withColumn("t", F.when(F.substring("k", 1, 1) == "6", v6_text(F.substring("k", 2, 32)))).orderBy("i").collect()
    assert [r.k for r in got] == want
    assert [got[i].t for i in (3, 4, 8)] == ["::", "fe80::1", "1:2:3:4:5:6:7:8"]
