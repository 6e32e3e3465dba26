"""Address ranges, address databases and large rule tables against plain lookups."""

import ipaddress
import random
import struct

import pytest
from pyspark.sql import functions as F
from test_reference_cases import PLAIN, packets

from netquill.functions.errors import GeoLookupError
from netquill.functions.ip import ip_key, key_of
from netquill.operators import enrich
from netquill.sources import lists, mmdb


def addresses(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "ip string").withColumn("key", ip_key(F.col("ip")))


def some_ranges(rng, n, version):
    """Ranges that do not overlap, some next to each other, some of one address, one very wide."""
    top = 2**32 if version == 4 else 2**128
    cuts = sorted(rng.sample(range(2**24, 2**32), 2 * n)) if version == 4 else sorted((0x20010DB8 << 96) + rng.randrange(2**64) for _ in range(2 * n))
    out = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    return [*out, (max(cuts) + 1, top - 1 if version == 4 else max(cuts) + 2**80)]


@pytest.mark.parametrize("most_cuts", [1, 7, 255])
def test_ranges_by_quantiles(spark, most_cuts):
    rng, rows, texts = random.Random(most_cuts), [], ["no address", None]
    for version, n in ((4, 60), (6, 60)):
        kind = ipaddress.IPv4Address if version == 4 else ipaddress.IPv6Address
        ranges = some_ranges(rng, n, version)
        rows += [(str(kind(a)), str(kind(b)), f"{version}:{i}") for i, (a, b) in enumerate(ranges)]
        near = [x + d for r in ranges for x in r for d in (-1, 0, 1)]
        texts += sorted({str(kind(x)) for x in near + [rng.randrange(2**32) for _ in range(80)] if x < 2 ** (32 if version == 4 else 128)})
    ranges = spark.createDataFrame(rows, "first string, last string, name string").select(ip_key(F.col("first")).alias("lo"), ip_key(F.col("last")).alias("hi"), "name")
    got = {r.ip: r.name for r in enrich.range_lookup(addresses(spark, texts), ranges, ["name"], most_cuts).collect()}
    plain = [(int(ipaddress.ip_address(a)), int(ipaddress.ip_address(b)), n) for a, b, n in rows]
    for t in texts:
        try:
            ip = ipaddress.ip_address(t)
            want = next((n for a, b, n in plain if n.startswith(str(ip.version)) and a <= int(ip) <= b), None)
        except ValueError:
            want = None
        assert got[t] == want, t


def test_parts_are_even(spark):
    """Addresses of one network of IPv6, and one range over nearly all of them: parts are even, and the range is listed once a part."""
    base = int(ipaddress.IPv6Address("2001:db8::"))
    points = addresses(spark, [str(ipaddress.IPv6Address(base + i * 7)) for i in range(2000)])
    ranges = spark.createDataFrame([(f"6{base + 5:032x}", f"6{base + 10_000:032x}", "wide")], "lo string, hi string, name string")
    cuts = enrich.cut_points(points, ranges, 15)
    assert 8 <= len(cuts) <= 15
    parts = points.groupBy(enrich.stretch_of(F.col("key"), cuts).alias("s")).count().collect()
    assert len(parts) >= 8 and max(p["count"] for p in parts) < 1000
    assert enrich.range_lookup(points, ranges, ["name"], 15).where("name = 'wide'").count() == sum(5 <= 7 * i <= 10_000 for i in range(2000))
    assert enrich.range_lookup(points, ranges.limit(0), ["name"]).where("name is null").count() == 2000
    assert enrich.range_lookup(points.limit(0), ranges, ["name"]).count() == 0


# A writer of address databases, to have files to read.


def encoded(value):
    def head(kind, size):
        short = size if size < 29 else 29 if size < 285 else 30 if size < 65821 else 31
        rest = b"" if short < 29 else (size - {29: 29, 30: 285, 31: 65821}[short]).to_bytes(short - 28, "big")
        return (bytes([kind << 5 | short]) if kind < 8 else bytes([short, kind - 7])) + rest

    if isinstance(value, bool):
        return head(14, int(value))
    if isinstance(value, dict):
        return head(7, len(value)) + b"".join(encoded(k) + encoded(v) for k, v in value.items())
    if isinstance(value, list):
        return head(11, len(value)) + b"".join(map(encoded, value))
    if isinstance(value, str):
        return head(2, len(value.encode())) + value.encode()
    if isinstance(value, float):
        return head(3, 8) + struct.pack(">d", value)
    if isinstance(value, bytes):
        return value  # encoded already
    body = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return head(6 if value < 2**32 else 10, len(body)) + body


def pointer(at):
    if at < 2048:
        return bytes([1 << 5 | at >> 8, at & 255])
    at -= 2048
    return bytes([1 << 5 | 1 << 3 | at >> 16, at >> 8 & 255, at & 255])


def database(networks, bits, version):
    """networks: (network, value); the values are written once each, with pointers between them where given."""
    nodes, data, places = [[None, None]], b"", {}
    for net, value in networks:
        if (blob := encoded(value)) not in places:
            places[blob] = len(data)
            data += blob
        number, length = int(net.network_address), net.prefixlen + (96 if version == 6 and net.version == 4 else 0)
        depth, at = 128 if version == 6 else 32, 0
        for i in range(length - 1):
            side = number >> (depth - 1 - i) & 1
            if nodes[at][side] is None:
                nodes.append([None, None])
                nodes[at][side] = len(nodes) - 1
            at = nodes[at][side]
        nodes[at][number >> (depth - length) & 1] = ("value", places[blob])
    out, n = b"", len(nodes)
    for pair in nodes:
        left, right = (n if x is None else n + 16 + x[1] if isinstance(x, tuple) else x for x in pair)
        if bits == 28:
            out += (left & 0xFFFFFF).to_bytes(3, "big") + bytes([(left >> 24) << 4 | right >> 24]) + (right & 0xFFFFFF).to_bytes(3, "big")
        else:
            out += left.to_bytes(bits // 8, "big") + right.to_bytes(bits // 8, "big")
    meta = {"node_count": n, "record_size": bits, "ip_version": version, "database_type": "test", "languages": ["en"], "build_epoch": 2**40}
    return out + b"\0" * 16 + data + mmdb.MARKER + encoded(meta)


@pytest.mark.parametrize(("bits", "version"), [(24, 4), (24, 6), (28, 6), (32, 6)])
def test_address_database(spark, tmp_path, bits, version):
    rng = random.Random(bits)
    nets = {ipaddress.ip_network(f"{a}.{rng.randrange(256)}.{rng.randrange(256)}.0/24") for a in range(1, 40)} | {ipaddress.ip_network(x) for x in ("64.0.0.0/3", "10.1.2.3/32", "200.0.0.0/25", "200.0.0.128/25")}
    if version == 6:
        nets |= {ipaddress.ip_network(x) for x in ("2001:db8::/32", "2001:db9:1::/48", "fe80::1/128", "::1:0:0/96")}
    values = [{"country": {"iso_code": c, "names": {"en": "x" * n}}, "n": i, "exact": 0.5, "flag": True, "list": [1, "a"]} for i, (c, n) in enumerate((("US", 3), ("DE", 40), ("FR", 400), ("ES", 70_000)))]
    listed = [(net, {"country": {"iso_code": "AT"}} if str(net).startswith("200.") else rng.choice([*values, {"other": 1}])) for net in sorted(nets, key=lambda n: (n.version, n))]
    (tmp_path / "geo.mmdb").write_bytes(database(listed, bits, version))
    ranges = mmdb.read_mmdb(spark, str(tmp_path / "geo.mmdb"), {"country": "country.iso_code", "n": "n"})
    want = []
    for net, value in listed:
        lo, hi = (key_of(str(x)) for x in (net.network_address, net.broadcast_address))
        row = (lo, hi, value.get("country", {}).get("iso_code"), str(value["n"]) if "n" in value else None)
        if want and str(net) == "200.0.0.128/25":
            row = (want.pop()[0], *row[1:])  # neighbours of one value are one range
        want.append(row)
    assert sorted(map(tuple, ranges.collect()), key=str) == sorted(want, key=str)
    texts = [str(net.network_address + d) for net in nets for d in (0, net.num_addresses // 2, net.num_addresses - 1)] + ["9.9.9.9", "2002::1"]
    got = {r.ip: r.country for r in enrich.range_lookup(addresses(spark, sorted(set(texts))), ranges, ["country"]).collect()}
    for t in texts:
        ip = ipaddress.ip_address(t)
        assert got[t] == next((v.get("country", {}).get("iso_code") for n, v in listed if n.version == ip.version and ip in n), None)


def test_pointers_and_wrong_files(spark, tmp_path):
    section = encoded("US") + b"\0" * 3000 + encoded("DE")
    at = len(section)
    section += encoded({"near": pointer(0), "far": pointer(3003), "n": 5})
    assert mmdb.Values(section, 0).read(at)[0] == {"near": "US", "far": "DE", "n": 5}
    with pytest.raises(GeoLookupError, match="not an address database"):
        mmdb.Trie(b"something else")
    with pytest.raises(GeoLookupError, match="no value of type"):
        mmdb.Values(bytes([0, 20]), 0).read(0)


# Rules.


def test_port_nodes():
    rng = random.Random(4)
    for low, high in [(0, 65535), (0, 0), (65535, 65535), (1, 65534), (5, 4), *[sorted(rng.choices(range(65536), k=2)) for _ in range(50)]]:
        nodes = enrich.port_nodes(low, high)
        assert sorted(p for level, i in nodes for p in range(i << level, (i + 1) << level)) == list(range(low, high + 1)) and len(nodes) <= 30
    assert enrich.port_nodes(None, None) == [(enrich.ANY, 0)] and enrich.port_nodes(0, 65535) == [(16, 0)]


def rule_line(rng, i):
    address = lambda: rng.choice(["any", "any", f"10.0.0.{rng.randrange(6)}", "$HOME_NET", "2001:db8::1"])
    port = lambda: rng.choice(["any", "any", str(rng.randrange(60)), f"{rng.randrange(40)}:{rng.randrange(20, 70)}", "0:65535", "[1,2]"])
    proto = rng.choice(["tcp", "udp", "icmp", "ip", "http"])
    return f'alert {proto} {address()} {port()} -> {address()} {port()} (msg:"rule {i}"; sid:{i + 7};)'


def rule_packets(rng, n):
    ends = ["10.0.0.1", "10.0.0.2", "10.0.0.5", "10.0.0.77", "2001:db8::1"]
    return [PLAIN | {"pkt_id": i, "ts_us": i, "l4": rng.choice(["Tcp", "Udp", "Icmp", None]), "src_ip": rng.choice([*ends, None]), "dst_ip": rng.choice(ends), "src_port": rng.choice([None, *range(0, 70, 3)]), "dst_port": rng.choice([None, *range(0, 70, 4)])} for i in range(n)]


def narrow(rules):
    """Without rules that match nearly everything, of which the first would win always."""
    return [x for x in rules if sum(w not in ("any", "$HOME_NET", "0:65535", "[1,2]") for w in (x.split()[2], x.split()[3], x.split()[5], x.split()[6])) >= 3]


@pytest.mark.parametrize("n", [0, 1, 300])
def test_rule_table_equals_expression(spark, tmp_path, n):
    rng = random.Random(n)
    lines = ["# comment", "", "broken", *narrow(rule_line(rng, i) for i in range(n * 3))]
    (tmp_path / "a.rules").write_text("\n".join(lines))
    p = packets(spark, *rule_packets(rng, 400))
    want = enrich.rule_alerts(p, lists.parse_rules(lines)).collect()
    got = enrich.rule_table_alerts(p, lists.read_rule_table(spark, str(tmp_path / "a.rules"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and (n < 300 or len(want) > 20)


def test_fifty_thousand_rules(spark, tmp_path):
    rng = random.Random(50)
    lines = [f'alert tcp any any -> 10.{i % 250}.{i // 250}.1 {i % 1000}:{i % 1000 + 40} (msg:"r{i}"; sid:{i + 1};)' for i in range(50_000)]
    rng.shuffle(lines)
    half = len(lines) // 2
    (tmp_path / "a.rules").write_text("\n".join(lines[:half]))
    (tmp_path / "b.rules").write_text("\n".join(lines[half:]))
    rules = [lists.parse_rule(x) for x in lines]
    sent = [PLAIN | {"pkt_id": k, "ts_us": k, "l4": "Tcp", "src_ip": "1.1.1.1", "src_port": 5, "dst_ip": rules[k * 90]["dst"], "dst_port": rules[k * 90]["dst_lo"] + k % 60} for k in range(500)]
    want = {}
    for s in sent:
        hit = next((r for r in rules if r["dst"] == s["dst_ip"] and r["dst_lo"] <= s["dst_port"] <= r["dst_hi"]), None)
        if hit:
            want[s["pkt_id"]] = hit["sid"]
    got = enrich.rule_table_alerts(packets(spark, *sent), lists.read_rule_table(spark, str(tmp_path)))
    assert {r.pkt_id: r.sid for r in got.collect()} == want and len(want) > 300
