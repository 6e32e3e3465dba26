"""Headers, names, packet-filter programs, captures and streams, on literal bytes."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from netquill.functions import bpf, decode, encode, names
from netquill.functions.errors import CaptureError
from netquill.operators import alerts, flows
from netquill.sources import eve, pcap
from netquill.sources.packet_view import PACKETS
from netquill.streaming import session

TCP = bytes.fromhex("0050ffff00000001000000025012040000000000") + b"payload"
IP4 = bytes.fromhex("4500002f000100004006") + b"\0\0" + bytes([10, 0, 0, 1, 10, 0, 0, 2])
MAC = bytes(12)


def frames(spark, *data):
    return spark.createDataFrame([(i, i, "t", bytearray(d)) for i, d in enumerate(data)], "pkt_id bigint, ts_us bigint, interface string, data binary")


def test_decode(spark):
    tagged = MAC + b"\x88\xa8\0\5\x81\0\0\7\x08\0" + IP4 + TCP + b"padding"
    v6 = MAC + b"\x86\xdd" + bytes.fromhex("6000000000083a40") + bytes(15) + b"\1" + bytes.fromhex("20010db8000000000000000000000002") + bytes.fromhex("8000000000000000")
    rows = decode.decode_frames(frames(spark, MAC + b"\x08\0" + IP4 + TCP, tagged, v6, MAC + b"\x08\6" + bytes(28), b"short", MAC + b"\x08\0" + IP4[:12])).orderBy("pkt_id").collect()
    assert [(r.pkt_id, r.l3, r.l4, r.src_ip, r.dst_port, r.ttl, r.payload_len) for r in rows] == [(0, "IPv4", "Tcp", "10.0.0.1", 65535, 64, 7), (1, "IPv4", "Tcp", "10.0.0.1", 65535, 64, 7), (2, "IPv6", "IcmpV6", "::1", None, None, 0), (3, "Other(0)", None, None, None, None, 0)]
    assert (rows[0].syn, rows[0].ack, rows[0].tcp_seq, bytes(rows[1].payload)) == (True, True, 1, b"payload")
    assert frames(spark, tagged).select(decode.ethernet(F.col("data"))["vlan_id"]).first()[0] == 7


def test_checksum(spark):
    header = bytearray(IP4)
    total = sum(struct.unpack(">10H", bytes(header)))
    total = (total & 0xFFFF) + (total >> 16)
    header[10:12] = struct.pack(">H", ~total & 0xFFFF)
    got = frames(spark, header, IP4, b"", b"\1").select(decode.checksum(F.col("data"))).collect()
    assert [got[0][0], got[2][0], got[3][0]] == [0, 0xFFFF, 0xFEFF] and got[1][0]
    assert frames(spark, header).select(decode.ipv4(F.col("data"))["checksum_ok"]).first()[0]


def test_dns_names():
    question = b"\0\1\1\0\0\1" + bytes(6) + b"\3www\7example\3com\0\0\1\0\1"
    assert names.dns_query(question) == "www.example.com"
    assert names.dns_query(question[:4] + b"\0\0" + question[6:]) is None
    assert names.dns_name(b"\1a\0" + b"\1b\xc0\0", 3) == ("b.a", 7)
    assert names.dns_name(b"\xc0\0", 0) == (None, 0) and names.dns_name(b"\5ab", 0) == (None, 0)
    assert names.dns_name(b"\x3f" + b"a" * 63 + (b"\x3f" + b"a" * 63) * 3 + b"\0", 0) == (None, 0)


def test_client_hello(spark):
    record = bytes(spark.range(1).select(encode.hello(F.lit("host.example"))).first()[0])
    got = names.client_hello(record)
    assert (got["is_client_hello"], got["server_name"], got["highest_version"]) == (True, "host.example", 0x0304)
    assert names.client_hello(record, compat=True)["highest_version"] == 0x0303
    assert names.client_hello(record[:-1]) is None and names.client_hello(b"\x17\3\3\0\0")["is_client_hello"] is False


def test_packet_filter_machine():
    frame = MAC + b"\x08\0" + IP4 + TCP
    port = [(0x28, 0, 0, 12), (0x15, 0, 4, 0x800), (0xB1, 0, 0, 14), (0x48, 0, 0, 16), (0x15, 0, 1, 65535), (0x06, 0, 0, 96), (0x06, 0, 0, 0)]
    assert bpf.is_valid(port) and bpf.run(port, frame) == 96 and bpf.run(port, frame[:20]) == 0
    assert not bpf.is_valid([]) and not bpf.is_valid([(0x15, 5, 0, 0), (6, 0, 0, 0)])
    jump = [(0x05, 0, 0, 1), (0x06, 0, 0, 1), (0x06, 0, 0, 2)]
    assert (bpf.run(jump, b""), bpf.run(jump, b"", compat=True)) == (2, 1)
    negative = [(0x00, 0, 0, 5), (0x84, 0, 0, 0), (0x16, 0, 0, 0)]
    assert (bpf.run(negative, b""), bpf.run(negative, b"", compat=True)) == (2**32 - 5, 2**32 - 6)
    assert bpf.run([(0x00, 0, 0, 5), (0x34, 0, 0, 0), (0x16, 0, 0, 0)], b"") == 0
    assert bpf.run([(0x80, 0, 0, 0), (0x02, 0, 0, 3), (0x61, 0, 0, 3), (0x87, 0, 0, 0), (0x16, 0, 0, 0)], b"", 77) == 77


def test_captures(spark, tmp_path):
    ng = bytes.fromhex("0a0d0d0a1c0000004d3c2b1a01000000ffffffffffffffff1c000000") + bytes.fromhex("0100000014000000010000000000000014000000")
    body = struct.pack("<IIIII", 0, 0, 5_000_000, 3, 9) + b"abc\0"
    ng += struct.pack("<II", 6, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    assert list(pcap.records(ng)) == [(5_000_000, 9, 1, b"abc")]
    nano = struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1) + struct.pack(">IIII", 2, 5000, 2, 2) + b"xy" + b"cut"
    assert list(pcap.records(nano)) == [(2_000_005, 2, 1, b"xy")]
    with pytest.raises(CaptureError):
        list(pcap.records(b"nothing at all"))
    raw = spark.createDataFrame([("eth0", i, i * 400_000, 700_000, 1, bytearray(600_000)) for i in range(6)], pcap.RAW)
    assert [r.file_no for r in pcap.rotated(raw, max_mb=1).orderBy("seq").collect()] == [0, 1, 2, 3, 4, 5]
    assert [r.file_no for r in pcap.rotated(raw, max_seconds=1).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1]
    assert {r.file_no for r in pcap.rotated(raw).collect()} == {0}
    written = pcap.write_pcap(raw, str(tmp_path), "cap", max_seconds=1).collect()
    assert sorted((r.path.rpartition("/")[2], r.packets) for r in written) == [("cap_000.pcap", 3), ("cap_001.pcap", 3)]
    back = pcap.read_pcap(spark, str(tmp_path)).orderBy("ts_us").collect()
    assert [(r.ts_us, r.wire_len, len(r.data)) for r in back] == [(i * 400_000, 700_000, 600_000) for i in range(6)]


def small(spark, rows):
    fields = [x.split()[0] for x in PACKETS.split(", ")]
    plain = {"interface": "t", "len": 100, "l3": "IPv4", "l4": "Udp", "app": "Unknown", "dst_port": 9, "syn": False, "ack": False, "fin": False, "rst": False, "psh": False, "urg": False, "payload_len": 0}
    return spark.createDataFrame([tuple((plain | r).get(c) for c in fields) for r in rows], PACKETS)


def test_eve_json(spark):
    a = alerts.numbered(alerts.packet_alerts(small(spark, [{"pkt_id": 1, "ts_us": 1_500_999, "src_ip": "1.1.1.1", "dst_port": 4444}])))
    assert json.loads(eve.json_lines(eve.alert_fields(a)).first()[0]) == {
        "timestamp": "1970-01-01T00:00:01.500Z", "event_type": "alert", "src_ip": "1.1.1.1", "dest_port": 4444,
        "alert": {"action": "allowed", "gid": 1, "signature_id": 1, "rev": 1, "signature": "Suspicious port 4444", "category": "Misc activity", "severity": 3},
    }


def test_streamed_flows_match_batch(spark, tmp_path):
    rows = [{"pkt_id": i, "ts_us": 10**9 + i * 7_000_000 + (40_000_000 if i > 20 else 0), "src_ip": f"10.0.0.{i % 3}", "dst_ip": "10.0.0.9", "src_port": i % 2} for i in range(60)]
    packets = small(spark, rows)
    for part in range(3):
        packets.where(F.floor(F.col("pkt_id") / 20) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    session.use_rocksdb(spark)
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = session.ended_flows(stream, "1 second").writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    ended = {(r.key_a, r.port_a, r.key_b, r.port_b, r.flow_no, r.first_us, r.last_us, r.packets_fwd, r.packets_rev) for r in spark.table("ended").collect()}
    batch = {(r.key_a, r.port_a, r.key_b, r.port_b, r.flow_no, r.first_us, r.last_us, r.packets_fwd, r.packets_rev) for r in flows.flow_table(packets).collect()}
    assert ended and ended <= batch and len(batch - ended) <= 6  # only live flows are missing


def test_stream_rates_and_fan_out(spark, tmp_path):
    packets = small(spark, [{"pkt_id": i, "ts_us": i * 300_000, "src_ip": "1.1.1.1"} for i in range(20)])
    packets.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in"))
    query = session.stream_rates(stream, 1, "0 seconds").writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.start_us, r.pps, r.bps) for r in spark.table("rates").collect()} >= {(0, 4.0, 3200.0), (1_000_000, 3.0, 2400.0)}
    seen = []
    session.fan_out(stream, {"count": lambda b: seen.append(b.count()), "bytes": lambda b: seen.append(b.agg(F.sum("len")).first()[0])}, str(tmp_path / "d"), None).awaitTermination(120)
    assert seen == [20, 2000]
