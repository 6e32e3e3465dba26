"""Streams give what the same operators give over a table, and state goes when keys fall silent."""

import random

import pytest
from pyspark.sql import functions as F
from test_bytes import small

from netquill.operators import alerts, flows, reassembly
from netquill.streaming import alerts as streaming_alerts
from netquill.streaming import session
from netquill.streaming.reassembly import stream_reassemble

LAST = 4 * 10**12


@pytest.fixture
def streamed(spark, tmp_path):
    """Run a streaming operator over packets dealt into triggers; returns its rows and the rows of state after each trigger."""
    session.use_rocksdb(spark)

    def run(packets, part, triggers, make, name):
        for i in range(triggers):
            packets.where(part == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        return spark.table(name).collect(), [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]

    return run


def arrivals(rng, n, step_us):
    """Packets out of order by up to 2 seconds, in order of arrival."""
    rows = [{"ts_us": 10**9 + i * step_us} for i in range(n)]
    rows.sort(key=lambda r: r["ts_us"] + rng.randrange(2_000_000))
    return rows


def test_alerts(spark, streamed):
    rng, rows = random.Random(3), []
    for i, r in enumerate(arrivals(rng, 900, 50_000)):
        kind = rng.choice(["syn", "icmp", "scan", "scan", "plain"])
        r |= {"pkt_id": i, "src_ip": f"10.0.0.{rng.randrange(3)}", "dst_ip": f"10.0.1.{rng.randrange(9)}", "dst_port": rng.choice([22, 53, 80, 4444, 5000 + rng.randrange(4)]), "ttl": rng.choice([1, 64])}
        r |= {"syn": {"l4": "Tcp", "syn": True}, "icmp": {"l4": "Icmp", "dst_port": None}, "scan": {"l4": "Tcp", "ack": True}, "plain": {"app": "Dns", "payload_len": 90}}[kind]
        rows.append(r)
    rows.append({"pkt_id": 900, "ts_us": LAST, "src_ip": "1.1.1.1", "dst_ip": "1.1.1.2"})
    packets, limits = small(spark, rows), {"syn": 25, "icmp": 30, "ports": 6, "hosts": 7}
    got, _ = streamed(packets, F.floor(F.col("pkt_id") / 226), 4, lambda s: streaming_alerts.stream_alerts(s, late="5 seconds", **limits), "alerts")
    want = alerts.packet_alerts(packets, **limits).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.rule for r in want} == {"SynFlood", "IcmpFlood", "BadTtl", "SuspPort", "VerticalScan", "HorizontalScan", "DnsExfil"}


def test_alert_state_goes(spark, streamed):
    """Groups that are silent are forgotten, one that comes again starts anew, and a group past its threshold keeps a number only."""
    rows = [{"pkt_id": i, "ts_us": 10**9 + i * 1000, "src_ip": f"10.0.{i % 7}.1", "dst_ip": "10.9.9.9", "dst_port": i % 50, "l4": "Tcp"} for i in range(350)]
    rows += [{"pkt_id": 400 + i, "ts_us": 10**12 + i * 1000, "src_ip": "10.0.0.1", "dst_ip": "10.9.9.9", "dst_port": 1 + i, "l4": "Tcp"} for i in range(5)]
    rows += [{"pkt_id": 500, "ts_us": LAST, "src_ip": "1.1.1.1", "dst_ip": "1.1.1.2"}, {"pkt_id": 600, "ts_us": LAST + 1, "src_ip": "1.1.1.1", "dst_ip": "1.1.1.2"}]
    packets = small(spark, rows)
    part = F.when(F.col("pkt_id") < 400, 0).when(F.col("pkt_id") < 500, 1).when(F.col("pkt_id") < 600, 2).otherwise(3)
    got, state = streamed(packets, part, 4, lambda s: streaming_alerts.stream_alerts(s, ports=5, hosts=99, late="1 second", idle=60), "forgetful")
    scans = [r for r in got if r.rule == "VerticalScan"]
    assert len([r for r in scans if r.pkt_id >= 400]) == 1 and {r.src_ip for r in scans if r.pkt_id < 400} == {f"10.0.{i}.1" for i in range(7)}
    assert max(state) > 350 and state[-1] < 20


def test_flows_without_numbers_leave_nothing(spark, streamed):
    rows = [{"pkt_id": i, "ts_us": 10**9 + i * 10_000, "src_ip": f"10.0.0.{i % 20}", "dst_ip": "10.0.9.9", "src_port": 5} for i in range(200)]
    rows += [{"pkt_id": 200 + i, "ts_us": LAST + i, "src_ip": "1.1.1.1", "dst_ip": "1.1.1.2"} for i in range(2)]
    packets = small(spark, rows)
    got, state = streamed(packets, F.when(F.col("pkt_id") < 200, 0).otherwise(F.col("pkt_id") - 199), 3, lambda s: session.ended_flows(s, "1 second", numbered=False), "unnumbered")
    want = flows.flow_table(packets).where(F.col("first_us") < LAST).collect()
    assert sorted((r.key_a, r.flow_no, r.packets_fwd + r.packets_rev, r.bytes_fwd + r.bytes_rev) for r in got) == sorted((r.key_a, r.first_us, r.packets_fwd + r.packets_rev, r.bytes_fwd + r.bytes_rev) for r in want)
    assert max(state) >= 20 and state[-1] <= 4  # the last key only: its flow and its timer


def segments(rng, start=10**9):
    """Two directions of three flows whose segments come shuffled, some twice, some overlapping, across the turn of sequence numbers."""
    sent, rows = {}, []
    for flow in range(3):
        for fwd in (True, False):
            data, first = rng.randbytes(4000), (2**32 - 1500 + flow) % 2**32
            sent[flow, fwd] = data
            pieces = [(a, data[a : a + rng.choice([100, 150])]) for a in range(0, 4000, 100)]
            pieces = [(a, p) for a, p in pieces for _ in range(rng.choice([1, 1, 2]))]
            rng.shuffle(pieces)
            ends = {"src_ip": f"10.0.0.{flow}", "dst_ip": "10.0.1.1", "src_port": 1000, "dst_port": 80}
            ends = ends if fwd else {"src_ip": ends["dst_ip"], "dst_ip": ends["src_ip"], "src_port": 80, "dst_port": 1000}
            rows.append(ends | {"tcp_seq": first, "syn": True, "payload": b"", "first": True})
            rows += [ends | {"tcp_seq": (first + 1 + a) % 2**32, "ack": True, "payload": p} for a, p in pieces]
    rows.sort(key=lambda r: not r.pop("first", False))
    head, tail = rows[:6], rows[6:]
    rng.shuffle(tail)
    return sent, [r | {"l4": "Tcp", "pkt_id": i, "ts_us": start + i * 20_000} for i, r in enumerate(head + tail)]


def emitted(rows):
    return sorted((r.key_a, r.port_a, r.key_b, r.port_b, r.fwd, r.pkt_id, bytes(r.data), r.dropped) for r in rows)


@pytest.mark.parametrize("cap", [None, 2500])
def test_reassembly(spark, streamed, cap):
    sent, rows = segments(random.Random(11))
    n = len(rows)
    rows.append({"pkt_id": n, "ts_us": LAST, "l4": "Tcp", "src_ip": "1.1.1.1", "dst_ip": "1.1.1.2", "tcp_seq": 0})
    packets = small(spark, rows)
    part = F.least(F.floor(F.col("pkt_id") * 4 / n), F.lit(4))
    got, _ = streamed(packets, part, 5, lambda s: stream_reassemble(s, cap=cap, late="1 second", idle=None, closed=None), f"bytes{cap}")
    want = emitted(reassembly.reassemble(packets, cap=cap).collect())
    assert emitted(got) == want
    if cap is None:
        whole = {}
        for row in sorted(want, key=lambda r: r[5]):
            whole[row[:5]] = whole.get(row[:5], b"") + row[6]
        assert sorted(whole.values()) == sorted(sent.values()) and not any(r[7] for r in want)
    else:
        kept, dropped = sum(len(r[6]) for r in want), sum(r[7] for r in want)
        assert 0 < kept <= 6 * cap and dropped > 0


def test_directions_are_removed(spark, streamed):
    """A direction that was closed goes soon, another after a while; waiting segments go with it."""
    plain = {"l4": "Tcp", "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 1, "dst_port": 2}
    rows = [plain | {"tcp_seq": 9, "syn": True, "payload": b""}, plain | {"tcp_seq": 10, "payload": b"ab"}, plain | {"tcp_seq": 50, "payload": b"waits"}, plain | {"tcp_seq": 12, "fin": True, "payload": b""}]
    rows += [r | {"src_ip": "10.0.0.3", "fin": False} for r in rows]
    rows = [r | {"pkt_id": i, "ts_us": 10**9 + i} for i, r in enumerate(rows)]
    other = plain | {"src_ip": "1.1.1.1", "tcp_seq": 0, "payload": b""}
    rows += [other | {"pkt_id": 100 + i, "ts_us": 10**9 + s * 10**6} for i, s in enumerate((20, 21, 100, 101))]
    packets = small(spark, rows)
    got, state = streamed(packets, F.when(F.col("pkt_id") < 100, 0).otherwise(F.col("pkt_id") - 99), 5, lambda s: stream_reassemble(s, late="0 seconds", idle=60, closed=5), "removed")
    assert [bytes(r.data) for r in got] == [b"ab", b"ab"]
    assert max(state) >= 6 and state[-1] <= 3  # the last key only: its place, time and timer


def test_waiting_segments_by_heap():
    """Many segments in reverse order, with the turn of sequence numbers in the middle."""
    for compat in (False, True):
        half, start = reassembly.HalfStream(compat, None), 2**32 - 50_000 if not compat else 100
        half.feed(start - 1, True, False, False, b"")
        pieces = [((start + 10 * i) % 2**32, b"%010d" % i) for i in range(10_000)]
        out = [half.feed(seq, False, False, False, data) for seq, data in reversed(pieces)]
        assert b"".join(out) == b"".join(d for _, d in pieces) and not half.segments and not half.heap
