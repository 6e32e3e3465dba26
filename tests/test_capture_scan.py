"""Captures read by ranges of any size give the rows that whole files give."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from netquill.functions.errors import CaptureError
from netquill.sources import capture_scan, pcap

COLUMNS = [c.split()[0] for c in pcap.RAW.split(", ")]


def classic(records, order="<", nano=False, cut=0):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 262144, 1)
    for ts, data, wire in records:
        out += struct.pack(f"{order}IIII", ts // 10**6, ts % 10**6 * (1000 if nano else 1), len(data), wire) + data
    return out[: len(out) - cut]


def block(kind, body, order):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(f"{order}I", len(body) + 12)
    return struct.pack(f"{order}I", kind) + size + body + size


def blocks(rng, n, order="<", interfaces=3):
    """Sections with interfaces described as late as possible, packets of two kinds and blocks of no interest."""
    section = block(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    describe = lambda r: block(1, struct.pack(f"{order}HHI", 1 + r % 3, 0, 65535) + struct.pack(f"{order}HHB3xHH", 9, 1, r, 0, 0), order)
    out = section
    for i in range(n):
        if i % 97 == 0:
            out += describe(rng.choice([6, 9, 3]))
        if i and i % 211 == 0:
            out += section + b"".join(describe(rng.choice([6, 9])) for _ in range(interfaces))
        data = rng.randbytes(rng.choice([0, 1, 3, 60, 400]))
        ticks = 1_700_000_000_000_000 + i
        out += rng.choice([
            block(6, struct.pack(f"{order}IIIII", rng.randrange(5), ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data) + 4) + data, order),
            block(3, struct.pack(f"{order}I", len(data)) + data, order),
            block(5, rng.randbytes(24), order),
        ])
    return out


def some(rng, n, start=1_700_000_000_000_000):
    return [(start + i * 1000, rng.randbytes(rng.choice([1, 14, 60, 60, 500, 1500])), 1500 + i % 7) for i in range(n)]


def nested(rng):
    """A capture whose packets carry captures, runs of zeros and an oversized record, so that guesses go wrong."""
    inner = classic(some(rng, 60))
    records = [(5 * i, rng.choice([inner, inner[24:], b"\0" * 3000, struct.pack("<IIII", 5, 5, 20, 20) * 200]), 9000) for i in range(40)]
    records[20] = (7, rng.randbytes(40_000), 40_000)
    return classic(records)


RNG = random.Random(7)
FILES = {
    "plain": classic(some(RNG, 700)),
    "big": classic(some(RNG, 300), ">"),
    "nano": classic(some(RNG, 300), nano=True),
    "cut": classic(some(RNG, 200), cut=17),
    "headless": classic([]),
    "junk": classic(some(RNG, 50)) + RNG.randbytes(5000),
    "nested": nested(RNG),
    "empty_records": classic([(i, b"", 0) for i in range(500)]),
    "blocks": blocks(RNG, 900),
    "blocks_big": blocks(RNG, 300, ">"),
    "blocks_mixed": blocks(RNG, 200) + blocks(RNG, 200, ">"),
    "blocks_cut": blocks(RNG, 100)[:-5],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("captures")
    for name, content in FILES.items():
        (path / f"{name}.pcap").write_bytes(content)
    return path


def rows(df):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("range_bytes", [700, 4096, 30_000, 1 << 20])
def test_same_rows_as_whole_files(spark, folder, range_bytes):
    want = rows(pcap.read_pcap(spark, f"{folder}/*.pcap"))
    assert len(want) > 3000
    assert rows(capture_scan.scan_captures(spark, f"{folder}/*.pcap", range_bytes)) == want


def test_one_file_in_many_tasks(spark, folder):
    df = capture_scan.scan_captures(spark, f"{folder}/plain.pcap", 20_000)
    parts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 10 and sum(p["count"] for p in parts) == 700


@pytest.mark.parametrize("name", FILES)
def test_guesses(folder, name):
    """Walking from what guess finds gives true places wherever payloads do not mimic records."""
    path = str(folder / f"{name}.pcap")
    window = capture_scan.Window(path)
    kind = capture_scan.kind_of(window)
    starts, at, state = set(), kind.first, kind.start
    while got := kind.step(window, at, state, False):
        starts.add(at)
        at, _, state = got
    found = [capture_scan.guess(window, kind, a, min(a + 5000, window.size)) for a in range(5000, window.size, 5000)]
    if name in ("plain", "big", "nano", "blocks", "blocks_big"):
        assert {f for f in found if f >= 0} <= starts and sum(f >= 0 for f in found) > 0.9 * len(found)


def test_filters_leave_out_ranges(spark, folder):
    path = f"{folder}/*.pcap"
    df = capture_scan.scan_captures(spark, path, 8192)
    low, high = 1_700_000_000_100_000, 1_700_000_000_200_000
    for condition in (F.col("ts_us").between(low, high), F.col("ts_us") > high, F.col("ts_us") == low, F.col("interface").endswith("nano.pcap") & (F.col("ts_us") < low)):
        assert rows(df.where(condition)) == rows(pcap.read_pcap(spark, path).where(condition))
    one = df.where(F.col("interface").endswith("nano.pcap")).select("interface").first()[0]
    assert rows(df.where(F.col("interface") == one)) == rows(pcap.read_pcap(spark, f"{folder}/nano.pcap"))
    ranges = capture_scan.capture_ranges(spark, f"{folder}/plain.pcap", 8192)
    reader = capture_scan.CaptureReader({"path": ranges})
    every = len(reader.partitions())
    list(reader.pushFilters([capture_scan.GreaterThanOrEqual(("ts_us",), low), capture_scan.LessThan(("ts_us",), high)]))
    assert 0 < len(reader.partitions()) < every / 3


def test_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "text.pcap").write_bytes(b"no capture at all, but long enough")
    with pytest.raises(Exception, match="not a capture file"):
        capture_scan.scan_captures(spark, str(tmp_path))
    with pytest.raises(CaptureError, match="read_pcap"):
        capture_scan.located_file("viewfs://store/x.pcap")
    with pytest.raises(CaptureError, match="no file"):
        capture_scan.Window(f"file:{tmp_path}/none.pcap")
    with pytest.raises(ValueError, match="positive"):
        capture_scan.scan_captures(spark, str(tmp_path), 0)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "zero.pcap").write_bytes(b"")
    assert capture_scan.scan_captures(spark, str(tmp_path / "none")).count() == 0
