"""Packets are dealt to capture files as a fold over them would, in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from netquill.functions.staging import staged
from netquill.sources import pcap, rotation


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def fold(rows, limit, age):
    state, out = {}, {}
    for interface, ts, seq, size in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        s = state.setdefault(interface, [0, 0, ts])
        if (limit and s[1] + size > limit) or (age and ts - s[2] >= age):
            s[:] = [s[0] + 1, 0, ts]
        s[1] += size
        out[interface, seq] = s[0]
    return out


def frame(spark, rows):
    made = spark.createDataFrame(rows, "interface string, ts_us bigint, seq bigint, n int")
    return made.select("interface", "seq", "ts_us", F.lit(0).cast("bigint").alias("wire_len"), F.lit(1).cast("bigint").alias("link"), F.repeat(F.lit("x"), F.col("n")).cast("binary").alias("data")).repartition(4)


def some(seed):
    """One interface has most of the packets; there are bursts at one time, pauses, empty and oversized packets."""
    rng, rows, now = random.Random(seed), [], 0
    for i in range(400):
        now += rng.choice([0, 0, 1, 300_000, 900_000, 1_000_000, 5_000_000])
        size = rng.choice([0, 1, 30_000, 250_000, 400_000]) if rng.random() < 0.97 else 1_300_000
        rows.append((rng.choice(["eth0"] * 8 + ["eth1", None]), now, i, size))
    rows += [("one", 5, 1000, 2_000_000), ("two", 5, 1001, 2_000_000), ("two", 5, 1002, 1)]
    return rows


@pytest.mark.parametrize(("seed", "max_mb", "max_seconds"), [(1, 1, 0), (2, 0, 1), (3, 2, 3), (4, 20, 0), (5, 0, 100), (6, 1, 2), (7, 1000, 0)])
def test_equal_to_the_fold(spark, many_ranges, seed, max_mb, max_seconds):
    rows = some(seed)
    got = {(r.interface, r.seq): r.file_no for r in pcap.rotated(frame(spark, rows), max_mb, max_seconds).collect()}
    assert got == fold(rows, max_mb << 20, max_seconds * 10**6)


def test_one_interface_in_many_tasks(spark, many_ranges):
    rows = [("eth0", i * 1000, i, 200_000) for i in range(700)]
    raw = frame(spark, rows)
    numbered = pcap.rotated(raw, 1)
    assert {(r.interface, r.seq): r.file_no for r in numbered.collect()} == fold(rows, 1 << 20, 0)
    dealt = raw.select("interface", "ts_us", "seq", F.octet_length("data").alias("size")).repartitionByRange(*rotation.ORDER).withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "dealt")
    later = staged(rotation.ranges_of(dealt), "later")
    assert later.count() >= 5 and later.where("first").count() == 1
    leaves = rotation.leaves_of(dealt, later, 1 << 20, 0).groupBy("part").count().collect()
    assert len(leaves) >= 5 and all(r["count"] <= 6 for r in leaves)  # only the packets of the last file of a range


def test_odd_rows(spark):
    assert pcap.rotated(frame(spark, []), 1).count() == 0
    raw = frame(spark, [("a", 1, 1, 5)])
    assert [r.file_no for r in pcap.rotated(raw, 1).collect()] == [0] == [r.file_no for r in pcap.rotated(raw).collect()]
    assert pcap.rotated(raw, 1, 1).columns == [*raw.columns, "file_no"]
    nothing = raw.withColumn("data", F.lit(None).cast("binary"))
    assert [r.file_no for r in pcap.rotated(nothing, 1).collect()] == [0]


def test_files_are_written_in_parallel(spark, tmp_path):
    rows = [("eth0", i * 400_000, i, 700) for i in range(60)]
    written = pcap.write_pcap(frame(spark, rows), str(tmp_path), "cap", max_seconds=2).collect()
    want = fold(rows, 0, 2 * 10**6)
    assert sorted((r.path.rpartition("/")[2], r.packets) for r in written) == [(f"cap_{n:03d}.pcap", list(want.values()).count(n)) for n in range(max(want.values()) + 1)]
    back = pcap.read_pcap(spark, str(tmp_path))
    assert {(r.ts_us, len(r.data)) for r in back.collect()} == {(ts, n) for _, ts, _, n in rows}
