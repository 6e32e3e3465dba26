"""A key with very many packets is walked in stretches, with the rows of a walk in one piece."""

import random

import pytest
from pyspark.sql import functions as F
from test_reference_cases import PLAIN, packets

from netquill.operators import flows


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def some(seed, n=600):
    """One key has most of the packets; flags are rare, so that many stretches set no state."""
    rng, rows, now = random.Random(seed), [], 0
    for i in range(n):
        now += rng.choice([0, 10**6, 7 * 10**6, 14_999_999, 15 * 10**6, 20 * 10**6, 61 * 10**6, 130 * 10**6, 310 * 10**6]) // rng.choice([1, 1, 1, 5])
        flag = rng.choice(["", "", "", "", "", "", "syn", "ack", "fin", "rst", "syn ack"]) if rng.random() < (0.1 if seed % 2 else 0.9) else ""
        hot = rng.random() < 0.7
        ends = ["9.0.0.1", "10.0.0.2"] if hot else rng.sample(["9.0.0.1", "10.0.0.2", "192.168.0.3", "9.0.0.9"], 2)
        rng.shuffle(ends)
        l4 = "Tcp" if hot else rng.choice(["Tcp", "Udp", "Icmp"])
        rows.append(PLAIN | {"pkt_id": i, "ts_us": now, "l4": l4, "src_ip": ends[0], "dst_ip": ends[1], "src_port": 2, "dst_port": 2} | {f: True for f in flag.split()})
    return rows


def table(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("seed", "tick_s"), [(1, 0), (2, 0), (3, 30)])
def test_same_flows(spark, many_ranges, seed, tick_s):
    p = packets(spark, *some(seed))
    want = table(flows.flow_table(p, tick_s))
    assert len(want) > 10
    for most_rows in (0, 100):
        assert table(flows.flow_table(p, tick_s, most_rows)) == want, most_rows


def test_every_packet_keeps_its_columns(spark, many_ranges):
    p = packets(spark, *some(6, 300))
    whole, cut = flows.in_flows(p), flows.in_flows(p, most_rows=40)
    assert sorted(whole.columns) == sorted(cut.columns)
    columns = ["pkt_id", "flow_no", "state", *flows.KEY]
    assert table(whole.select(*columns)) == table(cut.select(*columns))


def test_a_hot_key_is_in_many_tasks(spark, many_ranges):
    p = flows.canonical(packets(spark, *some(7))).withColumn("sets", flows.stated())
    largest = flows.stretched(p).groupBy(*flows.KEY).agg(F.count("*").alias("n"), F.countDistinct("stretch").alias("stretches")).orderBy(F.desc("n")).first()
    assert largest.n > 300 and largest.stretches >= 5
    stretches = flows.entered_with(p.withColumn("stretch", F.floor(F.col("pkt_id") / 20).cast("int")), 0)
    assert stretches.where("in_us is null").count() == p.select(*flows.KEY).distinct().count()  # only the first of each key
