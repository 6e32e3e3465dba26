"""Traffic totals, shares, talkers, rates and snapshots over packets.

Every aggregation has a partial step, so a protocol or address with a third of all packets
costs the shuffle one row for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(by: str, packets: DataFrame) -> DataFrame:
    return packets.groupBy(by).agg(F.count("*").alias("packets"), F.sum(F.col("len").cast("bigint")).alias("bytes"))


def totals(packets: DataFrame) -> DataFrame:
    return packets.agg(F.count("*").alias("packets"), F.coalesce(F.sum(F.col("len").cast("bigint")), F.lit(0)).cast("bigint").alias("bytes"))


def by_protocol(packets: DataFrame) -> DataFrame:
    """Packets and bytes by transport; packets without one are left out."""
    return counted("l4", packets.where("l4 is not null"))


def by_app(packets: DataFrame) -> DataFrame:
    return counted("app", packets)


def talkers(packets: DataFrame) -> DataFrame:
    """Packets and bytes by address; a packet counts for its source and its destination (twice if they are the same)."""
    ends = packets.select("len", F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    return counted("ip", ends.where("ip is not null"))


def top_talkers(packets: DataFrame, n: int = 10) -> DataFrame:
    """By bytes, then by address."""
    from ..functions.ip import ip_key

    return talkers(packets).withColumn("key", ip_key(F.col("ip"))).orderBy(F.desc("bytes"), "key").limit(n).drop("key")


def rates(packets: DataFrame, seconds: int = 1) -> DataFrame:
    """Packets and bits per second in aligned intervals that have packets."""
    width = seconds * 1_000_000
    start = (F.floor(F.col("ts_us") / width) * width).cast("bigint").alias("start_us")
    out = packets.groupBy(start).agg(F.count("*").alias("n"), F.sum(F.col("len").cast("bigint")).alias("b"))
    return out.select("start_us", (F.col("n") / F.lit(float(seconds))).alias("pps"), (F.col("b") * 8 / F.lit(float(seconds))).alias("bps"))


def snapshot(packets: DataFrame, n: int = 10) -> DataFrame:
    """One row: totals, the rates of the last full second, top talkers, and packets by protocol and by application."""
    last = rates(packets).agg(F.max_by(F.struct("pps", "bps"), "start_us").alias("rate"))
    top = top_talkers(packets, n).agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "ip", "bytes"))).alias("t"))
    shares = {}
    for name, df, by in (("proto_dist", by_protocol(packets), "l4"), ("app_dist", by_app(packets), "app")):
        shares[name] = df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "packets")))).alias(name))
    # Each side has one row.
    out = totals(packets).join(F.broadcast(last)).join(F.broadcast(top)).join(F.broadcast(shares["proto_dist"])).join(F.broadcast(shares["app_dist"]))
    talker = F.transform("t", lambda x: F.struct(x["ip"].alias("ip"), x["bytes"].alias("bytes")))
    return out.select("packets", "bytes", F.coalesce("rate.pps", F.lit(0.0)).alias("pps"), F.coalesce("rate.bps", F.lit(0.0)).alias("bps"), talker.alias("top_talkers"), "proto_dist", "app_dist")


def capture_stats(stats: DataFrame) -> DataFrame:
    """stats (received, dropped_kernel, dropped_iface) with drop_ratio."""
    return stats.withColumn("drop_ratio", F.when(F.col("received") == 0, 0.0).otherwise(F.col("dropped_kernel") / F.col("received")))


def interfaces(packets: DataFrame) -> DataFrame:
    return packets.select("interface").distinct()


def default_interface(packets: DataFrame) -> DataFrame:
    """The first interface by name that is not the loopback."""
    return interfaces(packets).where("interface <> 'lo'").orderBy("interface").limit(1)


def first_captured(raw: DataFrame, n: int = 0) -> DataFrame:
    """The first n captured frames in order of arrival, counted before decoding; 0: all."""
    return raw.orderBy("ts_us", "pkt_id").limit(n) if n else raw


def distinct_ports(packets: DataFrame) -> DataFrame:
    """Different destination ports for each source and destination, at the end."""
    return packets.where("src_ip is not null and dst_ip is not null and dst_port is not null").groupBy("src_ip", "dst_ip").agg(F.count_distinct("dst_port").alias("ports"))


def distinct_hosts(packets: DataFrame) -> DataFrame:
    """Different destinations for each source and destination port, at the end."""
    return packets.where("src_ip is not null and dst_ip is not null and dst_port is not null").groupBy("src_ip", "dst_port").agg(F.count_distinct("dst_ip").alias("hosts"))
