"""EVE-style JSON lines of alerts and flows, and the printed forms of packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.protocols import EVE_CATEGORY, EVE_PROTO, EVE_SEVERITY, choose, clock, endpoint, eve_time


def alert_fields(alerts: DataFrame) -> DataFrame:
    """alerts (with id) in the nested columns of an EVE alert."""
    inner = F.struct(
        F.lit("allowed").alias("action"), F.lit(1).alias("gid"), F.col("id").alias("signature_id"), F.lit(1).alias("rev"), F.col("message").alias("signature"),
        choose(F.col("category"), EVE_CATEGORY, None).alias("category"), choose(F.col("severity"), EVE_SEVERITY, None).alias("severity"),
    )
    return alerts.select(eve_time(F.col("ts_us")).alias("timestamp"), F.lit("alert").alias("event_type"), "src_ip", "src_port", F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"), inner.alias("alert"))


def flow_fields(flows: DataFrame) -> DataFrame:
    inner = F.struct(
        F.col("packets_fwd").alias("pkts_toserver"), F.col("packets_rev").alias("pkts_toclient"), F.col("bytes_fwd").alias("bytes_toserver"), F.col("bytes_rev").alias("bytes_toclient"),
        eve_time(F.col("first_us")).alias("start"), eve_time(F.col("last_us")).alias("end"), F.lower("state").alias("state"),
    )
    return flows.select(
        eve_time(F.col("last_us")).alias("timestamp"), F.lit("flow").alias("event_type"), F.col("ip_a").alias("src_ip"), F.col("port_a").alias("src_port"),
        F.col("ip_b").alias("dest_ip"), F.col("port_b").alias("dest_port"), choose(F.col("proto"), EVE_PROTO, "unknown").alias("proto"), inner.alias("flow"),
    )


def json_lines(fields: DataFrame, pretty: bool = False) -> DataFrame:
    """One column, value; nulls are left out."""
    return fields.select(F.to_json(F.struct("*"), {"pretty": "true"} if pretty else {}).alias("value"))


def write_eve(fields: DataFrame, path: str) -> None:
    """Append JSON lines to a folder."""
    json_lines(fields).write.mode("append").text(path)


def capture_line() -> Column:
    """[12:00:00.123] eth0 Tcp 1.2.3.4:5 → 6.7.8.9:80 (60 bytes)"""
    ip = lambda c: F.coalesce(F.col(c), F.lit(""))
    ends = [endpoint(ip("src_ip"), F.col("src_port")), F.lit(" → "), endpoint(ip("dst_ip"), F.col("dst_port"))]
    return F.concat(F.lit("["), clock(F.col("ts_us"), 3), F.lit("] "), "interface", F.lit(" "), F.coalesce("l4", F.lit("")), F.lit(" "), *ends, F.lit(" ("), F.col("len").cast("string"), F.lit(" bytes)"))


def read_line() -> Column:
    """12:00:00.123456 Some(Tcp) 1.2.3.4:5 → 6.7.8.9:80 60 bytes"""
    l4 = F.when(F.col("l4").isNull(), F.lit("None")).otherwise(F.concat(F.lit("Some("), "l4", F.lit(")")))
    return F.concat(clock(F.col("ts_us"), 6), F.lit(" "), l4, F.lit(" "), endpoint(F.col("src_ip"), F.col("src_port")), F.lit(" → "), endpoint(F.col("dst_ip"), F.col("dst_port")), F.lit(" "), F.col("len").cast("string"), F.lit(" bytes"))


def write_table(df: DataFrame, path: str, kind: str = "json") -> None:
    """kind: table (printed, 20 rows), json or csv."""
    if kind == "table":
        df.show(truncate=False)
    else:
        df.write.mode("append").format(kind).save(path)
