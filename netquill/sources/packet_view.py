"""The packets schema, and a deterministic packets view derived from an events table.

Time is compressed a thousandfold so that flow timeouts matter; every third event is a packet
in the reverse direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import ip_key
from ..functions.protocols import app_of_port

#: Columns of a packets table. ts_us and pkt_id give the order of arrival.
PACKETS = (
    "pkt_id bigint, ts_us bigint, interface string, len int, l3 string, l4 string, app string, src_ip string, dst_ip string, src_port int, dst_port int, "
    "ttl int, syn boolean, ack boolean, fin boolean, rst boolean, psh boolean, urg boolean, payload_len bigint, payload binary, tcp_seq bigint"
)
EPOCH_US = 1704067200000000
#: Payloads by event_id % 7, in hex: HTTP, TLS, SSH, QUIC, WireGuard, twelve bytes as of DNS, junk.
PAYLOADS = ["474554202f20485454502f312e310d0a", "1603030000", "5353482d322e30", "c30000000100", "01000000ff", "000000000000000000000000", "deadbeef"]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.round(F.col("value") * 100).cast("bigint")
    e = e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", k.alias("k"), v.alias("v"))
    kind, view = F.col("event_type"), F.col("event_type").isin("click", "view")
    k, v = F.col("k"), F.col("v")
    server_port = (
        F.when(kind == "signup", 53)
        .when(kind == "purchase", F.element_at(F.array(*[F.lit(x) for x in (443, 80, 22, 4444, 8443)]), k % 5 + 1))
        .when(view, (1000 + v % 50).cast("int"))
    )
    base = e.select(
        F.col("event_id").alias("pkt_id"),
        (F.lit(EPOCH_US) + F.expr(f"(us - {EPOCH_US}) div 1000")).alias("ts_us"),
        F.lit("events").alias("interface"),
        (40 + v % 1400).cast("int").alias("len"),
        F.lit("IPv4").alias("l3"),
        F.when(kind == "error", "Icmp").when(kind == "signup", "Udp").otherwise("Tcp").alias("l4"),
        F.concat(F.lit("9.0.0."), F.col("user_id") % 5).alias("a_ip"),
        F.concat(F.lit("192.168."), F.col("event_id") % 4, F.lit("."), k % 5).alias("b_ip"),
        F.when(kind != "error", 40000 + F.col("user_id") % 3).cast("int").alias("a_port"),
        server_port.cast("int").alias("b_port"),
        F.when(k == 7, 1).otherwise(64).alias("ttl"),
        (view & (k % 2 == 0)).alias("syn"),
        ((kind == "purchase") | (view & (k % 4 == 1))).alias("ack"),
        ((kind == "purchase") & (k % 10 == 9)).alias("fin"),
        (view & (k % 20 == 3)).alias("rst"),
        F.lit(False).alias("psh"),
        F.lit(False).alias("urg"),
        F.when(kind == "signup", k.cast("bigint")).otherwise(v % 1000).cast("bigint").alias("payload_len"),
        F.element_at(F.array(*[F.lit(x) for x in PAYLOADS]), (F.col("event_id") % 7 + 1).cast("int")).alias("payload_hex"),
        (F.col("event_id") % 3 == 0).alias("swapped"),
    )
    pick = lambda x, y, name: F.when(F.col("swapped"), F.col(y)).otherwise(F.col(x)).alias(name)
    same = ["pkt_id", "ts_us", "interface", "len", "l3", "l4"]
    flags = ["ttl", "syn", "ack", "fin", "rst", "psh", "urg", "payload_len", "payload_hex"]
    out = base.select(*same, pick("a_ip", "b_ip", "src_ip"), pick("b_ip", "a_ip", "dst_ip"), pick("a_port", "b_port", "src_port"), pick("b_port", "a_port", "dst_port"), *flags)
    return out.withColumn("app", app_of_port(F.col("dst_port")))


def with_keys(packets: DataFrame) -> DataFrame:
    """packets with src_key and dst_key, the sortable forms of the addresses."""
    return packets.withColumns({"src_key": ip_key(F.col("src_ip")), "dst_key": ip_key(F.col("dst_ip"))})


#: The same view in DuckDB, as the first part of a WITH list.
PACKETS_SQL = f"""
raw AS (
    SELECT event_id, epoch_us(ts) AS us, user_id, event_type, (props->>'$.k')::INTEGER AS k, round(value * 100)::BIGINT AS v,
        event_type IN ('click', 'view') AS view
    FROM events),
ends AS (
    SELECT event_id AS pkt_id, {EPOCH_US} + (us - {EPOCH_US}) // 1000 AS ts_us, 'events' AS interface, (40 + v % 1400)::INTEGER AS len, 'IPv4' AS l3,
        CASE event_type WHEN 'error' THEN 'Icmp' WHEN 'signup' THEN 'Udp' ELSE 'Tcp' END AS l4,
        '9.0.0.' || user_id % 5 AS a_ip, '192.168.' || event_id % 4 || '.' || k % 5 AS b_ip,
        CASE WHEN event_type <> 'error' THEN 40000 + user_id % 3 END::INTEGER AS a_port,
        CASE WHEN event_type = 'signup' THEN 53 WHEN event_type = 'purchase' THEN [443, 80, 22, 4444, 8443][k % 5 + 1] WHEN view THEN 1000 + v % 50 END::INTEGER AS b_port,
        CASE WHEN k = 7 THEN 1 ELSE 64 END AS ttl, view AND k % 2 = 0 AS syn, event_type = 'purchase' OR view AND k % 4 = 1 AS ack,
        event_type = 'purchase' AND k % 10 = 9 AS fin, view AND k % 20 = 3 AS rst, false AS psh, false AS urg,
        CASE WHEN event_type = 'signup' THEN k ELSE v % 1000 END::BIGINT AS payload_len,
        {PAYLOADS!r}[event_id % 7 + 1] AS payload_hex, event_id % 3 = 0 AS swapped
    FROM raw),
sided AS (
    SELECT *, CASE WHEN swapped THEN b_ip ELSE a_ip END AS src_ip, CASE WHEN swapped THEN a_ip ELSE b_ip END AS dst_ip,
        CASE WHEN swapped THEN b_port ELSE a_port END AS src_port, CASE WHEN swapped THEN a_port ELSE b_port END AS dst_port
    FROM ends),
packets AS (
    SELECT pkt_id, ts_us, interface, len, l3, l4, src_ip, dst_ip, src_port, dst_port, ttl, syn, ack, fin, rst, psh, urg, payload_len, payload_hex,
        CASE WHEN dst_port IN (80, 8080) THEN 'Http' WHEN dst_port IN (443, 8443) THEN 'Https' WHEN dst_port = 53 THEN 'Dns' WHEN dst_port IN (67, 68) THEN 'Dhcp'
            WHEN dst_port = 22 THEN 'Ssh' WHEN dst_port IN (20, 21) THEN 'Ftp' WHEN dst_port IN (25, 587, 465) THEN 'Smtp' WHEN dst_port IN (143, 993) THEN 'Imap'
            WHEN dst_port IN (110, 995) THEN 'Pop3' WHEN dst_port = 3389 THEN 'Rdp' WHEN dst_port IN (445, 139) THEN 'Smb' WHEN dst_port = 123 THEN 'Ntp'
            WHEN dst_port = 5353 THEN 'Mdns' ELSE 'Unknown' END AS app,
        '4' || array_to_string(list_transform(string_split(src_ip, '.'), lambda x: printf('%02x', x::INTEGER)), '') AS src_key,
        '4' || array_to_string(list_transform(string_split(dst_ip, '.'), lambda x: printf('%02x', x::INTEGER)), '') AS dst_key
    FROM sided)"""
