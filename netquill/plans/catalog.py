"""Every query of the library by name, with the SQL to hold it against."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bpf, decode, encode, names
from ..functions import protocols as P
from ..functions.ip import ip_key, v6_text
from ..operators import alerts, enrich, filters, flows, payloads, reassembly, traffic
from ..sources import capture_scan, eve, lists, pcap
from ..sources.packet_view import PACKETS_SQL, packets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WITH = f"WITH {PACKETS_SQL}"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir)."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def from_packets(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(sql, name)(lambda spark, sf_dir: f(packets(spark, sf_dir)))


# Filters. At these selectivities the whole matching rows are returned.

PACKET = ["pkt_id", "ts_us", "l4", "app", "src_ip", "dst_ip", "src_port", "dst_port", "len"]
FILTERS = {
    "filter_tcp": ("tcp", "l4 = 'Tcp'"),
    "filter_udp_or_icmp": ("udp or icmp", "l4 IN ('Udp', 'Icmp')"),
    "filter_app": ("https or ssh", "app IN ('Https', 'Ssh')"),
    "filter_port_any": ("port == 443", "src_port = 443 OR dst_port = 443"),
    "filter_src_port": ("src.port == 53", "src_port = 53"),
    "filter_dst_port": ("dst.port == 40001", "dst_port = 40001"),
    "filter_not_port_nullsafe": ("not port == 443", "src_port IS DISTINCT FROM 443 AND dst_port IS DISTINCT FROM 443"),
    "filter_and_or_precedence": ("tcp and dst.port == 443 or udp", "(l4 = 'Tcp' AND dst_port = 443) OR l4 = 'Udp'"),
    "filter_ip_src": ("ip.src == 9.0.0.3", "src_ip = '9.0.0.3'"),
    "filter_ip_dst": ("ip.dst == 192.168.1.2 and not tcp", "dst_ip = '192.168.1.2' AND l4 IS DISTINCT FROM 'Tcp'"),
}
CAPTURE_FILTERS = {
    "capture_filter_net": ("net 192.168.2.0/24 and not icmp", "(src_key BETWEEN '4c0a80200' AND '4c0a802ff' OR dst_key BETWEEN '4c0a80200' AND '4c0a802ff') AND l4 <> 'Icmp'"),
    "capture_filter_range": ("tcp dst portrange 1000-1010 or (udp and src host 9.0.0.1)", "(l4 = 'Tcp' AND dst_port BETWEEN 1000 AND 1010) OR (l4 = 'Udp' AND src_ip = '9.0.0.1')"),
}
for _name, (_text, _sql) in FILTERS.items():
    from_packets(_name, f"{WITH} SELECT {', '.join(PACKET)} FROM packets WHERE {_sql}", lambda p, t=_text: p.where(filters.display_filter(t)).select(*PACKET))
for _name, (_text, _sql) in CAPTURE_FILTERS.items():
    from_packets(_name, f"{WITH} SELECT {', '.join(PACKET)} FROM packets WHERE {_sql}", lambda p, t=_text: p.where(filters.capture_filter(t)).select(*PACKET))
from_packets("connection_starts", f"{WITH} SELECT count(*) FILTER (syn AND NOT ack) AS starts, count(*) FILTER (syn AND NOT ack AND NOT fin AND NOT rst) AS syn_only FROM packets",
             lambda p: p.agg(F.count_if(P.is_connection_start()).alias("starts"), F.count_if(P.is_syn_only()).alias("syn_only")))

# Totals and talkers.

TALKERS = "talkers AS (SELECT ip, count(*) AS packets, sum(len)::BIGINT AS bytes FROM (SELECT len, unnest([src_ip, dst_ip]) AS ip FROM packets) WHERE ip IS NOT NULL GROUP BY ip)"
from_packets("app_from_port", f"{WITH} SELECT DISTINCT dst_port, app FROM packets", lambda p: p.select("dst_port", "app").distinct())
from_packets("totals", f"{WITH} SELECT count(*) AS packets, sum(len)::BIGINT AS bytes FROM packets", traffic.totals)
from_packets("proto_dist", f"{WITH} SELECT l4, count(*) AS packets, sum(len)::BIGINT AS bytes FROM packets WHERE l4 IS NOT NULL GROUP BY l4", traffic.by_protocol)
from_packets("app_dist", f"{WITH} SELECT app, count(*) AS packets, sum(len)::BIGINT AS bytes FROM packets GROUP BY app", traffic.by_app)
from_packets("talkers", f"{WITH}, {TALKERS} SELECT * FROM talkers", traffic.talkers)
TOP = "top AS (SELECT ip, packets, bytes FROM talkers ORDER BY bytes DESC, '4' || array_to_string(list_transform(string_split(ip, '.'), lambda x: printf('%02x', x::INTEGER)), '') LIMIT 10)"
from_packets("top_talkers", f"{WITH}, {TALKERS}, {TOP} SELECT * FROM top", traffic.top_talkers)
RATES = "rates AS (SELECT ts_us // 1000000 * 1000000 AS start_us, count(*)::DOUBLE AS pps, sum(len)::DOUBLE * 8 AS bps FROM packets GROUP BY 1)"
from_packets("rate_1s", f"{WITH}, {RATES} SELECT * FROM rates", traffic.rates)
from_packets(
    "snapshot",
    f"{WITH}, {TALKERS}, {TOP}, {RATES} SELECT count(*) AS packets, sum(len)::BIGINT AS bytes, (SELECT arg_max(pps, start_us) FROM rates) AS pps, (SELECT arg_max(bps, start_us) FROM rates) AS bps, "
    "(SELECT string_agg(ip || '=' || bytes, ',' ORDER BY bytes DESC, ip) FROM top) AS talkers, (SELECT string_agg(l4 || '=' || n, ',' ORDER BY l4) FROM (SELECT l4, count(*) AS n FROM packets GROUP BY l4)) AS protos, "
    "(SELECT string_agg(app || '=' || n, ',' ORDER BY app) FROM (SELECT app, count(*) AS n FROM packets GROUP BY app)) AS apps FROM packets",
    lambda p: traffic.snapshot(p).select("packets", "bytes", "pps", "bps", listed(F.transform("top_talkers", lambda t: F.concat_ws("=", t["ip"], t["bytes"]))).alias("talkers"), shares("proto_dist").alias("protos"), shares("app_dist").alias("apps")),
)
from_packets("interfaces", f"{WITH} SELECT DISTINCT interface FROM packets WHERE interface <> 'lo' ORDER BY 1 LIMIT 1", traffic.default_interface)
from_packets("capture_stats", f"{WITH} SELECT 'events' AS interface, count(*) AS received, count(*) FILTER (l4 = 'Icmp') AS dropped_kernel, 0::BIGINT AS dropped_iface, count(*) FILTER (l4 = 'Icmp') / count(*) AS drop_ratio FROM packets",
             lambda p: traffic.capture_stats(p.groupBy("interface").agg(F.count("*").alias("received"), F.count_if(F.col("l4") == "Icmp").alias("dropped_kernel"), F.lit(0).cast("bigint").alias("dropped_iface"))))


def listed(items: Column) -> Column:
    return F.array_join(items, ",")


def shares(name: str) -> Column:
    return listed(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat_ws("=", e["key"], e["value"])))


from_packets("distinct_ports", f"{WITH} SELECT src_ip, dst_ip, count(DISTINCT dst_port) AS ports FROM packets WHERE dst_port IS NOT NULL GROUP BY ALL", traffic.distinct_ports)
from_packets("distinct_hosts", f"{WITH} SELECT src_ip, dst_port, count(DISTINCT dst_ip) AS hosts FROM packets WHERE dst_port IS NOT NULL GROUP BY ALL", traffic.distinct_hosts)
from_packets("capture_limit", f"{WITH} SELECT pkt_id, ts_us FROM packets ORDER BY ts_us, pkt_id LIMIT 100", lambda p: traffic.first_captured(p, 100).select("pkt_id", "ts_us"))

# Flows.

KEYED_SQL = """
keyed AS (
    SELECT *, (src_key, coalesce(src_port, 0)) <= (dst_key, coalesce(dst_port, 0)) AS forward, coalesce(l4, 'Other(0)') AS proto,
        CASE WHEN l4 = 'Tcp' THEN CASE WHEN syn AND NOT ack THEN 'New' WHEN ack AND NOT fin AND NOT rst THEN 'Established' WHEN fin OR rst THEN 'Closing' END END AS sets
    FROM packets WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL),
tupled AS (
    SELECT *, CASE WHEN forward THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN forward THEN dst_ip ELSE src_ip END AS ip_b,
        CASE WHEN forward THEN src_key ELSE dst_key END AS key_a, CASE WHEN forward THEN dst_key ELSE src_key END AS key_b,
        coalesce(CASE WHEN forward THEN src_port ELSE dst_port END, 0) AS port_a, coalesce(CASE WHEN forward THEN dst_port ELSE src_port END, 0) AS port_b
    FROM keyed)"""
#: Breaks between flows found with a recursive fold over the packets of each key, one by one.
FLOWS_SQL = f"""{KEYED_SQL.strip()},
ordered AS (
    SELECT *, src_key = key_a AS fwd, row_number() OVER (PARTITION BY key_a, port_a, key_b, port_b, proto ORDER BY ts_us, pkt_id) AS i,
        dense_rank() OVER (ORDER BY key_a, port_a, key_b, port_b, proto) AS key_no
    FROM tupled),
fold AS (
    SELECT key_no, i, ts_us, proto, coalesce(sets, 'New') AS state, 1::BIGINT AS flow_no FROM ordered WHERE i = 1
    UNION ALL
    SELECT key_no, i, ts_us, proto, CASE WHEN late THEN coalesce(sets, 'New') ELSE coalesce(sets, state) END, flow_no + CASE WHEN late THEN 1 ELSE 0 END
    FROM (SELECT o.key_no, o.i, o.ts_us, o.proto, o.sets, f.state, f.flow_no,
            o.ts_us - f.ts_us >= 1000000 * CASE f.proto WHEN 'Tcp' THEN CASE f.state WHEN 'Established' THEN 300 WHEN 'New' THEN 60 ELSE 15 END WHEN 'Udp' THEN 30 WHEN 'Icmp' THEN 10 WHEN 'IcmpV6' THEN 10 ELSE 120 END AS late
        FROM fold f JOIN ordered o ON o.key_no = f.key_no AND o.i = f.i + 1)),
flows AS (
    SELECT o.key_a, o.port_a, o.key_b, o.port_b, o.proto, f.flow_no, min_by(o.ip_a, o.i) AS ip_a, min_by(o.ip_b, o.i) AS ip_b, min_by(o.app, o.i) AS app, max_by(f.state, o.i) AS state,
        min(o.ts_us) AS first_us, max(o.ts_us) AS last_us, count(*) FILTER (o.fwd) AS packets_fwd, count(*) FILTER (NOT o.fwd) AS packets_rev,
        coalesce(sum(o.len) FILTER (o.fwd), 0)::BIGINT AS bytes_fwd, coalesce(sum(o.len) FILTER (NOT o.fwd), 0)::BIGINT AS bytes_rev
    FROM ordered o JOIN fold f USING (key_no, i) GROUP BY ALL),
measured AS (SELECT *, packets_fwd + packets_rev AS total_packets, bytes_fwd + bytes_rev AS total_bytes, (last_us - first_us) // 1000 AS duration_ms FROM flows),
ending AS (
    SELECT *, last_us + 1000000 * CASE proto WHEN 'Tcp' THEN CASE state WHEN 'Established' THEN 300 WHEN 'New' THEN 60 ELSE 15 END WHEN 'Udp' THEN 30 WHEN 'Icmp' THEN 10 ELSE 120 END AS end_us,
        flow_no < max(flow_no) OVER (PARTITION BY key_a, port_a, key_b, port_b, proto) AS older FROM measured)"""
WITH_FLOWS = f"WITH RECURSIVE {PACKETS_SQL}, {FLOWS_SQL}"
NOW_US = 1704067200000000 + 1_500_000_000
FLOW = "key_a, port_a, key_b, port_b, proto, flow_no"
from_packets("canonical_key", f"{WITH}, {KEYED_SQL} SELECT pkt_id, key_a, port_a, key_b, port_b, proto, src_key = key_a AS fwd FROM tupled", lambda p: flows.canonical(p).select("pkt_id", *flows.KEY, "fwd"))
from_packets("flow_table", f"{WITH_FLOWS} SELECT * FROM flows", flows.flow_table)
LATE = FLOWS_SQL[FLOWS_SQL.index("o.ts_us - f.ts_us >= ") : FLOWS_SQL.index(" AS late")]
TICK_LATE = f"(f.ts_us + {LATE.removeprefix('o.ts_us - f.ts_us >= ')} + 29999999) // 30000000 * 30000000 < o.ts_us"
from_packets("flow_table_ticks", f"WITH RECURSIVE {PACKETS_SQL}, {FLOWS_SQL.replace(LATE, TICK_LATE)} SELECT * FROM flows", lambda p: flows.flow_table(p, tick_s=30))
from_packets("flow_active_at", f"WITH RECURSIVE {PACKETS_SQL.replace('FROM sided)', f'FROM sided WHERE ts_us <= {NOW_US})')}, {FLOWS_SQL} SELECT {FLOW}, last_us, state FROM ending WHERE NOT older AND end_us > {NOW_US}",
             lambda p: flows.active(p, NOW_US).select(*flows.KEY, "flow_no", "last_us", "state"))
from_packets("flow_active_count", f"WITH RECURSIVE {PACKETS_SQL.replace('FROM sided)', f'FROM sided WHERE ts_us <= {NOW_US})')}, {FLOWS_SQL} SELECT count(*) AS active FROM ending WHERE NOT older AND end_us > {NOW_US}",
             lambda p: flows.active(p, NOW_US).agg(F.count("*").alias("active")))
for _by, _n in (("total_bytes", 30), ("total_packets", 30), ("duration_ms", 30), ("total_bytes", 50)):
    _name = f"flow_top_{_by.split('_')[-2 if _by == 'duration_ms' else -1]}" + ("_50" if _n == 50 else "")
    from_packets(_name, f"{WITH_FLOWS} SELECT {FLOW}, {_by} FROM measured ORDER BY {_by} DESC, {FLOW} LIMIT {_n}", lambda p, b=_by, n=_n: flows.top_flows(flows.flow_table(p), b, n).select(*flows.KEY, "flow_no", b))
from_packets("flow_state_counts", f"{WITH_FLOWS} SELECT state, count(*) AS flows, sum(total_packets)::BIGINT AS packets FROM measured GROUP BY state",
             lambda p: flows.with_measures(flows.flow_table(p)).groupBy("state").agg(F.count("*").alias("flows"), F.sum("total_packets").alias("packets")))
from_packets("flow_evicted", f"{WITH_FLOWS} SELECT {FLOW}, total_bytes FROM ending WHERE older OR end_us <= {NOW_US + 10**9}",
             lambda p: flows.with_measures(flows.evicted(flows.flow_table(p), NOW_US + 10**9)).select(*flows.KEY, "flow_no", "total_bytes"))

# Alerts.

ALERT = "pkt_id, ts_us, src_ip, dst_ip, src_port, dst_port"
VERTICAL = "(SELECT *, sum(f) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us, pkt_id ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us, pkt_id) = 1 THEN 1 ELSE 0 END AS f FROM packets WHERE dst_port IS NOT NULL))"
HORIZONTAL = "(SELECT *, sum(f) OVER (PARTITION BY src_ip, dst_port ORDER BY ts_us, pkt_id ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY src_ip, dst_port, dst_ip ORDER BY ts_us, pkt_id) = 1 THEN 1 ELSE 0 END AS f FROM packets WHERE dst_port IS NOT NULL))"
NTH = "(SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, pkt_id) AS n FROM packets WHERE {})"
RULES_SQL = {
    "alert_syn_flood": ("SynFlood", 1, "High", "SynFlood", "'SYN flood from ' || src_ip || ': 200 SYNs'", NTH.format("l4 = 'Tcp' AND syn AND NOT ack"), "n = 200"),
    "alert_icmp_flood": ("IcmpFlood", 2, "Medium", "IcmpFlood", "'ICMP flood from ' || src_ip", NTH.format("l4 = 'Icmp'"), "n = 200"),
    "alert_bad_ttl": ("BadTtl", 3, "Low", "AbnormalTtl", "'TTL=' || ttl", "packets", "coalesce(ttl, 128) <= 1 AND l4 IS DISTINCT FROM 'Icmp'"),
    "alert_suspicious_port": ("SuspPort", 4, "Medium", "SuspiciousPort", "'Suspicious port ' || dst_port", "packets", "dst_port IN (4444, 31337, 1337, 6667, 9001, 9030, 14433)"),
    "alert_vertical_scan": ("VerticalScan", 5, "High", "PortScan", "'Vertical port scan: ' || src_ip || ' → ' || dst_ip || ', 20 ports'", VERTICAL, "n = 20"),
    "alert_horizontal_scan": ("HorizontalScan", 6, "High", "PortScan", "'Horizontal port scan: ' || src_ip || ' port ' || dst_port || ' → 15 hosts'", HORIZONTAL, "n = 15"),
    "alert_dns_exfil": ("DnsExfil", 7, "High", "DnsExfiltration", "'DNS exfiltration: payload ' || payload_len || ' bytes (threshold 80)'", "packets", "app = 'Dns' AND l4 = 'Udp' AND payload_len > 80"),
}


def rule_sql(name: str) -> str:
    rule, order, severity, category, message, source, condition = RULES_SQL[name]
    return f"SELECT pkt_id, ts_us, {order} AS rule_ord, '{rule}' AS rule, '{severity}' AS severity, '{category}' AS category, {message} AS message, src_ip, dst_ip, src_port, dst_port FROM {source} WHERE {condition}"


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "alert_syn_flood": alerts.syn_flood,
    "alert_icmp_flood": lambda p: alerts.icmp_flood(p, 200),
    "alert_bad_ttl": lambda p: alerts.stateless(p, [alerts.bad_ttl()]),
    "alert_suspicious_port": lambda p: alerts.stateless(p, [alerts.suspicious_port()]),
    "alert_vertical_scan": alerts.vertical_scan,
    "alert_horizontal_scan": alerts.horizontal_scan,
    "alert_dns_exfil": lambda p: alerts.stateless(p, [alerts.dns_exfil()]),
}
for _name, _f in RULES.items():
    from_packets(_name, f"{WITH} {rule_sql(_name)}", _f)
DPI_SQL = """CASE WHEN regexp_matches(payload_hex, '^(47455420|504f535420|4845414420|50555420|485454502f)') THEN 'HTTP' WHEN payload_hex LIKE '1603__%' THEN 'TLS'
    WHEN length(payload_hex) >= 24 AND (src_port = 53 OR dst_port = 53) THEN 'DNS' WHEN payload_hex LIKE '5353482d%' THEN 'SSH'
    WHEN regexp_matches(payload_hex, '^[c-f].(00000001|ff0000..)') THEN 'QUIC' WHEN payload_hex LIKE '01000000%' AND (src_port = 51820 OR dst_port = 51820) THEN 'WireGuard' END"""


def with_payload(p: DataFrame) -> DataFrame:
    p = p.withColumn("dpi", payloads.classify(F.unhex("payload_hex")))
    return p.withColumn("dpi_app", F.when(F.col("dpi.protocol") == "TLS", "Https").otherwise(F.coalesce("dpi.protocol", F.lit("Unknown"))))


from_packets("dpi_classify", f"{WITH} SELECT pkt_id, {DPI_SQL} AS protocol, CASE WHEN {DPI_SQL} IN ('DNS', 'WireGuard') THEN 'Medium' WHEN {DPI_SQL} IS NOT NULL THEN 'High' END AS confidence FROM packets", lambda p: with_payload(p).select("pkt_id", "dpi.protocol", "dpi.confidence"))
from_packets("dpi_dist", f"{WITH} SELECT coalesce({DPI_SQL}, 'Unknown') AS protocol, count(*) AS packets FROM packets GROUP BY 1", lambda p: with_payload(p).groupBy(F.coalesce("dpi.protocol", F.lit("Unknown")).alias("protocol")).agg(F.count("*").alias("packets")))
TLS_SQL = f"SELECT pkt_id, ts_us, 'TLS port ' || dst_port || ' carrying ' || dpi_app || ' — possible tunnel' AS message FROM (SELECT *, CASE {DPI_SQL} WHEN 'TLS' THEN 'Https' ELSE coalesce({DPI_SQL}, 'Unknown') END AS dpi_app FROM packets) WHERE dst_port IN (443, 8443) AND l4 = 'Tcp' AND dpi_app NOT IN ('Https', 'Unknown')"
from_packets("alert_tls_anomaly", f"{WITH} {TLS_SQL}", lambda p: alerts.stateless(with_payload(p), [alerts.tls_anomaly("dpi_app")]).select("pkt_id", "ts_us", "message"))
ALL_RULES = " UNION ALL ".join(f"({rule_sql(n)})" for n in RULES_SQL)
NUMBERED_SQL = f"numbered AS (SELECT *, row_number() OVER (ORDER BY ts_us, pkt_id, rule_ord) AS id FROM ({ALL_RULES}))"
numbered = lambda p: alerts.numbered(alerts.packet_alerts(p, icmp=200))
from_packets("alerts_all_ordered", f"{WITH}, {NUMBERED_SQL} SELECT * FROM numbered", numbered)
from_packets("alerts_severe", f"{WITH}, {NUMBERED_SQL} SELECT severity, count(*) AS alerts FROM numbered WHERE severity IN ('High', 'Critical') GROUP BY severity", lambda p: alerts.at_least(alerts.packet_alerts(p, icmp=200), "High").groupBy("severity").agg(F.count("*").alias("alerts")))
LARGE_SQL = "'Large transfer: ' || total_bytes // 1048576 || ' MB in flow ' || ip_a || ':' || port_a || ' → ' || ip_b || ':' || port_b AS message"
from_packets("alert_large_transfer", f"{WITH_FLOWS} SELECT last_us AS ts_us, {LARGE_SQL}, ip_a AS src_ip, ip_b AS dst_ip, port_a AS src_port, port_b AS dst_port FROM ending WHERE total_bytes >= 4000 AND (older OR end_us <= {NOW_US + 10**9})",
             lambda p: alerts.large_transfer(flows.evicted(flows.flow_table(p), NOW_US + 10**9), 4000).drop("rule", "severity", "category"))

# Lists, rules and ranges.

BLOCKLIST = ["# test entries", "9.0.0.2", "192.168.1.0/30", "10.0.0.0/8", "fe80::/10", "Example.COM", "192.168.3.4"]
LISTED_SQL = "listed AS (SELECT *, {0}_key IN ('409000002', '4c0a80304') OR {0}_key BETWEEN '4c0a80100' AND '4c0a80103' AS hit_{0} FROM {1})"
BOTH_LISTED = f"{LISTED_SQL.format('src', 'packets')}, {LISTED_SQL.replace('listed AS', 'both_listed AS').format('dst', 'listed')}"
blocked = lambda p: lists.blocklist(p.sparkSession.createDataFrame([(x,) for x in BLOCKLIST], "value string"))


def with_blocklist(f: Callable) -> Callable[[DataFrame], DataFrame]:
    return lambda p: f(p, *[blocked(p)[k] for k in ("ips", "nets")])


from_packets("blacklist_hits", f"{WITH}, {BOTH_LISTED} SELECT pkt_id, CASE WHEN hit_src THEN src_ip ELSE dst_ip END AS hit FROM both_listed WHERE hit_src OR hit_dst", with_blocklist(lambda p, i, n: enrich.blocklist_hits(p, i, n).select("pkt_id", "hit")))
from_packets("blacklist_anti", f"{WITH}, {BOTH_LISTED} SELECT pkt_id FROM both_listed WHERE NOT hit_src AND NOT hit_dst", with_blocklist(lambda p, i, n: enrich.blocklist_misses(p, i, n).select("pkt_id")))
from_packets("blacklist_ip", f"{WITH} SELECT pkt_id FROM packets WHERE src_key IN ('409000002', '4c0a80304')", lambda p: p.withColumn("key", ip_key(F.col("src_ip"))).join(blocked(p)["ips"], "key", "left_semi").select("pkt_id"))
from_packets("blacklist_cidr", f"{WITH} SELECT DISTINCT ip FROM (SELECT unnest([src_ip, dst_ip]) AS ip, unnest([src_key, dst_key]) AS key FROM packets) WHERE key BETWEEN '4c0a80100' AND '4c0a80103'",
             lambda p: enrich.listed_addresses(enrich.distinct_addresses(p), blocked(p)["ips"].limit(0), blocked(p)["nets"]).select("ip"))
from_packets("blacklist_alerts", f"{WITH}, {BOTH_LISTED} SELECT pkt_id, 'Critical' AS severity, 'SuspiciousPort' AS category, 'Blacklisted IP: ' || CASE WHEN hit_src THEN src_ip ELSE dst_ip END AS message FROM both_listed WHERE hit_src OR hit_dst",
             with_blocklist(lambda p, i, n: enrich.blocklist_alerts(p, i, n).select("pkt_id", "severity", "category", "message")))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS domain FROM pages WHERE lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) IN (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) FROM pages WHERE page_id % 7 = 0)")
def blacklist_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose host is on a list; the list is the hosts of every seventh page, in upper case."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("domain"))
    banned = pages.where("page_id % 7 = 0").select(F.upper("domain").alias("domain"))
    return enrich.listed_domains(pages, banned).select("page_id", F.lower("domain").alias("domain"))


RULE_LINES = [
    "# rules", 'alert tcp any any -> any 4444 (msg:"Shell port"; sid:1001; rev:1;)', 'alert udp any any -> any 53 (msg:"DNS query"; sid:1002;)',
    'alert tcp 9.0.0.1 any -> any 1000:1020 (msg:"Low ports"; sid:1003;)', 'alert tcp any any -> $HOME_NET 443 (msg:"TLS"; content:"x"; sid:1004;)', "broken line", 'alert icmp 10.0.0.0/8 any -> any any (msg:"Ping"; sid:1005;)',
]
SIDS = "CASE WHEN l4 = 'Tcp' AND dst_port = 4444 THEN 1001 WHEN l4 = 'Udp' AND dst_port = 53 THEN 1002 WHEN l4 = 'Tcp' AND src_ip = '9.0.0.1' AND dst_port BETWEEN 1000 AND 1020 THEN 1003 WHEN l4 = 'Tcp' AND dst_port = 443 THEN 1004 WHEN l4 = 'Icmp' THEN 1005 END"
MSGS = "CASE sid WHEN 1001 THEN 'Shell port' WHEN 1002 THEN 'DNS query' WHEN 1003 THEN 'Low ports' WHEN 1004 THEN 'TLS' ELSE 'Ping' END"
from_packets("suricata_first_match", f"{WITH} SELECT pkt_id, sid::BIGINT AS sid, '[sid:' || sid || '] ' || {MSGS} AS message FROM (SELECT *, {SIDS} AS sid FROM packets) WHERE sid IS NOT NULL",
             lambda p: enrich.rule_alerts(p, lists.parse_rules(RULE_LINES)).select("pkt_id", "sid", "message"))
GEO = [("9.0.0.0", "9.0.0.1", "US", "Org A"), ("9.0.0.3", "9.0.0.255", "DE", "Org B"), ("192.168.0.0", "192.168.1.255", "FR", "Org C"), ("192.168.3.2", "192.168.3.3", "ES", "Org D"), ("2001:db8::", "2001:db8::ffff", "JP", "Org E")]
geo = lambda p: p.sparkSession.createDataFrame(GEO, "first string, last string, country string, asn_org string").select(ip_key(F.col("first")).alias("lo"), ip_key(F.col("last")).alias("hi"), "country", "asn_org")
GEO_SQL = "CASE WHEN {0} BETWEEN '409000000' AND '409000001' THEN '{1}' WHEN {0} BETWEEN '409000003' AND '4090000ff' THEN '{2}' WHEN {0} BETWEEN '4c0a80000' AND '4c0a801ff' THEN '{3}' WHEN {0} BETWEEN '4c0a80302' AND '4c0a80303' THEN '{4}' END"
for _name, _value, _values in (("geo_country", "country", ("US", "DE", "FR", "ES")), ("geo_asn", "asn_org", ("Org A", "Org B", "Org C", "Org D"))):
    from_packets(_name, f"{WITH} SELECT pkt_id, {GEO_SQL.format('src_key', *_values)} AS src_{_value}, {GEO_SQL.format('dst_key', *_values)} AS dst_{_value} FROM packets",
                 lambda p, v=_value: enrich.located(p, geo(p), [v]).select("pkt_id", f"src_{v}", f"dst_{v}"))

# Output forms and scalar functions.

STAMP = "strftime(make_timestamp({}), '%Y-%m-%dT%H:%M:%S.') || lpad(({} % 1000000 // 1000)::VARCHAR, 3, '0') || 'Z'"
CATEGORY_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.EVE_CATEGORY.items()) + " END"
from_packets("eve_alert_fields", f"{WITH}, {NUMBERED_SQL} SELECT {STAMP.format('ts_us', 'ts_us')} AS timestamp, 'alert' AS event_type, src_ip, src_port, dst_ip AS dest_ip, dst_port AS dest_port, id AS signature_id, message AS signature, {CATEGORY_SQL} AS category, CASE severity WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 ELSE 4 END AS severity FROM numbered",
             lambda p: eve.alert_fields(numbered(p)).select("timestamp", "event_type", "src_ip", "src_port", "dest_ip", "dest_port", "alert.signature_id", "alert.signature", "alert.category", "alert.severity"))
from_packets("eve_flow_fields", f"{WITH_FLOWS} SELECT {STAMP.format('last_us', 'last_us')} AS timestamp, 'flow' AS event_type, ip_a AS src_ip, port_a AS src_port, ip_b AS dest_ip, port_b AS dest_port, upper(proto) AS proto, packets_fwd AS pkts_toserver, packets_rev AS pkts_toclient, bytes_fwd AS bytes_toserver, bytes_rev AS bytes_toclient, {STAMP.format('first_us', 'first_us')} AS start, {STAMP.format('last_us', 'last_us')} AS \"end\", lower(state) AS state FROM flows",
             lambda p: eve.flow_fields(flows.flow_table(p)).select("timestamp", "event_type", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "flow.*"))


def json_sql(fields: str, nested: tuple[str, str]) -> str:
    """SQL text that writes columns (name, name=expression, and a trailing # for numbers) as a JSON line without nulls, and one nested object at the end."""

    def members(names: str) -> str:
        out = []
        for f in names.split():
            name, _, value = f.rstrip("#").partition("=")
            quote = "" if f.endswith("#") else '"'
            out.append(f"""'"{name}":{quote}' || {value or f'"{name}"'} || '{quote}'""")
        return f"array_to_string(list_filter([{', '.join(out)}], lambda x: x IS NOT NULL), ',')"

    return f"""'{{' || {members(fields)} || ',"{nested[0]}":{{' || {members(nested[1])} || '}}}}' AS value"""


ALERT_JSON = json_sql("timestamp event_type src_ip src_port# dest_ip dest_port#", ("alert", "action='allowed' gid=1# signature_id# rev=1# signature category severity#"))
FLOW_JSON = json_sql("timestamp event_type src_ip src_port# dest_ip dest_port# proto", ("flow", "pkts_toserver# pkts_toclient# bytes_toserver# bytes_toclient# start end state"))
from_packets("eve_alert_json", SQL["eve_alert_fields"].replace("SELECT strftime", f"SELECT {ALERT_JSON} FROM (SELECT strftime", 1) + ")", lambda p: eve.json_lines(eve.alert_fields(numbered(p))))
from_packets("eve_flow_json", SQL["eve_flow_fields"].replace("SELECT strftime", f"SELECT {FLOW_JSON} FROM (SELECT strftime", 1) + ")", lambda p: eve.json_lines(eve.flow_fields(flows.flow_table(p))))
CLOCK = "strftime(make_timestamp(ts_us), '%H:%M:%S.') || lpad((ts_us % 1000000)::VARCHAR, 6, '0')"
from_packets("read_lines", f"{WITH} SELECT pkt_id, {CLOCK} || ' Some(' || l4 || ') ' || src_ip || ':' || coalesce(src_port, 0) || ' → ' || dst_ip || ':' || coalesce(dst_port, 0) || ' ' || len || ' bytes' AS line FROM packets", lambda p: p.select("pkt_id", eve.read_line().alias("line")))
from_packets("capture_lines", f"{WITH} SELECT pkt_id, '[' || substr({CLOCK}, 1, 12) || '] events ' || l4 || ' ' || src_ip || ':' || coalesce(src_port, 0) || ' → ' || dst_ip || ':' || coalesce(dst_port, 0) || ' (' || len || ' bytes)' AS line FROM packets", lambda p: p.select("pkt_id", eve.capture_line().alias("line")))
HUMAN = "CASE WHEN n >= 1073741824 THEN printf('%.1fG', n / 1073741824) WHEN n >= 1048576 THEN printf('%.1fM', n / 1048576) WHEN n >= 1024 THEN printf('%.1fK', n / 1024) ELSE n || 'B' END"
from_packets("humanize_bytes", f"{WITH} SELECT pkt_id, n, {HUMAN} AS human FROM (SELECT pkt_id, len::BIGINT * len * (pkt_id % 5) * (pkt_id % 11) AS n FROM packets)",
             lambda p: p.select("pkt_id", (F.col("len").cast("bigint") * F.col("len") * (F.col("pkt_id") % 5) * (F.col("pkt_id") % 11)).alias("n")).withColumn("human", P.humanize_bytes(F.col("n"))))
from_packets("ip_keys", f"{WITH} SELECT DISTINCT src_ip, src_key FROM packets", lambda p: p.select("src_ip", ip_key(F.col("src_ip")).alias("src_key")).distinct())
from_packets("ip6_text", f"{WITH} SELECT pkt_id, '2001:db8::' || CASE WHEN pkt_id + 1 > 65535 THEN lower(printf('%x', (pkt_id + 1) >> 16)) || ':' ELSE '' END || lower(printf('%x', (pkt_id + 1) & 65535)) AS ip FROM packets", lambda p: p.select("pkt_id", v6_text(F.concat(F.lit("20010db8"), F.lpad(F.lower(F.hex(F.col("pkt_id") + 1)), 24, "0"))).alias("ip")))

# Bytes: frames are made from the packets view and decoded again, so the view is what must come out.


def raw_frames(p: DataFrame) -> DataFrame:
    return p.withColumn("tcp_seq", F.col("pkt_id")).select("pkt_id", "ts_us", "interface", encode.frame(F.col("payload_hex")).alias("data"))


DECODED = ["pkt_id", "ts_us", "interface", "l3", "l4", "app", "src_ip", "dst_ip", "src_port", "dst_port", "ttl", "syn", "ack", "fin", "rst", "psh", "urg"]
DECODED_SQL = f"SELECT {', '.join(c if c not in ('syn', 'ack', 'fin', 'rst', 'app') else f'''CASE WHEN l4 = 'Tcp' THEN {c} ELSE false END AS {c}''' if c != 'app' else 'app' for c in DECODED)}, length(payload_hex) // 2 AS payload_len, payload_hex FROM packets"
from_packets("decode_packets", f"{WITH} {DECODED_SQL}", lambda p: decode.decode_frames(raw_frames(p)).select(*DECODED, "payload_len", F.lower(F.hex("payload")).alias("payload_hex")))
from_packets("decode_checksum", f"{WITH} SELECT pkt_id, false AS ok, 2048 AS ethertype FROM packets", lambda p: raw_frames(p).select("pkt_id", decode.ipv4(F.col("data"), 14)["checksum_ok"].alias("ok"), decode.ethernet(F.col("data"))["ethertype"].alias("ethertype")))
from_packets("decode_checksum_real", f"{WITH} SELECT pkt_id, pkt_id % 3 <> 0 AS ok, CASE WHEN pkt_id % 3 <> 0 THEN 0 ELSE 1 END AS wrong FROM packets",
             lambda p: raw_frames(p).select("pkt_id", decode.ipv4(encode.with_checksum(F.col("data"), F.col("pkt_id") % 3 == 0), 14)["checksum_ok"].alias("ok"), (F.col("pkt_id") % 3 == 0).cast("int").alias("wrong")))


def frames6(p: DataFrame) -> DataFrame:
    """The packets view over IPv6, from 2001:db8::1:x to fe80::y, with no, one or two VLAN tags."""
    src = F.concat(F.lit("20010db80000000000000000"), F.lpad(F.lit("1"), 4, "0"), F.lpad(F.hex(F.col("pkt_id") % 65535 + 1), 4, "0"))
    dst = F.concat(F.lit("fe80"), F.lpad(F.hex(F.col("pkt_id") % 1000 + 1), 28, "0"))
    data = encode.frame6(src, dst, F.col("payload_hex"), (F.col("pkt_id") % 3).cast("int"), F.col("pkt_id") % 4096)
    return p.withColumn("tcp_seq", F.col("pkt_id")).select("pkt_id", "ts_us", "interface", data.alias("data"))


V6_SQL = "'2001:db8::1:' || lower(to_hex(pkt_id % 65535 + 1)) AS src_ip, 'fe80::' || lower(to_hex(pkt_id % 1000 + 1)) AS dst_ip"
from_packets("decode_ipv6", f"{WITH} SELECT pkt_id, 'IPv6' AS l3, CASE l4 WHEN 'Icmp' THEN 'IcmpV6' ELSE l4 END AS l4, {V6_SQL}, src_port, dst_port, app, length(payload_hex) // 2 AS payload_len, payload_hex FROM packets",
             lambda p: decode.decode_frames(frames6(p)).select("pkt_id", "l3", "l4", "src_ip", "dst_ip", "src_port", "dst_port", "app", "payload_len", F.lower(F.hex("payload")).alias("payload_hex")))
from_packets("decode_vlan", f"{WITH} SELECT pkt_id, CASE WHEN pkt_id % 3 > 0 THEN pkt_id % 4096 END AS vlan_id, 34525 AS ethertype, 14 + 4 * (pkt_id % 3) AS consumed, ttl AS hop_limit, {V6_SQL.replace('src_ip', 'src').replace('dst_ip', 'dst')} FROM packets",
             lambda p: frames6(p).withColumn("e", decode.ethernet(F.col("data"))).withColumn("ip", decode.ipv6(F.col("data"), F.col("e.consumed"))).select("pkt_id", "e.vlan_id", "e.ethertype", "e.consumed", "ip.hop_limit", "ip.src", "ip.dst"))
from_packets("decode_icmp", f"{WITH} SELECT pkt_id, pkt_id % 41 AS type, pkt_id % 17 AS code, (pkt_id * 7919) % 65536 AS checksum, pkt_id AS rest FROM packets",
             lambda p: p.select("pkt_id", decode.icmp(F.unhex(F.concat(encode.big_endian(F.col("pkt_id") % 41, 1), encode.big_endian(F.col("pkt_id") % 17, 1), encode.big_endian(F.col("pkt_id") * 7919 % 65536, 2), encode.big_endian(F.col("pkt_id"), 4)))).alias("i")).select("pkt_id", "i.type", "i.code", "i.checksum", "i.rest"))
#: Accept TCP packets to port 443 or 4444, by the fields of an untagged IPv4 frame.
PROGRAM = [(0x28, 0, 0, 12), (0x15, 0, 7, 0x800), (0x30, 0, 0, 23), (0x15, 0, 5, 6), (0xB1, 0, 0, 14), (0x48, 0, 0, 16), (0x15, 1, 0, 443), (0x15, 0, 1, 4444), (0x06, 0, 0, 65535), (0x06, 0, 0, 0)]
from_packets("bpf_exec", f"{WITH} SELECT pkt_id, CASE WHEN l4 = 'Tcp' AND dst_port IN (443, 4444) THEN 65535 ELSE 0 END::BIGINT AS accepted FROM packets", lambda p: raw_frames(p).select("pkt_id", bpf.accepted(PROGRAM, F.col("data")).alias("accepted")))
HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1))"


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)).alias("host"))


@query(f"SELECT page_id, {HOST_SQL} AS name, 1 AS qdcount FROM pages")
def dns_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = hosts(spark, sf_dir).select("page_id", encode.dns_question(F.col("host")).alias("m"))
    return messages.select("page_id", names.dns_query_name("m").alias("name"), decode.dns_header(F.col("m"))["qdcount"].alias("qdcount"))


@query(f"SELECT page_id, 'www.' || {HOST_SQL} AS name, 1 AS qdcount FROM pages")
def dns_compressed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = hosts(spark, sf_dir).select("page_id", encode.dns_compressed(F.col("host")).alias("m"))
    return messages.select("page_id", names.dns_query_name("m").alias("name"), decode.dns_header(F.col("m"))["qdcount"].alias("qdcount"))


@query(f"SELECT page_id, {HOST_SQL} AS name, 772 AS version FROM pages")
def tls_sni(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = hosts(spark, sf_dir).select("page_id", names.tls_fields(encode.hello(F.col("host"))).alias("t"))
    return records.select("page_id", F.col("t.server_name").alias("name"), F.col("t.highest_version").alias("version"))


SEGMENT, SCAN_BYTES = 1000, 256 << 10


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS md5 FROM documents WHERE length(text) > 0")
def reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is sent as a TCP stream of SEGMENT-byte segments, every pair of them swapped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("b"))
    pieces = docs.select("doc_id", "b", F.explode(F.sequence(F.lit(-1), F.floor(F.octet_length("b") / SEGMENT).cast("int"))).alias("i"))
    ip = F.concat_ws(".", F.lit("10"), *[(F.shiftright("doc_id", s) % 256).cast("string") for s in (16, 8, 0)])
    order = F.when(F.col("i") < 0, F.lit(-1)).otherwise(F.col("i").bitwiseXOR(F.lit(1)))
    segments = pieces.select(
        "doc_id", (F.col("doc_id") * 100_000 + order + 1).alias("pkt_id"), (order + 1).cast("bigint").alias("ts_us"), F.lit("Tcp").alias("l4"), ip.alias("src_ip"), F.lit("11.0.0.1").alias("dst_ip"),
        F.lit(1000).alias("src_port"), F.lit(80).alias("dst_port"), (F.col("i") < 0).alias("syn"), F.lit(False).alias("fin"), F.lit(False).alias("rst"),
        F.when(F.col("i") < 0, 0).otherwise(F.col("i") * SEGMENT + 1).cast("bigint").alias("tcp_seq"),
        F.when(F.col("i") >= 0, F.substring(F.col("b"), F.greatest(F.col("i"), F.lit(0)) * SEGMENT + 1, F.lit(SEGMENT))).otherwise(F.lit(bytearray())).alias("payload"),
    )
    emitted = reassembly.reassemble(segments, cap=None)  # texts are to come back whole
    whole = emitted.groupBy(F.floor(F.col("pkt_id") / 100_000).cast("bigint").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("pkt_id", F.hex("data").alias("h")))).alias("parts"))
    text = F.unhex(F.array_join(F.transform("parts", lambda x: x["h"]), ""))
    return whole.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.md5(text).alias("md5"))


@query(f"{WITH} SELECT pkt_id, ts_us, length(payload_hex) // 2 + CASE l4 WHEN 'Tcp' THEN 54 ELSE 42 END AS len FROM packets")
def pcap_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets view written to capture files in the scratch folder and read back."""
    raw = raw_frames(packets(spark, sf_dir)).withColumns({"seq": F.col("pkt_id"), "wire_len": F.length("data").cast("bigint"), "link": F.lit(1).cast("bigint")})
    folder = scratch(spark)
    pcap.write_pcap(raw.withColumn("interface", F.concat(F.lit("if"), F.col("pkt_id") % 4)), folder, "view", max_mb=1).collect()
    back = decode.decode_frames(pcap.read_pcap(spark, folder + "/*.pcap").withColumn("pkt_id", F.lit(0).cast("bigint")))
    own = packets(spark, sf_dir).select(F.col("pkt_id").alias("own_id"), "ts_us", "src_ip", "dst_ip", "l4")
    return back.drop("pkt_id").join(own, ["ts_us", "src_ip", "dst_ip", "l4"]).select(F.col("own_id").alias("pkt_id"), "ts_us", F.col("len").cast("bigint").alias("len"))


@query(f"{WITH} SELECT substr(md5('if' || pkt_id % 4), 1, 8) AS tag, row_number() OVER (PARTITION BY pkt_id % 4 ORDER BY ts_us, pkt_id) - 1 AS seq, ts_us, length(payload_hex) // 2 + CASE l4 WHEN 'Tcp' THEN 54 ELSE 42 END AS len, src_port, dst_port FROM packets")
def capture_scan_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets view written to one capture for each of four interfaces, each of which is read in ranges of SCAN_BYTES."""
    raw = raw_frames(packets(spark, sf_dir)).withColumns({"seq": F.col("pkt_id"), "wire_len": F.length("data").cast("bigint"), "link": F.lit(1).cast("bigint")})
    folder = scratch(spark)
    pcap.write_pcap(raw.withColumn("interface", F.concat(F.lit("if"), F.col("pkt_id") % 4)), folder, "view").collect()
    back = capture_scan.scan_captures(spark, folder + "/*.pcap", SCAN_BYTES)
    got = decode.decode_frames(back.withColumn("pkt_id", F.col("seq")))
    return got.select(F.regexp_extract("interface", "view_([0-9a-f]+)_", 1).alias("tag"), F.col("pkt_id").alias("seq"), "ts_us", F.col("len").cast("bigint").alias("len"), "src_port", "dst_port")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, as a local path."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/netquill").removeprefix("file:")
    folder = f"/{root.lstrip('/')}/captures-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


ROTATE_SQL = f"""WITH RECURSIVE {PACKETS_SQL},
starts AS (
    SELECT 0::BIGINT AS file_no, min(ts_us) AS begins FROM packets
    UNION ALL SELECT s.file_no + 1, min(p.ts_us) FROM starts s JOIN packets p ON p.ts_us >= s.begins + 600000000 GROUP BY s.file_no),
files AS (SELECT file_no, begins, lead(begins) OVER (ORDER BY begins) AS ends FROM starts)
SELECT 'events' AS interface, file_no, count(*) AS packets, min(ts_us) AS first_us FROM packets JOIN files ON ts_us >= begins AND (ends IS NULL OR ts_us < ends) GROUP BY file_no"""
from_packets("rotate_assign", ROTATE_SQL, lambda p: pcap.rotated(raw_frames(p).withColumns({"seq": F.col("pkt_id"), "wire_len": F.length("data").cast("bigint"), "link": F.lit(1).cast("bigint")}), max_seconds=600).groupBy("interface", "file_no").agg(F.count("*").alias("packets"), F.min("ts_us").alias("first_us")))
from_packets("event_rules", f"{WITH} SELECT pkt_id, '[own] ' || src_ip AS message FROM packets WHERE len > 1400", lambda p: alerts.stateless(p, [F.when(F.col("len") > 1400, alerts.alert(99, "Own", "Low", "Own", F.concat(F.lit("[own] "), F.col("src_ip"))))]).select("pkt_id", "message"))
