"""Alert rules over packets and flows.

Rules without memory are one pass: each packet gets an array of what it raises, which is
exploded. Rules with memory look at observations: a packet counts for its source (floods), and
its port for its source and target, or its target for its source and port (scans). A flood is
the packet that makes a count equal to the threshold. A scan raises for every packet from the
one that shows the threshold-th different value until the one that shows another; these two
packets come from the first times of the values, an aggregation, of which a group needs only
the smallest few, so no task sorts the packets of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.protocols import SEVERITY_RANK, SUSPICIOUS_PORTS, choose, is_connection_start
from ..functions.staging import placed, staged

ARRIVAL = ["ts_us", "pkt_id"]
COLUMNS = ["pkt_id", "ts_us", "rule_ord", "rule", "severity", "category", "message", "src_ip", "dst_ip", "src_port", "dst_port"]


def alert(order: int, rule: str, severity: str, category: str, message: Column) -> Column:
    return F.struct(F.lit(order).alias("rule_ord"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"))


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def raised(packets: DataFrame, what: Column) -> DataFrame:
    return packets.select("pkt_id", "ts_us", what.alias("alert"), "src_ip", "dst_ip", "src_port", "dst_port").select("pkt_id", "ts_us", "alert.*", "src_ip", "dst_ip", "src_port", "dst_port").select(*COLUMNS)


SYN, ICMP, VERTICAL, HORIZONTAL = 1, 2, 5, 6
#: What rules with memory look at: rule_ord, src_ip and member name a group, value is what differs in it.
OBSERVED = ["pkt_id", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "rule_ord", "member", "value"]


def observations(packets: DataFrame, rules: list[int]) -> DataFrame:
    """A row for each packet and rule with memory that it counts for, with the packet's other columns OBSERVED needs."""
    known = F.col("src_ip").isNotNull()
    addressed = known & F.col("dst_ip").isNotNull() & F.col("dst_port").isNotNull()
    port, nothing = F.col("dst_port").cast("string"), F.lit(None).cast("string")
    of = {
        SYN: (known & (F.col("l4") == "Tcp") & is_connection_start(), F.lit(""), nothing),
        ICMP: (known & (F.col("l4") == "Icmp"), F.lit(""), nothing),
        VERTICAL: (addressed, F.col("dst_ip"), port),
        HORIZONTAL: (addressed, port, F.col("dst_ip")),
    }
    each = [F.when(c, F.struct(F.lit(r).alias("rule_ord"), m.alias("member"), v.alias("value"))) for r, (c, m, v) in of.items() if r in rules]
    return packets.select(*OBSERVED[:6], F.explode(F.array_compact(F.array(*each))).alias("o")).select(*OBSERVED[:6], "o.*")


def remembered(thresholds: dict[int, int]) -> Column:
    """The alert of an observation's rule."""
    words = {
        SYN: lambda n: alert(SYN, "SynFlood", "High", "SynFlood", joined("SYN flood from ", F.col("src_ip"), f": {n} SYNs")),
        ICMP: lambda n: alert(ICMP, "IcmpFlood", "Medium", "IcmpFlood", joined("ICMP flood from ", F.col("src_ip"))),
        VERTICAL: lambda n: alert(VERTICAL, "VerticalScan", "High", "PortScan", joined("Vertical port scan: ", F.col("src_ip"), " → ", F.col("dst_ip"), f", {n} ports")),
        HORIZONTAL: lambda n: alert(HORIZONTAL, "HorizontalScan", "High", "PortScan", joined("Horizontal port scan: ", F.col("src_ip"), " port ", F.col("dst_port"), f" → {n} hosts")),
    }
    return F.coalesce(*[F.when(F.col("rule_ord") == r, words[r](n)) for r, n in thresholds.items()])


def threshold_of(thresholds: dict[int, int]) -> Column:
    return choose(F.col("rule_ord"), thresholds, 0)


def floods(packets: DataFrame, thresholds: dict[int, int]) -> DataFrame:
    """The n-th packet of each source. Spark keeps only the first few of each task before the shuffle."""
    order = Window.partitionBy("rule_ord", "src_ip").orderBy(*ARRIVAL)
    nth = observations(packets, list(thresholds)).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(thresholds.values()))
    return raised(nth.where(F.col("nth") == threshold_of(thresholds)), remembered(thresholds))


def syn_flood(packets: DataFrame, threshold: int = 200) -> DataFrame:
    return floods(packets, {SYN: threshold})


def icmp_flood(packets: DataFrame, threshold: int = 500) -> DataFrame:
    return floods(packets, {ICMP: threshold})


def scans(packets: DataFrame, thresholds: dict[int, int]) -> DataFrame:
    """Packets that come while a group has shown exactly the threshold's number of values."""
    seen, group = observations(packets, list(thresholds)), ["rule_ord", "src_ip", "member"]
    at = F.struct(*ARRIVAL)
    firsts = seen.groupBy(*group, "value").agg(F.min(at).alias("at"))
    ranked = firsts.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("at"))).where(F.col("nth") <= max(thresholds.values()) + 1)
    n = threshold_of(thresholds)
    spans = ranked.groupBy(*group).agg(F.max(F.when(F.col("nth") == n, F.col("at"))).alias("begins"), F.max(F.when(F.col("nth") == n + 1, F.col("at"))).alias("ends")).where("begins is not null")
    hits = seen.join(spans, group).where((at >= F.col("begins")) & (F.col("ends").isNull() | (at < F.col("ends"))))
    return raised(hits, remembered(thresholds))


def vertical_scan(packets: DataFrame, threshold: int = 20) -> DataFrame:
    return scans(packets, {VERTICAL: threshold})


def horizontal_scan(packets: DataFrame, threshold: int = 15) -> DataFrame:
    return scans(packets, {HORIZONTAL: threshold})


def bad_ttl() -> Column:
    hit = (F.coalesce("ttl", F.lit(128)) <= 1) & ~F.col("l4").eqNullSafe("Icmp")
    return F.when(hit, alert(3, "BadTtl", "Low", "AbnormalTtl", joined("TTL=", F.coalesce("ttl", F.lit(0)))))


def suspicious_port() -> Column:
    return F.when(F.col("dst_port").isin(SUSPICIOUS_PORTS), alert(4, "SuspPort", "Medium", "SuspiciousPort", joined("Suspicious port ", F.col("dst_port"))))


def dns_exfil(most: int = 80) -> Column:
    hit = (F.col("app") == "Dns") & (F.col("l4") == "Udp") & (F.col("payload_len") > most)
    return F.when(hit, alert(7, "DnsExfil", "High", "DnsExfiltration", joined("DNS exfiltration: payload ", F.col("payload_len"), f" bytes (threshold {most})")))


def tls_anomaly(app: str = "app") -> Column:
    """app may name a column with what payloads show; by port alone the rule cannot fire."""
    hit = F.col("dst_port").isin(443, 8443) & (F.col("l4") == "Tcp") & ~F.col(app).isin("Https", "Unknown")
    return F.when(hit, alert(8, "TlsNoSni", "Medium", "TlsAnomalyNoSni", joined("TLS port ", F.col("dst_port"), " carrying ", F.col(app), " — possible tunnel")))


def stateless(packets: DataFrame, rules: list[Column]) -> DataFrame:
    """All rules without memory in one pass."""
    hits = packets.select("pkt_id", "ts_us", F.explode(F.array_compact(F.array(*rules))).alias("alert"), "src_ip", "dst_ip", "src_port", "dst_port")
    return hits.select("pkt_id", "ts_us", "alert.*", "src_ip", "dst_ip", "src_port", "dst_port").select(*COLUMNS)


def packet_alerts(packets: DataFrame, syn: int = 200, icmp: int = 500, ports: int = 20, hosts: int = 15, dns: int = 80, app: str = "app") -> DataFrame:
    """What all packet rules raise."""
    out = stateless(packets, packet_rules(dns, app))
    return out.unionByName(floods(packets, {SYN: syn, ICMP: icmp})).unionByName(scans(packets, {VERTICAL: ports, HORIZONTAL: hosts}))


def packet_rules(dns: int = 80, app: str = "app") -> list[Column]:
    """The rules without memory."""
    return [bad_ttl(), suspicious_port(), dns_exfil(dns), tls_anomaly(app)]


def numbered(alerts: DataFrame) -> DataFrame:
    """alerts with id from 1, in order of arrival and rule. They are written to the shared folder first, so the rules run once."""
    return placed(staged(alerts, "alerts"), ["ts_us", "pkt_id", "rule_ord"], "id").withColumn("id", (F.col("id") + 1).cast("bigint"))


def large_transfer(flows: DataFrame, threshold: int = 100 << 20) -> DataFrame:
    """Of flows (pass evicted ones to leave out live flows): those with so many bytes in all."""
    total = F.col("bytes_fwd") + F.col("bytes_rev")
    megabytes = F.floor(total / (1 << 20)).cast("bigint")
    text = joined("Large transfer: ", megabytes, " MB in flow ", F.col("ip_a"), ":", F.col("port_a"), " → ", F.col("ip_b"), ":", F.col("port_b"))
    return flows.where(total >= threshold).select(
        F.col("last_us").alias("ts_us"), F.lit("LargeTransfer").alias("rule"), F.lit("Medium").alias("severity"), F.lit("LargeTransfer").alias("category"), text.alias("message"),
        F.col("ip_a").alias("src_ip"), F.col("ip_b").alias("dst_ip"), F.col("port_a").alias("src_port"), F.col("port_b").alias("dst_port"),
    )


def at_least(alerts: DataFrame, severity: str) -> DataFrame:
    return alerts.where(choose(F.col("severity"), SEVERITY_RANK, -1) >= SEVERITY_RANK[severity])
