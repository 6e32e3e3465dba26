"""Names of protocols, ports, states and severities, and scalar formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the names and numbers that users of the format know.
#: Application by destination port.
PORT_APPS = {
    "Http": [80, 8080], "Https": [443, 8443], "Dns": [53], "Dhcp": [67, 68], "Ssh": [22], "Ftp": [20, 21], "Smtp": [25, 587, 465], "Imap": [143, 993],
    "Pop3": [110, 995], "Rdp": [3389], "Smb": [445, 139], "Ntp": [123], "Mdns": [5353],
}
SUSPICIOUS_PORTS = [4444, 31337, 1337, 6667, 9001, 9030, 14433]
SEVERITY_RANK = {"Info": 0, "Low": 1, "Medium": 2, "High": 3, "Critical": 4}
EVE_SEVERITY = {"Info": 5, "Low": 4, "Medium": 3, "High": 2, "Critical": 1}
EVE_PROTO = {"Tcp": "TCP", "Udp": "UDP", "Icmp": "ICMP", "IcmpV6": "IPv6-ICMP", "Sctp": "SCTP"}
EVE_CATEGORY = {
    "PortScan": "Attempted Information Leak", "SynFlood": "Denial of Service Attack", "LargeTransfer": "Potentially Bad Traffic", "DnsExfiltration": "DNS Exfiltration",
    "TlsAnomalyNoSni": "TLS Anomaly", "SuspiciousPort": "Misc activity", "IcmpFlood": "Denial of Service Attack", "AbnormalTtl": "Potentially Bad Traffic",
}
#: Idle seconds after which a flow ends: TCP by state, other transports by name.
TCP_TIMEOUT = {"New": 60, "Established": 300, "Closing": 15, "Closed": 15}
TIMEOUT = {"Udp": 30, "Icmp": 10, "IcmpV6": 10}
OTHER_TIMEOUT = 120


def choose(value: Column, table: dict, otherwise: object) -> Column:
    """table[value], or otherwise."""
    out = F.lit(otherwise)
    for k, v in reversed(table.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def app_of_port(port: Column) -> Column:
    """The application by a destination port; Unknown for other ports and null."""
    out = F.lit("Unknown")
    for app, ports in reversed(PORT_APPS.items()):
        out = F.when(port.isin(ports), F.lit(app)).otherwise(out)
    return out


def is_syn_only() -> Column:
    return F.col("syn") & ~F.col("ack") & ~F.col("fin") & ~F.col("rst")


def is_connection_start() -> Column:
    """SYN without ACK; SYN with FIN counts, too."""
    return F.col("syn") & ~F.col("ack")


def humanize_bytes(n: Column) -> Column:
    """1024-based: 1.0G, 1.0M, 1.0K or 12B; ties round to even, as binary fractions do when printed."""

    def unit(bits: int, name: str) -> Column:
        tenths, size = n.cast("bigint") * 10, F.lit(1 << bits).cast("bigint")
        whole, rest = F.shiftright(tenths, bits), (tenths % size) * 2
        rounded = whole + F.when((rest > size) | ((rest == size) & (whole % 2 == 1)), 1).otherwise(0)
        return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"), F.lit(name))

    return F.when(n >= 1 << 30, unit(30, "G")).when(n >= 1 << 20, unit(20, "M")).when(n >= 1 << 10, unit(10, "K")).otherwise(F.concat(n.cast("string"), F.lit("B")))


def clock(ts_us: Column, digits: int) -> Column:
    """HH:MM:SS with 3 or 6 decimals (cut, not rounded)."""
    return F.date_format(F.timestamp_micros(ts_us), "HH:mm:ss." + "S" * digits)


def eve_time(ts_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(ts_us), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat(F.coalesce(ip, F.lit("?")), F.lit(":"), F.coalesce(port, F.lit(0)).cast("string"))
