"""Alerts as packets arrive: the same rules as over a table, with state for those that have memory.

Rules without memory need none. For the others each packet is an observation of a group (see
operators.alerts): a flood's group keeps a number, a scan's group the values it has shown, at
most as many as the threshold, as a group that has shown more never raises again and keeps only
the number. Observations are counted in the order of event time. With `idle`, a group that
was silent for so many seconds is forgotten and starts anew; without, counts last for ever,
as they do over a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessorHandle

from ..operators import alerts
from ..operators.alerts import HORIZONTAL, ICMP, SYN, VERTICAL
from .ordered import InOrder
from .session import timed

GROUP = ["rule_ord", "src_ip", "member"]


class Counter(InOrder):
    """The packets of one group that raise."""

    ROW = "ts_us bigint, pkt_id bigint, dst_ip string, src_port int, dst_port int, value string"
    OUT = "rule_ord int, src_ip string, ts_us bigint, pkt_id bigint, dst_ip string, src_port int, dst_port int"

    def __init__(self, thresholds: dict[int, int], idle_ms: int | None = None):
        super().__init__(idle_ms)
        self.thresholds = thresholds

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.number = handle.getValueState("number", "n bigint")
        self.values = handle.getMapState("values", "value string", "seen boolean")

    def forget(self) -> None:
        self.number.clear()
        self.values.clear()

    def feed(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        rule, source, _ = key
        most, n, out = self.thresholds[int(rule)], self.number.get()[0] if self.number.exists() else 0, []
        for ts_us, pkt_id, dst_ip, src_port, dst_port, value in rows:
            if n > most:
                break
            if rule in (SYN, ICMP):
                n += 1
                raises = n == most
            else:
                if not self.values.containsKey((value,)):
                    self.values.updateValue((value,), (True,))
                    n += 1
                raises = n == most
            if raises:
                out.append((rule, source, ts_us, pkt_id, dst_ip, src_port, dst_port))
        if n > most:
            self.values.clear()
        self.number.update((n,))
        return out


def stream_alerts(packets: DataFrame, syn: int = 200, icmp: int = 500, ports: int = 20, hosts: int = 15, dns: int = 80, app: str = "app", late: str = "10 seconds", idle: int | None = None) -> DataFrame:
    """What all packet rules raise, with the columns of packet_alerts. Needs the RocksDB state store.

    Alerts of rules with memory come when the watermark has passed their packet.
    """
    thresholds = {SYN: syn, ICMP: icmp, VERTICAL: ports, HORIZONTAL: hosts}
    seen = timed(alerts.observations(packets, list(thresholds)), late)
    hits = seen.groupBy(*GROUP).transformWithStateInPandas(Counter(thresholds, None if idle is None else idle * 1000), Counter.OUT, "Append", "EventTime")
    return alerts.raised(hits, alerts.remembered(thresholds)).unionByName(alerts.stateless(packets, alerts.packet_rules(dns, app)))
