"""Packets as they arrive: rates, ended flows and fan-out to several sinks; see also alerts and reassembly.

Packet streams have the columns of a packets table; event time is ts_us. Late packets are
dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.protocols import OTHER_TIMEOUT, TCP_TIMEOUT, TIMEOUT
from ..operators import flows

STATE = "flow_no bigint, ip_a string, ip_b string, app string, state string, first_us bigint, last_us bigint, packets_fwd bigint, packets_rev bigint, bytes_fwd bigint, bytes_rev bigint"
ENDED = f"key_a string, port_a int, key_b string, port_b int, proto string, {STATE}"
NAMES = [x.split()[0] for x in STATE.split(", ")]


def timed(packets: DataFrame, late: str) -> DataFrame:
    return packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", late)


def stream_rates(packets: DataFrame, seconds: int = 1, late: str = "10 seconds") -> DataFrame:
    """Packets and bits per second in aligned intervals; append mode gives each interval once."""
    per = F.window("ts", f"{seconds} seconds")
    out = timed(packets, late).groupBy(per).agg(F.count("*").alias("n"), F.sum(F.col("len").cast("bigint")).alias("b"))
    return out.select(F.unix_micros("window.start").alias("start_us"), (F.col("n") / F.lit(float(seconds))).alias("pps"), (F.col("b") * 8 / F.lit(float(seconds))).alias("bps"))


def timeout_us(proto: str, state: str) -> int:
    return 1_000_000 * (TCP_TIMEOUT[state] if proto == "Tcp" else TIMEOUT.get(proto, OTHER_TIMEOUT))


class FlowProcessor(StatefulProcessor):
    """One key's live flow; a flow is emitted when the next packet comes too late for it, or its timer fires.

    Numbering the flows of a key takes a number for every key ever seen. Without it, flow_no is
    the time of a flow's first packet, and nothing is left of a key whose flow has ended.
    """

    def __init__(self, numbered: bool = True):
        self.numbered = numbered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", STATE)
        self.last_no = handle.getValueState("last_no", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["ts_us", "pkt_id"])
        flow = dict(zip(NAMES, self.live.get(), strict=True)) if self.live.exists() else None
        number = self.last_no.get()[0] if self.last_no.exists() else 0
        done = []
        for r in frame.itertuples():
            if flow and r.ts_us - flow["last_us"] >= timeout_us(key[4], flow["state"]):
                done.append(flow)
                flow = None
            if flow is None:
                number = number + 1 if self.numbered else int(r.ts_us)
                flow = dict.fromkeys(NAMES, 0) | {"flow_no": number, "ip_a": r.ip_a, "ip_b": r.ip_b, "app": r.app, "state": "New", "first_us": r.ts_us}
            side = "fwd" if r.fwd else "rev"
            flow[f"packets_{side}"] += 1
            flow[f"bytes_{side}"] += int(r.len)
            flow["last_us"] = int(r.ts_us)
            if r.sets:
                flow["state"] = r.sets
        if self.numbered:
            self.last_no.update((number,))
        self.live.update(tuple(flow[c] for c in NAMES))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((flow["last_us"] + timeout_us(key[4], flow["state"])) // 1000 + 1)
        yield self.records(key, done)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = [dict(zip(NAMES, self.live.get(), strict=True))] if self.live.exists() else []
        self.live.clear()
        yield self.records(key, done)

    def records(self, key: tuple, done: list[dict]) -> pd.DataFrame:
        columns = [x.split()[0] for x in ENDED.split(", ")]
        return pd.DataFrame([(*key, *(f[c] for c in NAMES)) for f in done], columns=columns)

    def close(self) -> None:
        pass


def ended_flows(packets: DataFrame, late: str = "10 seconds", numbered: bool = True) -> DataFrame:
    """Flows as they end. Needs the RocksDB state store, which holds one row for each live key, and if flows are numbered one for every key."""
    p = flows.canonical(packets).withColumn("sets", flows.stated())
    p = timed(p.select(*flows.KEY, "ts_us", "pkt_id", "ip_a", "ip_b", "app", "fwd", "len", "sets"), late)
    return p.groupBy(*flows.KEY).transformWithStateInPandas(FlowProcessor(numbered), ENDED, "Append", "EventTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Give each micro-batch to all sinks; the batch is computed once. Without `every`, what is there is processed and the query ends."""

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        for sink in sinks.values():
            sink(batch)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_for(query: StreamingQuery, seconds: int) -> None:
    """Wait until a deadline and stop; 0 waits forever."""
    if seconds:
        query.awaitTermination(seconds)
        query.stop()
    else:
        query.awaitTermination()


def drops(query: StreamingQuery) -> dict[str, float]:
    """received, dropped (late rows) and their ratio, of the last batch."""
    progress = query.lastProgress or {}
    received = progress.get("numInputRows", 0)
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for s in progress.get("stateOperators", []))
    return {"received": received, "dropped": dropped, "drop_ratio": dropped / received if received else 0.0}
