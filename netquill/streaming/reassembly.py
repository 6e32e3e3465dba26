"""TCP streams put together as packets arrive, with the segments that wait kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessorHandle

from ..operators.flows import KEY
from ..operators.reassembly import CAP, EMITTED, HalfStream, tcp_segments
from .ordered import InOrder
from .session import timed


class Direction(InOrder):
    """One direction of a flow. Waiting segments are a map by sequence number, of which only what a turn changes is written.

    A direction that was closed is forgotten after closed_ms without packets, another after idle_ms.
    """

    ROW = "ts_us bigint, pkt_id bigint, tcp_seq bigint, syn boolean, fin boolean, rst boolean, payload binary"
    OUT = EMITTED

    def __init__(self, compat: bool, cap: int | None, idle_ms: int | None, closed_ms: int | None):
        super().__init__(idle_ms)
        self.compat, self.cap, self.closed_ms = compat, cap, closed_ms

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next bigint, total bigint, dropped bigint, closed boolean")
        self.segments = handle.getMapState("segments", "seq bigint", "data binary")

    def forget(self) -> None:
        self.place.clear()
        self.segments.clear()

    def idle_after(self) -> int | None:
        closed = self.place.exists() and self.place.get()[3]
        return min((x for x in (self.idle_ms, self.closed_ms if closed else None) if x is not None), default=None)

    def least_idle(self) -> int | None:
        return min((x for x in (self.idle_ms, self.closed_ms) if x is not None), default=None)

    def feed(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        stream, out = HalfStream(self.compat, self.cap), []
        if self.place.exists():
            stream.next, stream.total, stream.dropped, stream.closed = self.place.get()
            stream.segments = {k[0]: bytes(v[0]) for k, v in self.segments.iterator()} if self.segments.exists() else {}
            stream.move_to(stream.next)
        before = dict(stream.segments)
        for _, pkt_id, seq, syn, fin, rst, payload in rows:
            dropped = stream.dropped
            data = stream.feed(int(seq), bool(syn), bool(fin), bool(rst), bytes(payload))
            if data or stream.dropped > dropped:
                out.append((*key[:4], key[5], pkt_id, data, stream.dropped - dropped))
        for seq in before.keys() - stream.segments.keys():
            self.segments.removeKey((seq,))
        for seq, data in stream.segments.items():
            if before.get(seq) != data:
                self.segments.updateValue((seq,), (data,))
        self.place.update((stream.next, stream.total, stream.dropped, stream.closed))
        return out


def stream_reassemble(packets: DataFrame, compat: bool = False, cap: int | None = CAP, late: str = "10 seconds", idle: int | None = 300, closed: int | None = 15) -> DataFrame:
    """EMITTED rows, as reassemble gives them over a table. Needs the RocksDB state store.

    A direction without packets for idle seconds of event time, or closed seconds after a FIN or RST, is removed.
    """
    rows = timed(tcp_segments(packets), late)
    direction = Direction(compat, cap, *(None if x is None else x * 1000 for x in (idle, closed)))
    return rows.groupBy(*KEY, "fwd").transformWithStateInPandas(direction, EMITTED, "Append", "EventTime")
