"""TCP streams put together from segments in order of arrival, for each flow and direction.

A SYN sets the next sequence number; a segment that starts at or before it is emitted from
there on, later ones wait in a heap. A direction keeps at most cap bytes in its life (CAP, or
any number with None); what a packet brings beyond that is reported as dropped. Sequence numbers
compare modulo 2**32; with compat they compare as plain numbers and the closed flag looks at
SYN or RST, as in some engines.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flows import KEY, canonical

CAP, TURN = 1 << 20, 1 << 32
EMITTED = "key_a string, port_a int, key_b string, port_b int, fwd boolean, pkt_id bigint, data binary, dropped bigint"
SEGMENT = ["tcp_seq", "syn", "fin", "rst", "payload"]


class HalfStream:
    """One direction. at counts the bytes emitted; the heap has (at which count, sequence number) of the segments that wait."""

    def __init__(self, compat: bool = False, cap: int | None = CAP):
        self.cap = cap
        self.segments: dict[int, bytes] = {}
        self.heap: list[tuple[int, int]] = []
        self.next, self.total, self.at, self.dropped, self.compat, self.closed = 0, 0, 0, 0, compat, False

    def feed(self, seq: int, syn: bool, fin: bool, rst: bool, payload: bytes) -> bytes:
        if syn:
            self.move_to((seq + 1) % TURN)
        self.closed |= (syn or rst) if self.compat else (fin or rst)
        seq = (seq + 1) % TURN if syn and not self.compat else seq  # data in a SYN comes after it
        if payload and (self.cap is None or self.total + len(payload) <= self.cap):
            if seq not in self.segments:
                heappush(self.heap, (self.at + self.ahead(seq), seq))
            self.segments[seq] = payload
            self.total += len(payload)
        else:
            self.dropped += len(payload)
        return self.drain()

    def ahead(self, seq: int) -> int:
        """How far seq lies past the next byte; negative: before it."""
        if self.compat:
            return seq - self.next
        return (seq - self.next + (TURN >> 1)) % TURN - (TURN >> 1)

    def move_to(self, place: int) -> None:
        """Expect another sequence number; what waits lies elsewhere now."""
        self.next = place
        self.heap = [(self.at + self.ahead(s), s) for s in self.segments]
        heapify(self.heap)

    def drain(self) -> bytes:
        out = []
        while self.heap and self.heap[0][0] <= self.at:
            gap = self.at - self.heap[0][0]
            data = self.segments.pop(heappop(self.heap)[1])
            if gap < len(data):
                out.append(data[gap:])
                self.at += len(out[-1])
                place = self.next + len(out[-1])
                self.next = place % TURN
                if self.compat and place >= TURN:  # plain numbers start again
                    self.move_to(self.next)
        return b"".join(out)


def tcp_segments(packets: DataFrame) -> DataFrame:
    """Of TCP packets: the direction's key, the order of arrival, and SEGMENT."""
    payload = F.coalesce("payload", F.lit(bytearray())).alias("payload")
    return canonical(packets.where("l4 = 'Tcp'")).select(*KEY, "fwd", "ts_us", "pkt_id", *SEGMENT[:-1], payload)


def reassemble(packets: DataFrame, compat: bool = False, partitions: int | None = None, cap: int | None = CAP) -> DataFrame:
    """The bytes that become contiguous with each packet, and how many of its own passed the cap: EMITTED rows, where there are any.

    Rows are sorted by key inside a partition and folded in one pass: memory holds one
    direction's waiting segments (at most cap bytes, where there is a cap), not a key's packets.
    """
    by = [*KEY, "fwd"]
    dealt = tcp_segments(packets).repartition(*([partitions] if partitions else []), *by).sortWithinPartitions(*by, "ts_us", "pkt_id")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stream = None, HalfStream(compat, cap)
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if (own := (r.key_a, r.port_a, r.key_b, r.port_b, r.fwd)) != key:
                    key, stream = own, HalfStream(compat, cap)
                before = stream.dropped
                data = stream.feed(int(r.tcp_seq), r.syn, r.fin, r.rst, bytes(r.payload))
                if data or stream.dropped > before:
                    rows.append((*own, r.pkt_id, data, stream.dropped - before))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in EMITTED.split(", ")])

    return dealt.mapInPandas(fold, EMITTED)
