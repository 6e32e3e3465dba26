"""A stateful operator whose rows come in the order of event time, whatever the order of arrival."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def plain(x):
    """A value of a frame as state holds it: frames make floats of whole numbers in columns with nulls."""
    if isinstance(x, float):
        return None if math.isnan(x) else int(x)
    return x


class InOrder(StatefulProcessor):
    """Holds a key's rows back until the watermark has passed them, then feeds them by (ts_us, pkt_id).

    Rows begin with ts_us and pkt_id. A subclass gives the schemas, keeps state of its own, and
    says what rows make of it (feed) and how it is cleared (forget). A key from which nothing came
    for longer than idle_ms of event time is forgotten, all of its state and timers, whether a timer
    or the key's next row shows it; None keeps it for ever.
    """

    ROW = OUT = ""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)
        self.last = handle.getValueState("last", "us bigint")  # time of the last row that was fed
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def feed(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def idle_after(self) -> int | None:
        """Milliseconds after which a silent key is forgotten, as its state is now."""
        return self.idle_ms

    def least_idle(self) -> int | None:
        """The least that idle_after may be."""
        return self.idle_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        columns = [c.split()[0] for c in self.ROW.split(", ")]
        new = [tuple(map(plain, r)) for frame in rows for r in frame[columns].itertuples(index=False, name=None)]
        yield self.turn(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.turn(key, [], timerValues.getCurrentWatermarkInMs())

    def turn(self, key: tuple, new: list[tuple], watermark_ms: int) -> pd.DataFrame:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = sorted(held + new, key=itemgetter(0, 1))
        ready = [r for r in rows if r[0] <= watermark_ms * 1000]
        later = rows[len(ready) :]
        out, last = self.fed(key, ready)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        idle = self.idle_after()
        if last is not None and idle is not None and last + idle * 1000 < watermark_ms * 1000:
            self.forget()
            last = None
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
        times = [r[0] // 1000 + 1 for r in later[:1]] + ([last // 1000 + idle + 1] if last is not None and idle is not None else [])
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if times:
            self.handle.registerTimer(min(times))
        return pd.DataFrame(out, columns=[c.split()[0] for c in self.OUT.split(", ")])

    def fed(self, key: tuple, rows: list[tuple]) -> tuple[list[tuple], int | None]:
        """What feed makes of rows in order, and the time of the last row; the key is forgotten in between where it was silent."""
        last, least = self.last.get()[0] if self.last.exists() else None, self.least_idle()
        out, begin = [], 0
        for i, row in enumerate(rows):
            if last is not None and least is not None and row[0] - last > least * 1000:
                if i > begin:
                    out += self.feed(key, rows[begin:i])
                    begin = i
                idle = self.idle_after()
                if idle is not None and row[0] - last > idle * 1000:
                    self.forget()
            last = row[0]
        if rows:
            out += self.feed(key, rows[begin:])
        return out, last

    def close(self) -> None:
        pass
