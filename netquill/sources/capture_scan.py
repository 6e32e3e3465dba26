"""Captures read by byte ranges: one file by many tasks, however large it is.

A capture has no marks between its records: each one only says where the next begins. So where
the first record of a range starts is settled in two steps, and exactly:

1. Every range is searched on its own for a place from which a chain of plausible records
   follows, and walked from there: the range's guess, the place where its last record ends,
   and its number of records.
2. Ranges of a file are put in order, narrow rows only. Where a range ends at the guess of
   the next one, the guess was right; by induction from the file's head all such ranges are
   settled. Where it doesn't (a capture inside a capture, junk), the range is walked again from
   the true place. Payloads can make this slower, never wrong.

The settled ranges also say how many records come before each of them, so seq is the place in
the file, and which times they span, so a filter on ts_us leaves out whole ranges. They are
the partitions of the data source CaptureSource; filters on ts_us and interface are pushed down
to it. Files are opened by pyarrow, which reads local and mounted folders and the stores it has a
file system for; what only Spark can open is read whole by read_pcap.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..functions.errors import CaptureError
from ..functions.staging import staged_path
from .pcap import MAGIC, NG_MAGIC, NG_ORDERS, RAW, resolution

RANGE_BYTES = 64 << 20
#: A guess is looked for in so many bytes, and is a chain of so many records or one up to the end of those bytes.
SEARCH, CHAIN = 1 << 20, 32
#: The largest record that a guess believes in.
PLAUSIBLE = 1 << 18
WINDOW = 4 << 20
BATCH_BYTES, BATCH_ROWS = 8 << 20, 16384
FORMAT = "netquill_capture"


def located_file(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    try:
        return pa.fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError) as e:
        raise CaptureError(f"only Spark can open {path}: use read_pcap") from e


class Window:
    """Bytes of a file around a moving place."""

    def __init__(self, path: str):
        files, inner = located_file(path)
        try:
            self.file = files.open_input_file(inner)
        except FileNotFoundError as e:
            raise CaptureError(f"no file {path}") from e
        self.size, self.base, self.held = self.file.size(), 0, b""

    def take(self, at: int, n: int) -> bytes | None:
        """n bytes from at, or None if the file ends before."""
        if at + n > self.size:
            return None
        if at < self.base or at + n > self.base + len(self.held):
            self.base, self.held = at, self.file.read_at(min(max(n, WINDOW), self.size - at), at)
        return self.held[at - self.base : at - self.base + n]


Row = tuple[int, int, int, bytes]


class Classic:
    """A file header of 24 bytes, then records of 16 bytes and their data."""

    def __init__(self, head: bytes):
        self.order, self.ticks = MAGIC[head[:4]]
        self.link = struct.unpack_from(f"{self.order}I", head, 20)[0] & 0xFFFF
        self.first, self.start = 24, None

    def joined(self, before: None, own: None) -> None:
        return None

    def step(self, window: Window, at: int, state: None, rows: bool) -> tuple[int, Row | None, None] | None:
        """The place after the record at a place, its row (see pcap.records), and what state it leaves; None at the end."""
        head = window.take(at, 16)
        if head is None:
            return None
        seconds, fraction, size, wire = struct.unpack(f"{self.order}IIII", head)
        if at + 16 + size > window.size:
            return None
        row = (seconds * 1_000_000 + fraction // self.ticks, wire, self.link, window.take(at + 16, size) if rows else b"")
        return at + 16 + size, row, None

    def plausible(self, chunk: bytes, to_end: bool) -> tuple[np.ndarray, np.ndarray]:
        """For every offset: whether a record may start there, and where the next one would."""
        words = words_of(chunk, self.order)
        n = max(0, len(words) - 12)
        fraction, size, wire = words[4 : 4 + n], words[8 : 8 + n].astype(np.int64), words[12 : 12 + n]
        after = np.arange(n) + 16 + size
        good = (fraction < 1_000_000 * self.ticks) & (size > 0) & (size <= PLAUSIBLE) & (wire >= size) & (wire <= PLAUSIBLE)
        return good & (after <= len(chunk)) if to_end else good, after


class Blocks:
    """Blocks that have their length at both ends.

    state is the byte order, the interfaces described so far, whether a section began since the
    walk did, and whether a packet before that needed an interface from further up.
    """

    def __init__(self, head: bytes):
        self.order = NG_ORDERS.get(head[8:12], "<")
        self.first, self.start = 0, [self.order, [], False, False]

    def joined(self, before: list, own: list) -> list | None:
        """The state after a range that was walked from self.start, if before holds at its beginning; None if it must be walked again."""
        if before[0] != self.order or own[3]:
            return None
        return own if own[2] else [before[0], before[1] + own[1], before[2], before[3]]

    def step(self, window: Window, at: int, state: list, rows: bool) -> tuple[int, Row | None, list] | None:
        head = window.take(at, 12)
        if head is None:
            return None
        if head[:4] == NG_MAGIC:
            state = [NG_ORDERS.get(head[8:12], "<"), [], True, state[3]]
        order, interfaces = state[:2]
        kind, size = struct.unpack_from(f"{order}II", head)
        if size < 12 or at + size > window.size:
            return None
        row = None
        if kind in (1, 3, 6):
            body = window.take(at + 8, size - 12)
            if kind == 1 and len(body) >= 8:
                state = [order, [*interfaces, [struct.unpack_from(f"{order}H", body)[0], resolution(body[8:], order)]], *state[2:]]
            elif kind == 6 and len(body) >= 20:
                which, high, low, captured, wire = struct.unpack_from(f"{order}IIIII", body)
                link, per_second = interfaces[which] if which < len(interfaces) else (1, 10**6)
                row = ((high << 32 | low) * 1_000_000 // per_second, wire, link, body[20 : 20 + captured])
            elif kind == 3 and not interfaces:
                state = [*state[:3], state[3] or not state[2]]
            elif kind == 3 and len(body) >= 4:
                wire = struct.unpack_from(f"{order}I", body)[0]
                row = (0, wire, interfaces[0][0], body[4 : 4 + wire])
        return at + size, row, state

    def plausible(self, chunk: bytes, to_end: bool) -> tuple[np.ndarray, np.ndarray]:
        words = words_of(chunk, self.order)
        n = max(0, len(words) - 8)
        size = words[4 : 4 + n].astype(np.int64)
        after = np.arange(n) + size
        good = (size >= 12) & (size <= PLAUSIBLE) & (size % 4 == 0)
        inside = good & (after <= len(chunk))
        ends = words[np.where(inside, after - 4, 0)]
        return (inside & (ends == size)) if to_end else good & (~inside | (ends == size)), after


def words_of(chunk: bytes, order: str) -> np.ndarray:
    """The 32-bit number at every offset."""
    b = np.frombuffer(chunk, np.uint8).astype(np.uint32)
    parts = [b[i : len(b) - 3 + i] for i in range(4)] if len(b) > 3 else [np.zeros(0, np.uint32)] * 4
    return sum(p << np.uint32(8 * (i if order == "<" else 3 - i)) for i, p in enumerate(parts))


def kind_of(window: Window) -> Classic | Blocks:
    head = window.take(0, min(24, window.size))
    if head[:4] == NG_MAGIC and len(head) >= 12:
        return Blocks(head)
    if head[:4] in MAGIC and len(head) == 24:
        return Classic(head)
    raise CaptureError("not a capture file")


def guess(window: Window, kind: Classic | Blocks, start: int, end: int) -> int:
    """The first place in [start, end) from which plausible records follow each other, or -1."""
    size = min(SEARCH, window.size - start)
    good, after = kind.plausible(window.take(start, size), start + size == window.size)
    for first in np.flatnonzero(good[: end - start]).tolist():
        at, n = first, 0
        while n < CHAIN and at < len(good) and good[at]:
            at, n = int(after[at]), n + 1
        if n == CHAIN or at >= len(good) and (start + size < window.size or at == size):
            return start + first
    return -1


class Walked(NamedTuple):
    """What a walk over a range finds: where the next range begins (-1: nowhere), records, times, and the last state for formats that have one."""

    exit: int
    n: int
    least_us: int | None
    most_us: int | None
    state: list | None


def walk(window: Window, kind: Classic | Blocks, at: int, end: int, state: list | None) -> Walked:
    n, least, most = 0, None, None
    while at < end:
        got = kind.step(window, at, state, False)
        if got is None:
            return Walked(-1, n, least, most, state)
        at, row, state = got
        if row:
            n += 1
            least, most = (min(least, row[0]), max(most, row[0])) if n > 1 else (row[0], row[0])
    return Walked(at, n, least, most, state)


RANGES = "path string, start bigint, stop bigint"
GUESSED = f"{RANGES}, guess bigint, leave bigint, n bigint, least_us bigint, most_us bigint, state string"
SETTLED = f"{RANGES}, at bigint, first_seq bigint, n bigint, least_us bigint, most_us bigint, state string"


def as_frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({c: "Int64" for c in ("least_us", "most_us")})


def guessed_ranges(ranges: DataFrame) -> DataFrame:
    """Step 1. A file that is one range needs no search; its records are counted by whoever reads them (n is -1)."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, start, stop in frame.itertuples(index=False):
                window = Window(path)
                kind = kind_of(window)
                at = kind.first if start == 0 else guess(window, kind, start, stop)
                if start == 0 and stop == window.size:
                    w = Walked(-1, -1, None, None, kind.start)
                elif at < 0:
                    w = Walked(-1, 0, None, None, kind.start)
                else:
                    w = walk(window, kind, at, stop, kind.start)
                    if start and kind.start is not None:  # the resolution of times may stand further up
                        w = w._replace(least_us=None, most_us=None)
                out.append((path, start, stop, at, w.exit, w.n, w.least_us, w.most_us, json.dumps(w.state)))
            yield as_frame(out, GUESSED)

    return ranges.mapInPandas(look, GUESSED)


def settled_ranges(guessed: DataFrame) -> DataFrame:
    """Step 2: the ranges of each file with where their first record starts and how many records come before it."""

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start")
        window = Window(frame["path"].iloc[0])
        kind = kind_of(window)
        at, before, state, out = kind.first, 0, kind.start, []
        for r in frame.itertuples(index=False):
            if at < 0:
                break
            if at >= r.stop:
                continue  # a record passes over the whole range
            own = json.loads(r.state)
            after = kind.joined(state, own)
            if at == r.guess and (after is not None or own is None):
                least, most = (None if pd.isna(x) else int(x) for x in (r.least_us, r.most_us))
                w = Walked(int(r.leave), int(r.n), least, most, after)
            else:
                w = walk(window, kind, at, r.stop, state)
            out.append((r.path, r.start, r.stop, at, before, w.n, w.least_us, w.most_us, json.dumps(state)))
            at, before, state = w.exit, before + w.n, w.state
        return as_frame(out, SETTLED)

    return guessed.groupBy("path").applyInPandas(settle, SETTLED)


class Part(InputPartition):
    def __init__(self, path: str, at: int, stop: int, first_seq: int, state: str):
        self.path, self.at, self.stop, self.first_seq, self.state = path, at, stop, first_seq, state


class CaptureReader(DataSourceReader):
    """Reads settled ranges; filters on ts_us and interface leave out ranges and records before their rows are made."""

    def __init__(self, options: dict):
        self.ranges = options["path"]
        self.least, self.most, self.paths = None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("ts_us",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.least = max(x for x in (self.least, f.value) if x is not None)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.most = min(x for x in (self.most, f.value) if x is not None)
            elif name == ("interface",) and isinstance(f, (EqualTo, In)):
                these = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = these if self.paths is None else self.paths & these
            yield f  # Spark applies all of them again, as bounds here are closed

    def partitions(self) -> list[Part]:
        files, inner = located_file(self.ranges)
        rows = pa.parquet.read_table(inner, filesystem=files).to_pylist()
        return [Part(r["path"], r["at"], r["stop"], r["first_seq"], r["state"]) for r in sorted(rows, key=lambda r: (r["path"], r["start"])) if self.wanted(r)]

    def wanted(self, r: dict) -> bool:
        known = r["least_us"] is not None
        return bool(r["n"]) and (self.paths is None or r["path"] in self.paths) and not (known and (self.least is not None and r["most_us"] < self.least or self.most is not None and r["least_us"] > self.most))

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark asks once where there are no partitions
            return
        window = Window(part.path)
        kind, state, at, seq = kind_of(window), json.loads(part.state), part.at, part.first_seq
        rows, held = [], 0
        while at < part.stop and (got := kind.step(window, at, state, True)):
            at, row, state = got
            if row is None:
                continue
            if (self.least is None or row[0] >= self.least) and (self.most is None or row[0] <= self.most):
                rows.append((seq, *row))
                held += len(row[3])
            seq += 1
            if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield self.batch(part.path, rows)
                rows, held = [], 0
        if rows:
            yield self.batch(part.path, rows)

    def batch(self, path: str, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[c.split()[0] for c in RAW.split(", ")])


class CaptureSource(DataSource):
    """spark.read.format(FORMAT).load(path of a table of settled ranges)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def byte_ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """RANGES of the files of a path or pattern; their contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    begins = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint"))
    return files.select("path", "length", F.explode(begins).alias("start")).select("path", "start", F.least("length", F.col("start") + range_bytes).alias("stop"))


def capture_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> str:
    """The settled ranges of captures, as the path of a table in the shared folder."""
    ranges = byte_ranges(spark, path, range_bytes)
    spread = ranges.repartition(F.col("path"), F.col("start"))
    return staged_path(settled_ranges(guessed_ranges(spread)), "ranges")


def scan_captures(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """RAW rows of one file, a folder or a pattern, as read_pcap gives them, read by ranges of range_bytes in parallel."""
    if range_bytes < 1:
        raise ValueError("range_bytes must be positive")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
    return spark.read.format(FORMAT).load(capture_ranges(spark, path, range_bytes))
