"""Packet captures as DataFrames, streams and files.

read_pcap and stream_pcap take whole files through Spark's binaryFile source, so any file
system that Spark knows works, one task a file, and parse them in Arrow batches.
write_pcap writes captures of a shared folder, one file a task; rotated() assigns packets to files.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.errors import CaptureError
from .rotation import rotated

RAW = "interface string, seq bigint, ts_us bigint, wire_len bigint, link bigint, data binary"
#: Magic numbers as they stand in a file: (byte order, ticks in a microsecond).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
NG_MAGIC, NG_ORDERS = b"\x0a\x0d\x0d\x0a", {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
BATCH_PACKETS = 4096


def records(content: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(time in microseconds, length on the wire, link type, bytes); a cut last record is left out."""
    if content[:4] == NG_MAGIC:
        yield from ng_records(content)
        return
    if content[:4] not in MAGIC:
        raise CaptureError("not a capture file")
    order, ticks = MAGIC[content[:4]]
    link = struct.unpack_from(f"{order}I", content, 20)[0] & 0xFFFF
    at = 24
    while at + 16 <= len(content):
        seconds, fraction, size, wire = struct.unpack_from(f"{order}IIII", content, at)
        at += 16
        if at + size > len(content):
            return
        yield seconds * 1_000_000 + fraction // ticks, wire, link, content[at : at + size]
        at += size


def ng_records(content: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """Of the block format: enhanced and simple packet blocks."""
    at, order, interfaces = 0, "<", []
    while at + 12 <= len(content):
        if content[at : at + 4] == NG_MAGIC:
            order, interfaces = NG_ORDERS.get(content[at + 8 : at + 12], "<"), []
        kind, size = struct.unpack_from(f"{order}II", content, at)
        if size < 12 or at + size > len(content):
            return
        body = content[at + 8 : at + size - 4]
        if kind == 1 and len(body) >= 8:
            link = struct.unpack_from(f"{order}H", body)[0]
            interfaces.append((link, resolution(body[8:], order)))
        elif kind == 6 and len(body) >= 20:
            which, high, low, captured, wire = struct.unpack_from(f"{order}IIIII", body)
            link, per_second = interfaces[which] if which < len(interfaces) else (1, 10**6)
            yield (high << 32 | low) * 1_000_000 // per_second, wire, link, body[20 : 20 + captured]
        elif kind == 3 and len(body) >= 4 and interfaces:
            wire = struct.unpack_from(f"{order}I", body)[0]
            yield 0, wire, interfaces[0][0], body[4 : 4 + wire]
        at += size


def resolution(options: bytes, order: str) -> int:
    """Ticks a second from an interface's options."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(f"{order}HH", options, at)
        if code == 0:
            break
        if code == 9 and size:
            value = options[at + 4]
            return 2 ** (value & 127) if value & 128 else 10**value
        at += 4 + (size + 3) // 4 * 4
    return 10**6


def parsed(files: DataFrame) -> DataFrame:
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RAW.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                for seq, (ts, wire, link, data) in enumerate(records(content)):
                    rows.append((path, seq, ts, wire, link, data))
                    if len(rows) == BATCH_PACKETS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(parse, RAW)


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """RAW rows of one file, a folder or a pattern; interface is the file's path, seq the place in it."""
    return parsed(spark.read.format("binaryFile").load(path))


def stream_pcap(spark: SparkSession, folder: str, files_a_trigger: int = 16) -> DataFrame:
    """The same as a stream over a folder into which finished captures are moved."""
    return parsed(spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_a_trigger).load(folder))


def with_packet_ids(raw: DataFrame) -> DataFrame:
    """raw with pkt_id in order of file and place. A file takes 2**32 ids; files are numbered by path."""
    files = raw.select("interface").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("interface")).cast("bigint") - 1)
    return raw.join(files, "interface").withColumn("pkt_id", F.col("file_no") * (1 << 32) + F.col("seq")).drop("file_no")


def write_pcap(raw: DataFrame, folder: str, stem: str = "capture", max_mb: int = 0, max_seconds: int = 0) -> DataFrame:
    """Write files <stem>_<interface hash>_NNN.pcap to a folder that all executors share; returns (path, packets, bytes).

    With one interface the hash is left out.
    """
    many = raw.select("interface").distinct().limit(2).count() > 1
    files = rotated(raw, max_mb, max_seconds)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, out, done = None, None, []
        try:
            for frame in frames:
                for row in frame.itertuples():
                    part = f"_{row.tag}" if many else ""
                    name = os.path.join(folder, f"{stem}{part}_{row.file_no:03d}.pcap")
                    if name != path:
                        finish(path, out)
                        path, out = name, open(f"{name}.part", "wb")  # noqa: SIM115
                        out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, int(row.link)))
                        done.append([name, 0, 0])
                    out.write(struct.pack("<IIII", row.ts_us // 10**6, row.ts_us % 10**6, len(row.data), int(row.wire_len)) + row.data)
                    done[-1][1] += 1
                    done[-1][2] += len(row.data)
        finally:
            finish(path, out)
        if done:
            yield pd.DataFrame(done, columns=["path", "packets", "bytes"])

    def finish(path: str | None, out) -> None:
        if out:  # a file appears under its name only when it is whole, so a retried task is harmless
            out.close()
            os.replace(f"{path}.part", path)

    tagged = files.withColumn("tag", F.substring(F.md5("interface"), 1, 8))
    ordered = tagged.repartition("interface", "file_no").sortWithinPartitions("interface", "file_no", "ts_us", "seq")
    return ordered.mapInPandas(write, "path string, packets bigint, bytes bigint")
