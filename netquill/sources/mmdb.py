"""Address databases in the MMDB format, read as tables of ranges.

Such a file is a binary trie over the bits of addresses whose leaves point into a section of
encoded values. It is walked once, in one task, as these files are of bounded size, and gives
the ranges that range_lookup joins with, in the order of keys; neighbours with the same values
are one range. IPv4 addresses lie under ::/96 in a trie of IPv6.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.errors import GeoLookupError

# Fixed values of the format.
MARKER = b"\xab\xcd\xefMaxMind.com"
GAP = 16
POINTER, TEXT, DOUBLE, BYTES, MAP, INT32, ARRAY, BOOLEAN, FLOAT = 1, 2, 3, 4, 7, 8, 11, 14, 15
UNSIGNED = (5, 6, 9, 10)
#: Size fields from 29 on: bytes that follow, and what is added to them.
LONG_SIZES = {29: (1, 29), 30: (2, 285), 31: (3, 65821)}
#: Pointers by their two size bits: bytes that follow, and what is added.
POINTERS = [(1, 0), (2, 2048), (3, 526336), (4, 0)]


class Values:
    """The section of encoded values that begins at a place of the file."""

    def __init__(self, content: bytes, base: int):
        self.content, self.base = content, base

    def read(self, at: int) -> tuple[object, int]:
        """The value at a place of the section, and the place after it."""
        content, place = self.content, self.base + at
        control = content[place]
        place += 1
        kind = control >> 5
        if kind == POINTER:
            n, more = POINTERS[control >> 3 & 3]
            low = int.from_bytes(content[place : place + n], "big")
            high = 0 if n == 4 else (control & 7) << 8 * n
            return self.read(high + low + more)[0], place + n - self.base
        if kind == 0:
            kind = content[place] + 7
            place += 1
        size = control & 31
        if size in LONG_SIZES:
            n, more = LONG_SIZES[size]
            size = int.from_bytes(content[place : place + n], "big") + more
            place += n
        if kind in (MAP, ARRAY):
            return self.several(kind, size, place - self.base)
        if kind == BOOLEAN:
            return bool(size), place - self.base
        return self.scalar(kind, content[place : place + size]), place + size - self.base

    def several(self, kind: int, size: int, at: int) -> tuple[object, int]:
        keys, items = [], []
        for _ in range(size):
            if kind == MAP:
                key, at = self.read(at)
                keys.append(key)
            item, at = self.read(at)
            items.append(item)
        return (dict(zip(keys, items, strict=True)) if kind == MAP else items), at

    @staticmethod
    def scalar(kind: int, body: bytes) -> object:
        if kind == TEXT:
            return body.decode()
        if kind in UNSIGNED:
            return int.from_bytes(body, "big")
        if kind == INT32:
            return struct.unpack(">i", body.rjust(4, b"\0"))[0]
        if kind in (DOUBLE, FLOAT):
            return struct.unpack(">d" if kind == DOUBLE else ">f", body)[0]
        if kind == BYTES:
            return bytes(body)
        raise GeoLookupError(f"no value of type {kind}")


class Trie:
    """The nodes of a file, and its values."""

    def __init__(self, content: bytes):
        at = content.rfind(MARKER)
        if at < 0:
            raise GeoLookupError("not an address database")
        meta = Values(content, at + len(MARKER)).read(0)[0]
        self.content, self.nodes, self.bits = content, meta["node_count"], meta["record_size"]
        if self.bits not in (24, 28, 32):
            raise GeoLookupError(f"records of {self.bits} bits")
        self.depth = 128 if meta["ip_version"] == 6 else 32
        self.values = Values(content, self.nodes * self.bits // 4 + GAP)

    def children(self, node: int) -> tuple[int, int]:
        size = self.bits // 4
        b = self.content[node * size : node * size + size]
        if self.bits == 28:
            return (b[3] >> 4) << 24 | int.from_bytes(b[:3], "big"), (b[3] & 15) << 24 | int.from_bytes(b[4:], "big")
        return int.from_bytes(b[: size // 2], "big"), int.from_bytes(b[size // 2 :], "big")

    def leaves(self) -> Iterator[tuple[int, int, int]]:
        """(first, last, place of the value) of all leaves that have one, in the order of addresses."""
        waiting = [(0, 0, self.depth)]
        while waiting:
            record, first, left = waiting.pop()
            if record > self.nodes:
                yield first, first + (1 << left) - 1, record - self.nodes - GAP
            elif record < self.nodes and left:
                zero, one = self.children(record)
                waiting += [(one, first + (1 << left - 1), left - 1), (zero, first, left - 1)]

    def ranges(self) -> Iterator[tuple[int, int, int]]:
        """Leaves, with neighbours of the same value as one, but for those in different families."""
        held = None
        for first, last, value in self.leaves():
            border = self.depth == 128 and first == 1 << 32
            if held and held[1] + 1 == first and held[2] == value and not border:
                held = (held[0], last, value)
            else:
                if held:
                    yield held
                held = (first, last, value)
        if held:
            yield held


def key_of_number(address: int, depth: int) -> str:
    """The sortable form of an address in a trie (see functions.ip)."""
    return f"4{address:08x}" if address < 1 << 32 else f"6{address:032x}"


def picked(value: object, path: str) -> str | None:
    """What lies under a dotted path in a value, as text."""
    for step in path.split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return None if value is None else str(value)


def read_mmdb(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """(lo, hi, and the columns of fields) of a database; fields names the path of each column in a value, such as {"country": "country.iso_code"}."""
    columns = ["lo", "hi", *fields]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                trie, known, rows = Trie(bytes(content)), {}, []
                for first, last, value in trie.ranges():
                    if value not in known:
                        whole = trie.values.read(value)[0]
                        known[value] = tuple(picked(whole, f) for f in fields.values())
                    rows.append((key_of_number(first, trie.depth), key_of_number(last, trie.depth), *known[value]))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    schema = ", ".join(["lo string", "hi string", *(f"`{c}` string" for c in fields)])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(walk, schema)
