"""Exact deduplication with a log-structured merge index of text digests.

Texts are equal when identical after deleting ASCII white space. Of equal texts the row with
the most code points stays, then the smallest doc_id, then the first row read.

How it runs: every map task feeds its rows into a DigestIndex. Digests go to a memtable, which
is flushed as a run sorted by digest with a Bloom filter. A row whose text is not in the memtable
asks each run's filter and only then searches the run; a hit is verified byte by byte against
the text stored there, and the new entry then names that text by its number. Runs stand in
levels: MOST_RUNS runs of a level are merged into one of the next, so an entry is merged once
for each level, of which there are as many as the logarithm of the rows. Compaction keeps one
entry for each text, with the smallest identifier and the sum of rows. Runs are numpy columns,
and texts lie in a log of their own, each once. An index that holds MOST_BYTES of texts or
MOST_ROWS entries gives out its entries and starts anew, so a map task's memory and the time of
a row do not grow with its partition, and a text that makes up a third of all rows costs the
shuffle a few entries for each task. The last compaction is Spark's: entries are shuffled by
digest and sorted, which merges the tasks' runs on disk, and a task holds the entries of one
digest at a time. Rows then look their group up by digest in a join whose skew Spark can split,
as one side is unique.

Digests are the first 8 bytes of SHA-256 by default; texts that share a digest but not their
bytes stay apart.

Edge cases: null counts as the empty text, and all empty texts are one group; a null doc_id
sorts after all others; repeated rows are one group of which one row stays; an empty table
gives an empty result; columns whose names clash with those added here are kept (the added
ones get underscores where they are internal).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import eq, itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ._common import WHITE, by_bytes, set_aside, sheltered, staged, texts_of

MEMTABLE_ROWS = 4096
#: Bytes of packed texts, and entries, in an index before its entries are given out.
MOST_BYTES, MOST_ROWS = 64 << 20, 1 << 18
#: Runs of a level before they are merged into one of the next.
MOST_RUNS = 4
FILTER_BITS_PER_KEY = 10


#: A run's columns: digest, number of the text, identifier, rows.
COLUMNS = np.dtype([("key", "<i8"), ("text", "<i8"), ("less", "<i8"), ("no_id", "?"), ("doc_id", "<i8"), ("row", "<i8"), ("n", "<i8")])


class Run:
    """Entries (COLUMNS) that are sorted by digest, their payloads, and a Bloom filter."""

    def __init__(self, entries: np.ndarray, payloads: np.ndarray):
        self.entries, self.payloads = entries, payloads
        self.keys = np.ascontiguousarray(entries["key"])
        self.bits = np.uint64(max(64, FILTER_BITS_PER_KEY * len(entries)))
        self.filter = np.zeros(int(self.bits) // 8 + 1, np.uint8)
        for place in self.places(self.keys):
            np.bitwise_or.at(self.filter, place >> np.uint64(3), self.bit(place))

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        # A digest is random already; a multiplication makes further independent places.
        u = keys.view(np.uint64)
        a, b = u * np.uint64(0x9E3779B97F4A7C15), u * np.uint64(0xC2B2AE3D27D4EB4F)
        return [(x >> np.uint64(20)) % self.bits for x in (a, b, a ^ b)]

    @staticmethod
    def bit(place: np.ndarray) -> np.ndarray:
        return np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of keys, where its first entry is) of those that the run has; only those that pass the filter are searched."""
        which = np.arange(len(keys))
        for place in self.places(keys):
            which = which[self.filter[(p := place[which]) >> np.uint64(3)] & self.bit(p) != 0]
        at = np.searchsorted(self.keys, keys[which])
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys[which]
        return which[hit], at[hit]

    def texts(self, at: int) -> list[int]:
        """Numbers of the texts with the digest of the entry at a place, which is the first of it."""
        end = at
        while end < len(self.keys) and self.keys[end] == self.keys[at]:
            end += 1
        return self.entries["text"][at:end].tolist()


def reduced(runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """Compaction: one entry for each text of the runs, with its smallest identifier and all its rows, sorted by digest."""
    e, payloads = np.concatenate([r.entries for r in runs]), np.concatenate([r.payloads for r in runs])
    order = np.lexsort([e[c] for c in ("row", "doc_id", "no_id", "less", "text", "key")])
    e = e[order]
    first = np.flatnonzero(np.concatenate([[True], e["text"][1:] != e["text"][:-1]]))
    out = e[first]
    out["n"] = np.add.reduceat(e["n"], first)
    return out, payloads[order[first]]


Same = Callable[[bytes, bytes], bool]


def compacted(entries: Iterable[list], same: Same = eq) -> Iterator[list]:
    """Of entries sorted by digest: one for each text, with its smallest identifier and all its rows."""
    for _, group in groupby(entries, itemgetter(0)):
        kept: list[list] = []
        for e in group:
            for k in kept:
                if same(k[1], e[1]):
                    take(k, *e[2:])
                    break
            else:
                kept.append(list(e))
        yield from kept


def take(entry: list, identifier: tuple, rows: int, payload: object) -> None:
    """Count rows in entry; the smaller identifier stays."""
    entry[3] += rows
    if identifier < entry[2]:
        entry[2], entry[4] = identifier, payload


class DigestIndex:
    """Entries are [digest, bytes of the text, identifier, rows, payload]; same tells whether two texts' bytes are equal."""

    def __init__(self, same: Same = eq):
        self.same = same
        self.clear()

    def clear(self) -> None:
        #: As entries, with the text's number for its bytes.
        self.memtable: dict[int, list[list]] = {}
        self.levels: list[list[Run]] = []
        self.texts: list[bytes] = []
        self.held, self.bytes = 0, 0

    @property
    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    @property
    def rows(self) -> int:
        return self.held + sum(len(r.entries) for r in self.runs)

    def add(self, digest: int, packed: bytes, identifier: tuple, rows: int, payload: object) -> None:
        self.add_all([[digest, packed, identifier, rows, payload]])

    def add_all(self, entries: list[list]) -> None:
        """Add entries; runs are searched for many at a time."""
        for begin in range(0, len(entries), MEMTABLE_ROWS):
            part = entries[begin : begin + MEMTABLE_ROWS]
            keys = np.array([e[0] for e in part], np.int64)
            known: dict[int, list[int]] = {}
            for run in self.runs:
                for i, at in zip(*(x.tolist() for x in run.find(keys)), strict=True):
                    known.setdefault(i, []).extend(run.texts(at))
            for i, entry in enumerate(part):
                self.put(entry, known.get(i, ()))
            if self.held >= MEMTABLE_ROWS:
                self.flush()

    def put(self, entry: list, known: Iterable[int]) -> None:
        """Add an entry to the memtable; known are the texts in runs that have its digest."""
        digest, packed, identifier, rows, payload = entry
        for e in self.memtable.get(digest, ()):
            if self.same(self.texts[e[1]], packed):
                return take(e, identifier, rows, payload)
        text = next((t for t in known if self.same(self.texts[t], packed)), None)
        if text is None:
            text = len(self.texts)
            self.texts.append(packed)
            self.bytes += len(packed)
        self.memtable.setdefault(digest, []).append([digest, text, identifier, rows, payload])
        self.held += 1

    def flush(self) -> None:
        if not self.held:
            return
        rows = sorted((e for es in self.memtable.values() for e in es), key=itemgetter(0, 1))
        payloads = np.empty(len(rows), object)
        payloads[:] = [e[4] for e in rows]
        self.memtable, self.held = {}, 0
        run, level = Run(np.array([(e[0], e[1], *e[2], e[3]) for e in rows], COLUMNS), payloads), 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < MOST_RUNS:
                return
            run, self.levels[level], level = Run(*reduced(self.levels[level])), [], level + 1

    def entries(self) -> Iterator[list]:
        """All entries, one for each text, sorted by digest."""
        self.flush()
        if not self.runs:
            return
        whole, payloads = reduced(self.runs)
        for begin in range(0, len(whole), MEMTABLE_ROWS):
            part = whole[begin : begin + MEMTABLE_ROWS]
            for (key, text, *identifier, n), payload in zip(part.tolist(), payloads[begin : begin + MEMTABLE_ROWS], strict=True):
                yield [key, self.texts[text], tuple(identifier), n, payload]


def with_keys(docs: DataFrame, text_col: str, digest_bits: int) -> DataFrame:
    """docs with the row number, code points, SHA-256, digest and packed normalised text."""
    from pyspark import TaskContext

    fields = DataType.fromDDL("row bigint, points bigint, sha binary, digest bigint, packed binary")
    text_at = docs.columns.index(text_col)
    mask = (1 << digest_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, pack = TaskContext.get().partitionId() << 40, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in by_bytes(batch, text_col):
                texts = texts_of(part.column(text_at))
                plain = [t.translate(None, WHITE) for t in texts]
                shas = [hashlib.sha256(t).digest() for t in plain]
                digests = [(int.from_bytes(s[:8], "big") & mask) - (1 << 63 if digest_bits == 64 else 0) for s in shas]
                points = pa.compute.utf8_length(pa.array(texts, pa.binary()).cast(pa.string())).cast(pa.int64())
                added = [pa.array(range(row, row + len(texts)), pa.int64()), points, pa.array(shas, pa.binary()), pa.array(digests, pa.int64()), pa.array([pack.compress(t) for t in plain], pa.binary())]
                row += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*docs_columns, *fields.names])

    docs_columns = docs.columns
    return docs.mapInArrow(run, StructType([*docs.schema, *fields]))


ENTRY = "digest bigint, packed binary, sha binary, points bigint, keep_id bigint, keep_row bigint, group_size bigint"


def same_text() -> Same:
    """Whether two packed texts have the same bytes, also if they were packed differently."""
    unpack = zstandard.ZstdDecompressor().decompress
    return lambda a, b: a == b or unpack(a) == unpack(b)


def read_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        for digest, packed, sha, points, doc_id, row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield [digest, packed, (-points, doc_id is None, doc_id or 0, row), n, sha]


def written(entries: Iterable[list]) -> Iterator[pa.RecordBatch]:
    kinds, names = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4], [x.split()[0] for x in ENTRY.split(", ")]
    out, size = [], 0
    for digest, packed, (less, no_id, doc_id, row), n, sha in entries:
        out.append((digest, packed, sha, -less, None if no_id else doc_id, row, n))
        size += len(packed) + 80
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def indexed(rows: DataFrame, most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS) -> DataFrame:
    """Of rows with ENTRY's columns: an entry for each distinct text that a task holds at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex(same_text())
        for batch in batches:
            for begin in range(0, batch.num_rows, MEMTABLE_ROWS):
                for part in by_bytes(batch.slice(begin, MEMTABLE_ROWS), "packed"):
                    index.add_all(list(read_entries(iter([part]))))
                    if index.bytes > most_bytes or index.rows > most_rows:
                        yield from written(index.entries())
                        index.clear()
        yield from written(index.entries())

    return rows.mapInArrow(run, ENTRY)


def merged(entries: DataFrame) -> DataFrame:
    """One entry for each distinct text; entries are compacted as they come, in the order of digests."""
    dealt = entries.repartition("digest").sortWithinPartitions("digest")
    return dealt.mapInArrow(lambda batches: written(compacted(read_entries(batches), same_text())), ENTRY)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 64, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 (any columns of these names are replaced)."""
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    own = docs.columns
    docs, at = sheltered(docs)
    id_at = at[id_col.lower()]
    keyed = staged(with_keys(docs, at[text_col.lower()], digest_bits), "exact_keys")
    rows = keyed.select("digest", "packed", "sha", "points", F.col(id_at).cast("bigint").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("bigint").alias("group_size"))
    entries = merged(indexed(rows, most_bytes))
    return keyed.join(entries.select("sha", "keep_id", "keep_row", "group_size"), "sha").select(
        *[F.col(at[c.lower()]).alias(c) for c in own], "keep_id", "group_size", (F.col("keep_row") == F.col("row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row has; whole rows, same columns."""
    docs, back = set_aside(docs, ["keep_id", "group_size", "kept", "text_sha256"])
    return back(exact_groups(docs, id_col, text_col).where("kept"))
