"""Removal of repeated byte strings, found with suffix arrays over content-dealt shards.

Every byte covered by a string of `width` bytes (WIDTH by default) that also starts anywhere
else is removed. With least_words, only removed runs that hold so many words count, which asks
for passages of a number of words: width is then the fewest bytes such a passage may have. Texts
are whole UTF-8 texts; matches never cross texts; strings are judged on the input.

Equal strings must meet in one shard without any shard holding the corpus:

1. Every window of `width` bytes has an anchor, the piece in it (128 bytes of 400) with the
   smallest hash. Windows in a row with the same anchor form a segment; on average a segment of
   400-byte windows has about 140. Equal windows have equal anchors, so only segments whose anchors have the same
   hash need be compared. Segments are written as narrow rows (hashes and places, no text), and
   those whose anchor occurs nowhere else, which is most of them, are done with after one count.
2. A segment whose whole content occurs twice is repeated throughout. Contents are told apart by
   a 128-bit BLAKE2b digest of their bytes. Counting them is an aggregation with a partial step,
   so texts copied thousands of times cost a row a task.
3. Anchors with several different contents go on: one example of each content is cut from its
   text (texts travel compressed, once) and shuffled by anchor. Shards of about SHARD_BYTES get
   a suffix array by induced sorting and permuted common prefixes (see suffix_array.py); a
   window that shares `width` bytes with a neighbour in the array is repeated. An anchor with
   more than CROWD contents is dealt out over several shards; windows that stay alone in
   theirs are then matched across shards by such a digest of the window, in one more shuffle.
4. The repeated windows go back to all places of their segments, and from there to the texts,
   where runs are merged and cut out.

Passages of a number of words (remove_passages) go the same way over another alphabet: each word
is written as a code of 8 bytes, so a window of 51 words is one of 408 bytes that starts at a
multiple of 8, however short or long the words are and whatever white space parts them.

Edge cases: a null text is empty; texts under `width` bytes have nothing to remove; a text that
repeats within itself counts, overlaps included; repeated rows are copies of each other, so
they lose everything from `width` bytes on; null doc_ids are told apart by their texts; an empty
table gives an empty result; extra columns of any name pass. Rows that repeat whole count in step 2, but
their key has one text in step 3 and each range once in step 4, however many rows there are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ._common import by_bytes, col, sheltered, staged, texts_of
from .suffix_array import common_prefixes, suffix_array

WIDTH = 400
SHARD_BYTES, CROWD = 2 << 20, 8192
#: Bytes that are searched for anchors at a time; places in such a part have PLACE_BITS bits.
PLACE_BITS = 19
#: What remove_repeats adds.
ADDED = ("n_bytes", "n_removed", "spans", "kept_bytes", "kept_text")


#: Bytes of a word's code, and words whose codes a task remembers.
CODE, CODES = 8, 1 << 18


class Size(NamedTuple):
    """Bytes of a window and of an anchor."""

    width: int
    piece: int

    @property
    def span(self) -> int:
        """Pieces in a window."""
        return self.width - self.piece + 1

    @property
    def part(self) -> int:
        return (1 << PLACE_BITS) - self.width


def size_of(width: int) -> Size:
    """Long anchors are seldom shared by chance, short ones leave longer segments: both where the width allows it."""
    if not 2 <= width <= 1 << (PLACE_BITS - 2):
        raise ValueError(f"width must be from 2 to {1 << (PLACE_BITS - 2)}, not {width}")
    return Size(width, min(128, max(width - 272, 48), width // 2))


U = np.uint64
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
POWERS = np.cumprod(np.concatenate([[U(1)], np.full(1 << PLACE_BITS, U(BASE))]), dtype=U)
BACK_POWERS = np.cumprod(np.concatenate([[U(1)], np.full(1 << PLACE_BITS, U(BACK))]), dtype=U)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(32)) * U(0xD6E8FEB86659FD93)
    return h ^ h >> U(29)


def prefix_hashes(t: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: the content of [a, b) hashes to (p[b] - p[a]) * BACK_POWERS[a]."""
    return np.concatenate([[U(0)], np.cumsum((t.astype(U) + U(1)) * POWERS[: len(t)], dtype=U)])


def digest(content: bytes | memoryview) -> bytes:
    """What tells contents apart: equal digests count as equal bytes."""
    return hashlib.blake2b(content, digest_size=16).digest()


def binary_array(digests: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as an Arrow array of 16 bytes each."""
    offsets = np.arange(0, 16 * len(digests) + 1, 16, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(digests))])


def segments_of(t: np.ndarray, ends: np.ndarray, size: Size) -> tuple[np.ndarray, ...]:
    """Segments in the texts that stand one after another in t, up to ends: (start, windows, times, anchor, content); a content is two numbers.

    A text that repeats itself, such as one line over and over, has the same segment many times
    in a row; that is one segment with a number of times.
    """
    none = (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, U), np.zeros((0, 2), U))
    n, (width, piece), span = len(t), size, size.span
    if n < width:
        return none
    p = prefix_hashes(t)
    hashes = mixed((p[piece:] - p[:-piece]) * BACK_POWERS[: n - piece + 1])
    keys = hashes >> U(PLACE_BITS) << U(PLACE_BITS) | np.arange(len(hashes), dtype=U)
    # Least key of every span in a row: from blocks of it, the least to the left and to the right.
    blocks = np.concatenate([keys, np.full(-len(keys) % span, U(2**64 - 1))]).reshape(-1, span)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    anchor = (np.minimum(left[:windows], right[span - 1 : span - 1 + windows]) & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    limit = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[:windows]  # the end of the text a window starts in
    anchor[np.arange(windows) + width > limit] = -1
    edges = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.append(edges, windows))
    real = anchor[edges] >= 0
    start, sizes = edges[real], sizes[real]
    if not len(start):
        return none
    body = memoryview(t)
    anchors, ends_at = hashes[anchor[start]], (start + sizes + width - 1).tolist()
    contents = np.frombuffer(b"".join([digest(body[a:b]) for a, b in zip(start.tolist(), ends_at, strict=True)]), U).reshape(-1, 2)
    same = (contents[1:] == contents[:-1]).all(axis=1) & (anchors[1:] == anchors[:-1]) & (sizes[1:] == sizes[:-1]) & (start[1:] == start[:-1] + sizes[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return start[first], sizes[first], np.diff(np.append(first, len(start))), anchors[first], contents[first]


SEGMENT = "id0 bigint, id1 bigint, start bigint, windows int, times int, anchor bigint, content binary"


def segment_rows(keyed: DataFrame, size: Size) -> DataFrame:
    """Of (id0, id1, text): all segments with the row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                out = []
                ids = [part.column(i).to_numpy() for i in (0, 1)]
                waiting, held = [], 0
                for i, text in enumerate(texts_of(part.column(2))):
                    if len(text) < size.width:
                        continue
                    for at in range(0, max(1, len(text) - size.width + 1), size.part):
                        piece = text[at : at + size.part + size.width - 1]
                        if held + len(piece) > size.part + size.width - 1:
                            out.append(found(waiting, ids))
                            waiting, held = [], 0
                        waiting.append((i, at, piece))
                        held += len(piece)
                if waiting:
                    out.append(found(waiting, ids))
                if out:
                    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[:-1]), binary_array(columns[-1])], names=[x.split()[0] for x in SEGMENT.split(", ")])

    def found(waiting: list[tuple[int, int, bytes]], ids: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        ends = np.cumsum([len(x) for _, _, x in waiting])
        start, windows, times, anchor, content = segments_of(np.frombuffer(b"".join(x for *_, x in waiting), np.uint8), ends, size)
        which = np.searchsorted(ends, start, side="right")
        row = np.array([i for i, _, _ in waiting])[which]
        base = np.array([at for _, at, _ in waiting]) - np.concatenate([[0], ends[:-1]])
        return ids[0][row], ids[1][row], start + base[which], windows.astype(np.int32), times.astype(np.int32), anchor.view(np.int64), content

    return keyed.select("id0", "id1", "text").mapInArrow(run, SEGMENT)


def repeated_windows(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of all texts, in order: (text, start in it, number of its class); equal windows share a class."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    s = np.zeros(int(sizes.sum()) + len(texts) + 1, np.uint16)
    body = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + np.uint16(2)
    s[: len(body)] = body
    s[starts + sizes] = 1  # between texts; 0 ends the whole
    sa = suffix_array(s, 258)
    shared = common_prefixes(s, sa)
    window = np.zeros(len(s), bool)
    counts = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = starts[owner] + offset
    window[place] = True
    # Windows hold no border, so a common prefix of width joins windows to windows only.
    number = np.empty(len(s), np.int64)
    number[sa] = np.cumsum(shared < width)
    return owner, offset, number[place]


FOUND = "anchor bigint, content binary, first int, last int, window binary, alone boolean"


def shard_results(examples: DataFrame, crowd: int, width: int) -> DataFrame:
    """Of (anchor, salt, n_contents, content, piece), sorted by anchor and salt: repeated ranges, and the windows of crowded anchors.

    Rows with window null are ranges [first, last) of repeated windows of a content. Rows with
    a window digest are the classes of windows of one shard of a crowded anchor, with a place if
    the window is alone there.
    """

    def solve(rows: list[tuple[int, int, int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        texts = [r[4] for r in rows]
        owner, offset, number = repeated_windows(texts, width)
        count = np.bincount(number, minlength=1)
        again = count[number] > 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
        new_text = np.flatnonzero(np.diff(owner, prepend=-1))
        # Ranges end with a text, too: cut at the first window of each.
        begins = np.union1d(edge[::2], new_text[again[new_text]]) if len(new_text) else edge[::2]
        ends_at = np.searchsorted(edge[1::2], begins, side="right")
        ends = np.minimum(edge[1::2][ends_at], np.append(new_text, len(owner))[np.searchsorted(new_text, begins, side="right")])
        anchors, contents = np.array([r[0] for r in rows], np.int64), [r[3] for r in rows]
        who, n = owner[begins], len(begins)
        if n:
            first = offset[begins].astype(np.int32)
            yield batch(anchors[who], [contents[i] for i in who.tolist()], first, first + (ends - begins).astype(np.int32), None, None)
        crowded = np.array([r[2] > crowd for r in rows])
        here = np.flatnonzero(crowded[owner])
        if len(here):
            _, one = np.unique(number[here], return_index=True)
            here = here[one]
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            joined = memoryview(b"".join(texts))
            place, alone = starts[owner[here]] + offset[here], count[number[here]] == 1
            digests = [digest(joined[p : p + width]) for p in place.tolist()]
            who, at = owner[here], offset[here].astype(np.int32)
            yield batch(anchors[who], [contents[i] for i in who.tolist()], at, at + np.int32(1), digests, alone)

    def batch(anchor: np.ndarray, content: list[bytes], first: np.ndarray, last: np.ndarray, window: list[bytes] | None, alone: np.ndarray | None) -> pa.RecordBatch:
        n = len(anchor)
        arrays = [pa.array(anchor), pa.array(content, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(window or [None] * n, pa.binary()), pa.nulls(n, pa.bool_()) if alone is None else pa.array(alone)]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size, group = [], set(), 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != group:
                    group = row[:2]
                    if size > SHARD_BYTES:
                        yield from solve(held)
                        held, size = [], 0
                    seen = set()
                if row[3] not in seen:  # repeated rows give the same example again
                    seen.add(row[3])
                    held.append(row)
                    size += len(row[4])
        if held:
            yield from solve(held)

    return examples.mapInArrow(run, FOUND)


def packed_texts(keyed: DataFrame, width: int) -> DataFrame:
    """(id0, id1, packed): texts compressed for the shuffle; short texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in by_bytes(batch):
                packed = pa.array([pack.compress(t) for t in texts_of(part.column(2))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], names=["id0", "id1", "packed"])

    long = keyed.where(F.octet_length("text") >= width)
    return long.select("id0", "id1", "text").mapInArrow(run, "id0 bigint, id1 bigint, packed binary")


def cut_examples(wanted: DataFrame, width: int) -> DataFrame:
    """Of (packed, list of pieces): one row for each piece, with its bytes."""
    schema = "anchor bigint, salt bigint, n_contents bigint, content binary, piece binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out, size = [], 0
            for packed, pieces in zip(batch.column(0), batch.column(1), strict=True):
                text = unpack.decompress(packed.as_py())
                for p in pieces.as_py():
                    out.append((p["anchor"], p["salt"], p["n_contents"], p["content"], text[p["start"] : p["start"] + p["windows"] + width - 1]))
                    size += len(out[-1][4])
                if size > 4 << 20:
                    yield rows(out)
                    out, size = [], 0
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.int64()] * 3, pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return wanted.select("packed", "pieces").mapInArrow(run, schema)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id0, id1, text): rows with the same key have the same doc_id and text."""
    doc_id, text = col(id_col).cast("bigint"), F.coalesce(col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(doc_id, F.lit(0)).cast("bigint").alias("id0"), F.xxhash64(doc_id, text).alias("id1"), text.alias("text"))


class WordCodes(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CODES:
            self.clear()
        self[word] = code = hashlib.blake2b(word, digest_size=CODE).digest()
        return code


def coded(keyed: DataFrame) -> DataFrame:
    """(id0, id1, text) with the codes of its words for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = WordCodes().__getitem__
        for batch in batches:
            for part in by_bytes(batch):
                codes = pa.array([b"".join(map(code, t.split())) for t in texts_of(part.column(2))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), codes], names=["id0", "id1", "text"])

    return keyed.select("id0", "id1", "text").mapInArrow(run, "id0 bigint, id1 bigint, text binary")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, width: int = WIDTH) -> DataFrame:
    """(id0, id1, spans): for each row key the ranges [first, last) of windows that are repeated."""
    return spans_of(keyed_texts(docs, id_col, text_col), crowd, width)


def spans_of(keyed: DataFrame, crowd: int, width: int) -> DataFrame:
    """The same of (id0, id1, text)."""
    segments = staged(segment_rows(keyed, size_of(width)), "segments")
    # An anchor that occurs once has no window that occurs twice. Lists of anchors are written before
    # they are joined: Spark splits the rows of a frequent anchor only where it joins plain tables.
    shared = staged(segments.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "shared_anchors")
    segments = staged(segments.join(shared, "anchor").select(segments.columns), "shared_segments")
    # All columns are taken from the same row of a group.
    contents = segments.groupBy("anchor", "content").agg(F.sum("times").alias("n"), *[F.first(c).alias(c) for c in ("id0", "id1", "start", "windows")])
    contents = staged(contents, "contents")
    several = staged(contents.groupBy("anchor").agg(F.count("*").alias("n_contents")).where("n_contents > 1"), "anchors")
    salt = F.pmod(F.xxhash64("content"), F.ceil(F.col("n_contents") / crowd))
    piece = F.struct("anchor", salt.cast("bigint").alias("salt"), "n_contents", "content", "start", "windows")
    wanted = contents.join(several, "anchor").groupBy("id0", "id1").agg(F.collect_list(piece).alias("pieces"))
    # Rows that repeat whole share a key, and one of them does for all.
    packed = packed_texts(keyed, width).groupBy("id0", "id1").agg(F.first("packed").alias("packed"))
    examples = cut_examples(packed.join(wanted.hint("shuffle_hash"), ["id0", "id1"]), width)
    found = staged(shard_results(examples.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt"), crowd, width), "found")
    loose = found.where("window is not null")
    met = loose.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window")
    across = loose.where("alone").join(met, ["anchor", "window"]).select("anchor", "content", "first", "last")
    whole = contents.where("n > 1").select("anchor", "content", F.lit(0).alias("first"), F.col("windows").alias("last"))
    ranges = found.where("window is null").select("anchor", "content", "first", "last").union(across).union(whole)
    # A segment that occurs several times in a row is repeated throughout.
    begin = F.col("start") + F.when(F.col("times") > 1, 0).otherwise(F.col("first"))
    end = F.col("start") + F.when(F.col("times") > 1, F.col("windows") * F.col("times")).otherwise(F.col("last"))
    places = segments.join(ranges, ["anchor", "content"]).select("id0", "id1", begin.alias("first"), end.alias("last"))
    # A set, as rows that repeat whole give the same places again.
    return places.groupBy("id0", "id1").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def merged_spans(ranges: list[dict], n_bytes: int, width: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows in the ranges."""
    out: list[list[int]] = []
    for a, b in sorted((r["first"], r["last"] + width - 1) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n_bytes)) for a, b in out]


def whole_characters(text: bytes, a: int, b: int) -> tuple[int, int]:
    """[a, b) without the characters that it cuts."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b < len(text) and b > a and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def passage_spans(ranges: list[dict], text: bytes, words: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes from the first to the last word covered by the windows in ranges, which count the codes of words."""
    first_last = [{"first": -(-r["first"] // CODE), "last": (r["last"] - 1) // CODE + 1} for r in ranges]
    runs = merged_spans([r for r in first_last if r["first"] < r["last"]], len(text), words)
    if not runs:
        return []
    places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


Cut = Callable[[list[dict], bytes], list[tuple[int, int]]]


def remove_repeats(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, width: int = WIDTH, least_words: int = 0) -> DataFrame:
    """The columns in keep with n_bytes, n_removed, spans (removed byte ranges), kept_bytes and kept_text.

    Columns of docs with these names are replaced. kept_bytes are the bytes outside the spans. kept_text is a string: characters that a span
    cuts in the middle stay whole in it. Runs of fewer than least_words words, those cut at their ends included, stay.
    """

    def cut(ranges: list[dict], text: bytes) -> list[tuple[int, int]]:
        runs = merged_spans(ranges, len(text), width)
        return [(a, b) for a, b in runs if len(text[a:b].split()) >= least_words] if least_words else runs

    return without_spans(docs, keep, id_col, text_col, lambda keyed: spans_of(keyed, crowd, width), cut)


def remove_passages(docs: DataFrame, keep: list[str], words: int, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """As remove_repeats, but every word covered by a run of `words` words that also starts anywhere else goes, with the white space inside the run."""

    def cut(ranges: list[dict], text: bytes) -> list[tuple[int, int]]:
        return passage_spans(ranges, text, words)

    return without_spans(docs, keep, id_col, text_col, lambda keyed: spans_of(coded(keyed), crowd, CODE * words), cut)


def without_spans(docs: DataFrame, keep: list[str], id_col: str, text_col: str, find: Callable[[DataFrame], DataFrame], cut: Cut) -> DataFrame:
    """The columns in keep and ADDED. find gives the ranges of each row key, cut the bytes that go for them."""
    docs, names = sheltered(docs)
    id_at, text_at = names[id_col.lower()], names[text_col.lower()]
    passed = {c: names[c.lower()] for c in keep if c.lower() != text_col.lower() and c.lower() not in ADDED}
    places = list(passed.values())
    spans = find(keyed_texts(docs, id_at, text_at))
    doc_id, text = F.col(id_at).cast("bigint"), F.coalesce(F.col(text_at).cast("string"), F.lit(""))
    rows = docs.select(*places, text.alias("text"), F.coalesce(doc_id, F.lit(0)).cast("bigint").alias("id0"), F.xxhash64(doc_id, text).alias("id1"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in by_bytes(batch):
                packed = pa.array([squeeze.compress(t) for t in texts_of(part.column("text"))], pa.binary())
                columns = [packed if c == "text" else part.column(c) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    own = StructType([docs.schema[c] for c in places])
    packed = rows.mapInArrow(pack, StructType([*own, *DataType.fromDDL("text binary, id0 bigint, id1 bigint")]))
    joined = packed.join(spans.hint("shuffle_hash"), ["id0", "id1"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, ranges = batch.column("text"), batch.column("spans")
            for lo in range(0, batch.num_rows, 256):
                out = []
                for i in range(lo, min(lo + 256, batch.num_rows)):
                    text = squeeze.decompress(texts[i].as_py())
                    gone = cut(ranges[i].as_py() or [], text)
                    borders = [0, *(x for s in gone for x in s), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))
                    borders = [0, *(x for s in gone for x in whole_characters(text, *s)), len(text)]
                    shown = b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))
                    out.append((len(text), sum(b - a for a, b in gone), [{"first": a, "last": b} for a, b in gone], kept, shown))
                columns = list(zip(*out, strict=True))
                part = batch.slice(lo, 256)
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in places), *arrays], names=[*places, *ADDED])

    added = DataType.fromDDL("n_bytes bigint, n_removed bigint, spans array<struct<first:bigint,last:bigint>>, kept_bytes binary, kept_text string")
    got = joined.select(*places, "text", "spans").mapInArrow(run, StructType([*own, *added]))
    return got.select(*[F.col(at).alias(c) for c, at in passed.items()], *ADDED)
