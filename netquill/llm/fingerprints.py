"""Document fingerprints: one-permutation MinHash, packed to a few bits a bin.

A text's words ([^\\x20\\x09-\\x0D]+, as they stand) give shingles of SHINGLE words; a text with
fewer words is one shingle. Each shingle is hashed once. The top bits of the hash name one of
`bins` bins, and the smallest hash of each bin stays. An empty bin takes the value of a filled
one, which it finds by going through all bins in an order of its own (optimal densification: every
filled bin is equally likely, and two texts that both fill the first bin on the way agree on
it). From each bin `bits` low-order bits of the value, mixed with the number of the bin, are
packed into the fingerprint.

Two bins with different values still agree in their low bits by chance, with probability
2^-bits, so likeness is the share of equal bins less that share of the rest:
(equal - 2^-bits) / (1 - 2^-bits), at least 0. It estimates the Jaccard index of the sets of
shingles; with 512 bins of 4 bits its standard error is at most 0.024.

Edited texts (see edited_fingerprints) need the next document. Texts are dealt once into
ranges of descending ids and walked through in order with one text held back; the few borders
between ranges are closed by a second, small step. No task sees more than its range.

Edge cases: a null text is empty; a text without words has an empty fingerprint, which is
like another empty one (1) and unlike all others (0); documents of one id stand in the order of
a hash of their texts, and those without id come last, after the smallest; repeated rows follow
each other; a single document is its own next one; an empty table gives an empty result; extra
columns are passed if they are asked for. Bytes that are no UTF-8 pass unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ._common import by_bytes, col, per_text, staged, texts_of

SHINGLE, BINS, BITS, SEED = 5, 512, 4, 42
#: Bins that are tried one after another before all filled ones are compared.
TRIES = 32
#: Words whose hashes a task remembers.
WORDS = 1 << 18

U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers, after which each bit depends on all."""
    h = (h ^ h >> U(30)) * U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> U(27)) * U(0x94D049BB133111EB)
    return h ^ h >> U(31)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


class OnePermutation:
    """Makes and compares fingerprints; bins is a power of two, bits is 1, 2, 4 or 8."""

    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE):
        if bins & (bins - 1) or not 8 <= bins <= 1 << 12 or bits not in (1, 2, 4, 8) or shingle < 1:
            raise ValueError(f"no fingerprints of {bins} bins, {bits} bits, {shingle} words")
        self.bins, self.bits, self.shingle = bins, bits, shingle
        self.words = WordHashes()

    def __reduce__(self):
        return OnePermutation, (self.bins, self.bits, self.shingle)

    @cached_property
    def paths(self) -> np.ndarray:
        """For each bin, the order in which it goes through all bins."""
        return np.random.default_rng(SEED).permuted(np.tile(np.arange(self.bins, dtype=np.int16), (self.bins, 1)), axis=1)

    @cached_property
    def ranks(self) -> np.ndarray:
        """The place of each bin on each path."""
        return np.argsort(self.paths, axis=1).astype(np.int16)

    @cached_property
    def weights(self) -> np.ndarray:
        return np.random.default_rng(SEED + 1).integers(0, 1 << 64, self.shingle, U) | U(1)

    def shingles(self, text: bytes) -> np.ndarray:
        """Hashes of the shingles, repeats included."""
        words = text.split()
        if not words:
            return np.zeros(0, U)
        h = np.fromiter(map(self.words.__getitem__, words), U, len(words))
        if len(h) < self.shingle:
            return mixed((h * self.weights[: len(h)]).sum(keepdims=True, dtype=U) + U(len(h)))
        n = len(h) - self.shingle + 1
        return mixed(sum(h[j : j + n] * w for j, w in enumerate(self.weights)))

    def fingerprint(self, text: bytes) -> bytes:
        hashes = np.sort(self.shingles(text))
        if not len(hashes):
            return b""
        bins = hashes >> U(65 - self.bins.bit_length())
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        filled, least = bins[first].astype(np.int64), hashes[first]
        at = np.full(self.bins, -1)
        at[filled] = np.arange(len(filled))
        empty = np.flatnonzero(at < 0)
        if len(empty):
            tried = at[self.paths[empty, :TRIES]]
            hit = (tried >= 0).argmax(axis=1)
            at[empty] = tried[np.arange(len(empty)), hit]
            far = empty[at[empty] < 0]
            if len(far):
                at[far] = self.ranks[np.ix_(far, filled)].argmin(axis=1)
        low = (mixed(least[at] + np.arange(self.bins, dtype=U) * U(0x9E3779B97F4A7C15)) & U((1 << self.bits) - 1)).astype(np.uint8)
        if self.bits == 8:
            return low.tobytes()
        return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - self.bits :].ravel()).tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """Estimated Jaccard index of the shingles of two texts, from 0 to 1."""
        if not a or not b:
            return float(a == b)
        apart = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
        equal = 0
        for i in range(0, 8, self.bits):
            equal += int(np.count_nonzero((apart >> i & ((1 << self.bits) - 1)) == 0))
        chance = 2.0**-self.bits
        return max(0.0, (equal / self.bins - chance) / (1 - chance))


def with_fingerprints(docs: DataFrame, keep: list[str], name: str = "fingerprint", text_col: str = "text", method: OnePermutation | None = None) -> DataFrame:
    """The columns in keep and the fingerprint of each whole text, as binary."""
    method = method or OnePermutation()

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        return lambda texts: [pa.array([method.fingerprint(t) for t in texts], pa.binary())]

    return per_text(docs, f"`{name}` binary", make, keep, text_col)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the beginning of the following one, as long at most."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


ROW = "n_chars bigint, fingerprint binary, edited_sha256 binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [field.split()[0] for field in ROW.split(", ")]
KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def decoded(text: bytes) -> str:
    return text.decode("utf-8", "surrogateescape")


def results(method: OnePermutation, text: bytes, own: bytes, following: bytes, other: bytes) -> tuple:
    """The columns ROW for a text with fingerprint own, followed by a text with fingerprint other."""
    plain = decoded(text)
    changed = edited(plain, decoded(following)).encode("utf-8", "surrogateescape")
    second = method.fingerprint(changed)
    return len(plain), own, hashlib.sha256(changed).digest(), second, method.likeness(own, second), method.likeness(own, other)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", method: OnePermutation | None = None) -> DataFrame:
    """For each document (id_col, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next).

    The next document is the one with the next smaller id, after the last one the first. The
    edited text has the last third of its code points, rounded down, replaced by as many from
    the beginning of the next document, or by all of it. near_edited and near_next are the
    likeness of a document's fingerprint to that of its edited text and of the next document.
    """
    method = method or OnePermutation()
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    # Ties go by a hash of the text, rows that repeat whole by the file split they are in.
    rows = docs.select(col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.spark_partition_id().alias("split"))
    order: list[Column] = [F.col("id").desc_nulls_last(), F.col("tie").asc(), F.col("split").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    own = StructField("id", rows.schema["id"].dataType)
    walked = ordered.mapInArrow(walk(method), StructType([own, *DataType.fromDDL(f"{ROW}, part int, place string, text binary")]))
    walked = staged(walked, "walked")
    ends = walked.where("place is not null")
    # The ranges that have rows, each with the one after it: a number for each range, in a ring.
    parts = sorted(r.part for r in ends.where("place = 'first'").select("part").collect())
    ring = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    firsts = ends.where("place = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    lasts = ends.where("place = 'last'").select("id", "text", "fingerprint", "part").join(ring, "part").join(firsts, "after")
    closed = lasts.select("id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(close(method), StructType([own, *DataType.fromDDL(ROW)]))
    got = walked.where("place is null").select("id", *NAMES).union(closed)
    return got.withColumnRenamed("id", id_col)


def walk(method: OnePermutation) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (id, text) in order: a row for each text but the last, and the first and last text of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[pa.Array, bytes, bytes] | None = None
        for batch in batches:
            for piece in by_bytes(batch):
                ids, out = [], []
                for i, text in enumerate(texts_of(piece.column("text"))):
                    own, here = method.fingerprint(text), piece.column("id").slice(i, 1)
                    if held is None:
                        yield end(here, text, own, "first", part)
                    else:
                        ids.append(held[0])
                        out.append(results(method, held[1], held[2], text, own))
                    held = here, text, own
                if out:
                    yield batch_of(pa.concat_arrays(ids), out, [pa.nulls(len(out), k) for k in (pa.int32(), pa.string(), pa.binary())])
        if held is not None:
            yield end(*held, "last", part)

    def end(own_id: pa.Array, text: bytes, own: bytes, place: str, part: int) -> pa.RecordBatch:
        return batch_of(own_id, [(None, own, None, None, None, None)], [pa.array([part], pa.int32()), pa.array([place]), pa.array([text], pa.binary())])

    def batch_of(ids: pa.Array, out: list[tuple], rest: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *as_columns(out), *rest], names=["id", *NAMES, "part", "place", "text"])

    return run


def as_columns(out: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)]


def close(method: OnePermutation) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the last texts of the ranges with the first of the next range: their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = [results(method, *r) for r in zip(*(batch.column(c).to_pylist() for c in ("text", "fingerprint", "next_text", "next_fingerprint")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *as_columns(out)], names=["id", *NAMES])

    return run
