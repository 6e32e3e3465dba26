"""Near-duplicates by SimHash, with links found by meet-in-the-middle ball hashing.

Fingerprint: texts are lower-cased (A-Z), cut into words and 3-word shingles (repeats count);
a bit is 1 if set in over half of the shingles' XXH64 values (seed 42). Texts link at RADIUS =
3 or fewer differing bits, and groups are the connected components.

Search: every distinct fingerprint emits all variants within half the radius, one bit. Balls
of one bit meet for pairs up to two bits apart. The third bit is taken by deleting one of four
blocks of 16 bits: a pair that differs at all differs in some block, and without that block at
most two bits differ. So each fingerprint emits, for each block, the 49 variants of the other
48 bits, 196 in all. Rows are shuffled on the variant; fingerprints that collide are verified
in full, and a pair is reported only at one of its meeting places (lowest block that differs,
smallest midpoint), which removes the repeats without another shuffle.

Copies cost nothing: fingerprints are made distinct first, with a partial step. A place where
very many different fingerprints meet is not paired up. There all members are within one bit
of the place outside the deleted block, so neighbours are looked up by flipping up to three
bits, which links the same components in linear time, with true links only.

Edge cases: null, empty and white texts have no words and the fingerprint zero, which links
like any other; texts of one or two words are one shingle; a null doc_id sorts after others;
repeated rows share a group; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import per_text, set_aside, sheltered, staged
from .components import connected_components

SEED, SHINGLE, RADIUS, BLOCK = 42, 3, 3, 16
#: Meeting places with more fingerprints than this are searched by flipping bits.
CROWD = 128

U = np.uint64
BLOCKS = np.array([0xFFFF << (BLOCK * j) for j in range(4)], U)
#: A variant's key has its block's number in place of the deleted block.
TAGS = np.array([j << (BLOCK * j) for j in range(4)], U)


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(plain[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)] or [h64(plain, SEED)], U)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(U)[0])


def with_fingerprints(docs: DataFrame, name: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep and the fingerprint as bigint (its 64 bits)."""

    def make() -> Callable[[list[bytes]], list[pa.Array]]:
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], U).view(np.int64))]

    return per_text(docs, f"`{name}` bigint", make, keep, text_col)


def flips(block: int) -> np.ndarray:
    """The bits outside a block, one by one, and no bit."""
    return np.array([0, *(1 << b for b in range(64) if b // BLOCK != block)], U)


def variants(distinct: DataFrame) -> DataFrame:
    """(key, fp): all meeting places of each fingerprint."""
    masks = np.concatenate([flips(j) for j in range(4)])
    wipe = np.repeat(~BLOCKS, 49)
    tags = np.repeat(TAGS, 49)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(U)
            for i in range(0, len(fps), 512):
                part = fps[i : i + 512, None]
                keys = ((part & wipe) ^ masks) | tags
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.ravel(), len(masks)).view(np.int64))], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key bigint, fp bigint")


def few_links(keys: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of fingerprints with the same key (sorted) that link, at their one place."""
    out, lag = [], 1
    at = np.flatnonzero(keys[1:] == keys[:-1])
    while len(at):
        x, y, key = fps[at], fps[at + lag], keys[at]
        d = x ^ y
        ok = (np.bitwise_count(d) <= RADIUS) & (d != 0)
        x, y, key, d = x[ok], y[ok], key[ok], d[ok]
        block = np.select([d & BLOCKS[j] != 0 for j in range(3)], [0, 1, 2], 3)  # the lowest that differs
        # Of the key's own block only the tag is left; it is right if the rest lies within one bit of x and y.
        place = key & ~BLOCKS[block]
        x48, y48 = x & ~BLOCKS[block], y & ~BLOCKS[block]
        own = (key & BLOCKS[block] == TAGS[block]) & (np.bitwise_count(place ^ x48) <= 1) & (np.bitwise_count(place ^ y48) <= 1)
        apart = np.bitwise_count(x48 ^ y48)
        first = np.where(apart == 0, x48, np.where(apart == 1, np.minimum(x48, y48), np.minimum(place, x48 ^ y48 ^ place)))
        once = own & (place == first)
        out.append((x[once], y[once]))
        lag += 1
        at = at[at + lag < len(keys)]
        at = at[keys[at + lag] == keys[at]]
    return out


def crowd_links(key: int, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """True links that connect what any pairs at one meeting place connect, in linear time."""
    block = next(j for j in range(4) if all((int(key) ^ int(f)) & ~int(BLOCKS[j]) in FLIP_SETS[j] for f in fps[:64].tolist()) and int(key) & int(BLOCKS[j]) == int(TAGS[j]))
    inside = (fps & BLOCKS[block]) >> U(BLOCK * block)
    outside = (fps ^ U(key)) & ~BLOCKS[block]  # none or one bit
    order = np.lexsort((outside, inside))
    fps, inside, outside = fps[order], inside[order], outside[order]
    values, starts = np.unique(inside, return_index=True)
    rep = np.repeat(fps[starts], np.diff([*starts, len(fps)]))
    out = [(fps, rep)]  # equal inside, so at most two bits apart
    full = fps.copy()
    order = np.argsort(full)
    sorted_full = full[order]

    def member(wanted: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(sorted_full, wanted), len(full) - 1)
        return sorted_full[i] == wanted

    def value_at(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        return values[i] == wanted, starts[i]

    centre = np.flatnonzero(outside == 0)
    for n in (1, 2, 3):
        for bits in combinations(range(BLOCK), n):
            mask = U(sum(1 << b for b in bits))
            if n == 1:  # at most 1 + 2 bits: whole classes link
                found, i = value_at(values ^ mask)
                out.append((fps[starts[found]], fps[i[found]]))
                continue
            wanted = fps ^ (mask << U(BLOCK * block))  # same outside
            found = member(wanted)
            out.append((fps[found], wanted[found]))
            if n == 2 and len(centre):  # the centre is at most one bit from all: to the class
                found, i = value_at(inside[centre] ^ mask)
                out.append((fps[centre[found]], fps[i[found]]))
    return out


FLIP_SETS = [set(flips(j).tolist()) for j in range(4)]


def linked(rows: DataFrame) -> DataFrame:
    """Links (a, b) between the fingerprints of sorted (key, fp) rows; a task sees all rows of a key."""

    def links_of(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(keys.view(np.int64))) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
        many = ends - starts > CROWD
        found = []
        for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
            found += crowd_links(int(keys[s]), fps[s:e])
        if many.any():
            small = ~np.repeat(many, ends - starts)
            keys, fps = keys[small], fps[small]
        found += few_links(keys, fps)
        a, b = (np.concatenate([x[i] for x in found]) if found else np.array([], U) for i in (0, 1))
        a, b = np.maximum(a, b), np.minimum(a, b)
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)].view(np.int64)), pa.array(b[i : i + (1 << 16)].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            keys, fps = (c.to_numpy().view(U) for c in batch.columns)
            held.append((keys, fps))
            n += len(keys)
            if n < 1 << 18 or keys[0] == keys[-1]:
                continue
            keys, fps = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            whole = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))  # the last key may go on
            if whole:
                yield from links_of(keys[:whole], fps[:whole])
            held, n = [(keys[whole:], fps[whole:])], len(keys) - whole
        if n:
            keys, fps = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            yield from links_of(keys, fps)

    return rows.mapInArrow(run, "a bigint, b bigint")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links between different fingerprints (column fp, each once); their components are complete."""
    return linked(variants(distinct).repartition("key").sortWithinPartitions("key")).where("a <> b").distinct()


def near_groups(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns in keep (all by default), fingerprint, component_id and stays (true for one row of each group)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("fingerprint", "component_id", "stays")]
    docs, at = sheltered(docs)
    places, id_at = [at[c.lower()] for c in keep], at[id_col.lower()]
    base = staged(with_fingerprints(docs, "fp", list(dict.fromkeys([*places, id_at])), at[text_col.lower()]).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    doc_id = F.col(id_at).cast("bigint")
    # Nulls sort first in a struct, so the flag puts them last.
    first = F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.col("row"))).alias("first")
    distinct = staged(base.groupBy("fp").agg(first), "distinct")
    roots = connected_components(fingerprint_links(distinct))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    group = rooted.join(best, "root").select("fp", F.col("best.id").alias("component_id"), F.col("best.row").alias("best_row"))
    return base.join(group, "fp").select(
        *[F.col(p).alias(c) for c, p in zip(keep, places, strict=True)], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("row") == F.col("best_row")).alias("stays")
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id."""
    docs, back = set_aside(docs, ["fingerprint", "component_id", "stays"])
    return back(near_groups(docs, None, id_col, text_col).where("stays"))
