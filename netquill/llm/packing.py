"""Conflict-constrained best-fit packing of texts into training sequences of fixed capacity.

A text of n UTF-8 bytes has n + 1 units (one end mark). Texts over the capacity are cut into
pieces that fill whole bins, and a last piece; cuts are at bytes, so they may go through a
character. A bin holds no two pieces of texts of the same
duplicate cluster (so a text's own pieces never meet), and at most PER_SOURCE pieces
of one source.

Bins are ordered by the room they have left and carry bitmaps: the clusters inside, and the
sources that are full. Pieces come largest first. The search starts at the tightest room that
fits and goes on to the next room until a bin has no conflict. A tree over the rooms holds the
AND of the bitmaps below each node: where a bit is set in all bins, the search skips them, so
a source or a cluster that is in most bins does not make it walk through them.

Spark deals the pieces by a hash into groups of about PIECES_A_GROUP, whose number follows the
input; each group is packed on its own, so the loss against one global packing is at most a
few bins a group.

Edge cases: null and empty texts are one piece of one unit; a null source is a source of its
own; null clusters conflict with nothing; ties go by doc_id, then piece; repeated rows are
packed once each, and as equal texts never into one bin; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import col, staged

CAPACITY, PER_SOURCE, PIECES_A_GROUP = 8192, 2, 20_000
SCHEMA = "doc_id bigint, piece bigint, start bigint, length bigint, units bigint, bin_id bigint, bin_start bigint, bin_units bigint"


class Bins:
    """Open bins by room left, with an AND of their bitmaps over every stretch of rooms."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.at: dict[int, dict[int, int]] = {}  # room -> {bin: bitmap}
        self.all = [-1] * (2 * self.width)  # -1, every bit: no bin there

    def changed(self, room: int) -> None:
        bits = -1
        for b in self.at.get(room, {}).values():
            bits &= b
        i = room + self.width
        while i and self.all[i] != bits:
            self.all[i] = bits
            i >>= 1
            bits = self.all[2 * i] & self.all[2 * i + 1] if i else 0

    def put(self, room: int, number: int, bits: int) -> None:
        here = self.at.setdefault(room, {})
        here[number] = bits
        if len(here) > 1:  # only bits can go
            i, bits = room + self.width, self.all[room + self.width] & bits
            while i and self.all[i] != bits:
                self.all[i] = bits
                i >>= 1
                bits = self.all[2 * i] & self.all[2 * i + 1] if i else 0
        else:
            self.changed(room)

    def take(self, room: int, number: int) -> int:
        bits = self.at[room].pop(number)
        self.changed(room)
        return bits

    def successor(self, room: int, mask: int) -> int | None:
        """The smallest room, at least this one, whose bins do not all have the same bit of mask."""
        i = room + self.width
        while i < 2 * self.width:
            while self.all[i] & mask:
                while i & 1:  # a right child: up to where there is something on the right
                    i >>= 1
                if not i:
                    return None
                i += 1
                if not i & (i - 1):  # past the last node of the level
                    return None
            while i < self.width and not (self.all[2 * i] & mask and self.all[2 * i + 1] & mask):
                i = 2 * i if not self.all[2 * i] & mask else 2 * i + 1
            if i >= self.width:
                return i - self.width
            i = self.last_below(i) + 1 + self.width  # each half has another bit in all its bins
        return None

    def last_below(self, i: int) -> int:
        while i < self.width:
            i = 2 * i + 1
        return i - self.width

    def tightest(self, room: int, mask: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest bin without conflict; in a room the bin opened first."""
        at = self.successor(room, mask)
        while at is not None:
            best = min((n for n, bits in self.at[at].items() if not bits & mask), default=None)
            if best is not None:
                return at, best
            at = self.successor(at + 1, mask)
        return None


def best_fit(pieces: list[tuple[int, object, object]], capacity: int, per_source: int = PER_SOURCE) -> list[int]:
    """The bin of each (units, source, cluster); pieces come in the order of packing, clusters may be None."""
    sources = {s: i for i, s in enumerate(dict.fromkeys(s for _, s, _ in pieces))}
    seen, twice = set(), {}
    for _, _, c in pieces:  # only clusters that come twice can conflict
        if c in seen and c is not None:
            twice.setdefault(c, len(sources) + len(twice))
        seen.add(c)
    bins, counts, out = Bins(capacity), [], []
    for units, source, cluster in pieces:
        own = 1 << twice[cluster] if cluster in twice else 0
        bit = 1 << sources[source]
        found = bins.tightest(units, own | bit) if units < capacity else None
        if found:
            room, number = found
            bits = bins.take(room, number)
        else:
            room, number, bits = capacity, len(counts), 0
            counts.append({})
        n = counts[number][source] = counts[number].get(source, 0) + 1
        bits |= own | (bit if n >= per_source else 0)
        if room > units:
            bins.put(room - units, number, bits)
        out.append(number)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, pieces_a_group: int = PIECES_A_GROUP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None) -> DataFrame:
    """One row for each piece: its bytes [start, start + length) of the text and its place in a bin.

    Equal texts are a cluster unless a column of clusters is given. start and length count
    UTF-8 bytes; units has the end mark too; bin_units is what the bin holds in all.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    cluster = F.xxhash64(text) if cluster is None else cluster
    rows = docs.select(
        col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.concat(F.lit("+"), col(source_col).cast("string")), F.lit("-")).alias("source"),
        cluster.cast("string").alias("cluster"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.xxhash64(text).alias("text_hash"),
    )
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_bytes") / capacity).cast("bigint"))).alias("piece"))
    start = F.col("piece") * capacity
    pieces = pieces.select("doc_id", "source", "cluster", "text_hash", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n_bytes") - start).alias("length"), F.least(F.lit(capacity), F.col("n_bytes") + 1 - start).alias("units"))
    pieces = staged(pieces, "pieces")
    groups = max(1, -(-pieces.count() // pieces_a_group))
    dealt = pieces.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "text_hash", "piece"), F.lit(groups)))

    def one_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["units", "doc_id", "piece", "text_hash", "source"], ascending=[False, True, True, True, True], kind="stable", na_position="last", ignore_index=True)
        clusters = [None if c is None or c != c else c for c in rows["cluster"]]
        rows["bin"] = best_fit(list(zip(rows["units"].tolist(), rows["source"], clusters, strict=True)), capacity, per_source)
        rows["bin_start"] = rows.groupby("bin")["units"].cumsum() - rows["units"]
        rows["bin_units"] = rows.groupby("bin")["units"].transform("sum")
        rows["bin_id"] = int(key[0]) * (1 << 32) + rows["bin"]
        return rows[[x.split()[0] for x in SCHEMA.split(", ")]]

    return dealt.groupBy("dealt").applyInPandas(one_group, SCHEMA)
