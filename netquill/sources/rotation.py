"""Which capture file a packet goes to, found in many tasks.

A new file begins before a packet that would make the file too large, or comes too long after the
file's first. So where a file ends depends on where it began, for which packets are folded in
order; but where a file that began with a given packet would end does not depend on anything
before, and is found for all packets at once:

1. Packets are dealt by ranges of (interface, ts_us, seq), narrow columns only. With sums of bytes
   up to each packet, the next file's first packet is a search in two sorted columns, by size and by
   time. Inside a range, pointers to it are doubled until they leave: each packet then has the last
   file start of its range that follows from it, its leaf, and the number of files up to there.
2. From a leaf the next file begins in a later range, which the ends of ranges show; the leaf
   is sent there and searched. That gives links from leaf to leaf.
3. Links are followed from the first packet of each interface by pointer doubling: in each round
   the leaves reached so far send on what the links reach, and the links are squared. Rounds are
   the logarithm of the number of ranges.
4. The leaves reached give the state that each range is entered with, and so its file starts,
   with which packets are numbered by a join on ranges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import staged

ORDER = ["interface", "ts_us", "seq"]
RANGE = ["interface", "part"]
#: A leaf's identifier holds its range and its place there.
PLACE_BITS = 36
LATER = "interface string, part int, base bigint, first boolean, parts array<int>, ends array<bigint>, lasts array<bigint>"


class Pointers:
    """The packets of a range in order, and for each where the file after the one that it begins would begin."""

    def __init__(self, frame: pd.DataFrame, base: int, limit: int, age: int):
        frame = frame.sort_values(["ts_us", "seq"], kind="stable")
        self.ts, self.seq, size = (frame[c].to_numpy(np.int64) for c in ("ts_us", "seq", "size"))
        self.limit, self.age, self.n = limit, age, len(frame)
        self.sums = base + np.cumsum(size)  # bytes up to and with each packet
        self.before = self.sums - size
        self.next = np.maximum(self.reached(self.before, self.ts), np.arange(self.n) + 1)

    def reached(self, before: np.ndarray, ts: np.ndarray) -> np.ndarray:
        """Where the file ends that began with so many bytes before it, at a time; n if not in this range."""
        by_size = np.searchsorted(self.sums, before + self.limit, side="right") if self.limit else np.full(len(before), self.n)
        by_time = np.searchsorted(self.ts, ts + self.age, side="left") if self.age else np.full(len(before), self.n)
        return np.minimum(by_size, by_time)

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """For each packet: the last file start in the range that follows from it, and the files from one to the other."""
        inside = self.next < self.n
        to, files = np.where(inside, self.next, np.arange(self.n)), inside.astype(np.int64)
        while not np.array_equal(to[to], to):
            files, to = files + files[to], to[to]
        return to, files

    def starts(self, first: int) -> list[int]:
        """File starts in the range, from a first one on."""
        out = []
        while first < self.n:
            out.append(first)
            first = int(self.next[first])
        return out


def same(text: str, n: int) -> pd.Series:
    return pd.Series([text] * n, dtype=object)


def rotated(raw: DataFrame, max_mb: int = 0, max_seconds: int = 0) -> DataFrame:
    """raw (interface, ts_us, seq, data and any others) with file_no: a new file begins before a packet that would exceed max_mb, or comes max_seconds or more after the file's first.

    0 disables a limit. Sizes count packet bytes only. seq tells packets of an interface and time
    apart; rows without an interface are one interface.
    """
    limit, age = max_mb << 20, max_seconds * 1_000_000
    if not limit and not age:
        return raw.withColumn("file_no", F.lit(0).cast("bigint"))
    names = raw.columns
    dealt = staged(raw.withColumn("nq_size", F.coalesce(F.octet_length("data"), F.lit(0)).cast("bigint")).repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()), "packets")
    narrow = dealt.select(F.coalesce("interface", F.lit("")).alias("interface"), "part", "ts_us", "seq", F.col("nq_size").alias("size"))
    later = staged(ranges_of(narrow), "ranges")
    leaves = staged(leaves_of(narrow, later, limit, age), "leaves")
    reached = followed(leaves.where("first").select("interface", "leaf", "file_no"), linked(leaves, narrow, later, limit, age))
    starts = staged(starts_of(narrow, entered(later, leaves, reached), limit, age), "starts")
    here = F.struct("ts_us", "seq")
    matches = [F.coalesce(dealt["interface"], F.lit("")).eqNullSafe(starts["interface"]), dealt["part"] == starts["part"]]
    numbered = dealt.join(starts, matches).withColumn("file_no", F.col("entered_no") + F.size(F.filter("starts", lambda s: s <= here)))
    return numbered.select(*[dealt[c] for c in names], F.col("file_no").cast("bigint"))


def ranges_of(narrow: DataFrame) -> DataFrame:
    """LATER: each range with the bytes before it, and the ends of its interface's ranges by size and by time, as many as there are ranges."""
    sums = narrow.groupBy(*RANGE).agg(F.sum("size").alias("bytes"), F.max("ts_us").alias("last_us"))
    in_order = Window.partitionBy("interface").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("end", F.sum("bytes").over(in_order))
    every = F.array_sort(F.collect_list(F.struct("part", "end", "last_us")))
    lists = sums.groupBy("interface").agg(every.alias("r")).select("interface", F.col("r.part").alias("parts"), F.col("r.end").alias("ends"), F.col("r.last_us").alias("lasts"))
    got = sums.join(lists, "interface").withColumn("first", F.col("part") == F.col("parts")[0])
    return got.select("interface", "part", (F.col("end") - F.col("bytes")).alias("base"), "first", "parts", "ends", "lasts")


LEAVES = "interface string, part int, leaf bigint, before bigint, ts_us bigint, to_part int, first boolean, file_no bigint"


def leaves_of(narrow: DataFrame, later: DataFrame, limit: int, age: int) -> DataFrame:
    """Step 1: leaves with the range in which the next file begins (null: none); first marks those that the fold of an interface comes to first, with their file's number."""

    def search(frame: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        a = about.iloc[0]
        p = Pointers(frame, int(a["base"]), limit, age)
        to, files = p.leaves()
        at = np.flatnonzero(to == np.arange(p.n))
        ends, lasts, parts = (np.asarray(a[c]) for c in ("ends", "lasts", "parts"))
        by_size = np.searchsorted(ends, p.before[at] + limit, side="right") if limit else np.full(len(at), len(ends))
        by_time = np.searchsorted(np.maximum.accumulate(lasts), p.ts[at] + age, side="left") if age else np.full(len(at), len(ends))
        where = np.minimum(by_size, by_time)
        # A file that one packet fills ends at the next packet, which may stand in the next range.
        where = np.maximum(where, int(np.searchsorted(parts, a["part"])) + 1)
        target = pd.array([int(parts[w]) if w < len(parts) else None for w in where], dtype="Int32")
        first = at == to[0] if a["first"] else np.zeros(len(at), bool)
        # The fold asks of the first packet, too, whether it fits into a file without bytes.
        began = int(bool(limit) and p.sums[0] - p.before[0] > limit)
        number = np.where(first, files[0] + began, 0)
        return pd.DataFrame({"interface": same(a["interface"], len(at)), "part": a["part"], "leaf": int(a["part"]) << PLACE_BITS | at, "before": p.before[at], "ts_us": p.ts[at], "to_part": target, "first": first, "file_no": number})

    return narrow.groupBy(*RANGE).cogroup(later.groupBy(*RANGE)).applyInPandas(search, LEAVES)


def linked(leaves: DataFrame, narrow: DataFrame, later: DataFrame, limit: int, age: int) -> DataFrame:
    """Step 2: (interface, leaf, to, files): the next leaf, and the files from one to the other."""

    def search(key: tuple, coming: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        if not len(coming) or not len(frame):
            return pd.DataFrame({"interface": same("", 0), "leaf": [], "to": [], "files": []})
        p = Pointers(frame, int(frame["base"].iloc[0]), limit, age)
        to, files = p.leaves()
        at = p.reached(coming["before"].to_numpy(np.int64), coming["ts_us"].to_numpy(np.int64))
        return pd.DataFrame({"interface": same(key[0], len(coming)), "leaf": coming["leaf"].to_numpy(), "to": int(key[1]) << PLACE_BITS | to[at], "files": files[at] + 1})

    here = narrow.join(later.select(*RANGE, "base"), RANGE)
    sent = leaves.where("to_part is not null").select("interface", F.col("to_part").alias("part"), "leaf", "before", "ts_us")
    return sent.groupBy(*RANGE).cogroup(here.groupBy(*RANGE)).applyInPandas(search, "interface string, leaf bigint, to bigint, files bigint")


def followed(first: DataFrame, links: DataFrame) -> DataFrame:
    """Step 3: (interface, leaf, file_no): the leaves that the links reach from the first ones."""
    reached, links, n = staged(first, "reached"), staged(links, "links"), -1
    while (now := reached.count()) != n:
        n = now
        further = reached.join(links, ["interface", "leaf"]).select("interface", F.col("to").alias("leaf"), (F.col("file_no") + F.col("files")).alias("file_no"))
        reached = staged(reached.union(further).distinct(), "reached")
        onward = links.select("interface", F.col("leaf").alias("to"), F.col("to").alias("last"), F.col("files").alias("more"))
        links = staged(links.join(onward, ["interface", "to"]).select("interface", "leaf", F.col("last").alias("to"), (F.col("files") + F.col("more")).alias("files")), "links")
    return reached


def entered(later: DataFrame, leaves: DataFrame, reached: DataFrame) -> DataFrame:
    """(interface, part, base, first, before, began_us, entered_no): each range with the file that is open when it is entered."""
    open_files = reached.join(leaves.select("interface", "part", "leaf", "before", "ts_us"), ["interface", "leaf"])
    state = F.struct("leaf", "before", "ts_us", "file_no")
    last = open_files.groupBy(*RANGE).agg(F.max(state).alias("state"))
    before = Window.partitionBy("interface").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    got = later.select(*RANGE, "base", "first").join(last, RANGE, "left").withColumn("state", F.last("state", ignorenulls=True).over(before))
    return got.select(*RANGE, "base", "first", F.col("state.before").alias("before"), F.col("state.ts_us").alias("began_us"), F.col("state.file_no").alias("entered_no"))


def starts_of(narrow: DataFrame, ranges: DataFrame, limit: int, age: int) -> DataFrame:
    """Step 4: (interface, part, entered_no, starts): a packet's file is entered_no and one more for each start at or before it."""

    def search(frame: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        a = about.iloc[0]
        p = Pointers(frame, int(a["base"]), limit, age)
        if a["first"]:
            number = int(bool(limit) and p.sums[0] - p.before[0] > limit)
            found = p.starts(0)[1:]
        else:
            number = int(a["entered_no"])
            found = p.starts(int(p.reached(np.array([int(a["before"])]), np.array([int(a["began_us"])]))[0]))
        starts = [{"ts_us": int(p.ts[i]), "seq": int(p.seq[i])} for i in found]
        return pd.DataFrame({"interface": same(a["interface"], 1), "part": [a["part"]], "entered_no": [number], "starts": [starts]})

    schema = "interface string, part int, entered_no bigint, starts array<struct<ts_us:bigint,seq:bigint>>"
    return narrow.groupBy(*RANGE).cogroup(ranges.groupBy(*RANGE)).applyInPandas(search, schema)
