"""How quality filters overlap, for every order in which they may be applied.

Each document gets a mask with one bit for each filter that it fails. The table is then reduced
to counts by part and mask, and a subset-zeta transform turns the counts of a part into the
survivors of every subset of filters: with k filters, z[m] is the number of documents whose
mask lies inside m, so z[all but S] is what the filters in S leave. A step of an order is the
difference of two neighbouring subsets, so all k! orders are read off one array of 2^k numbers,
and documents are looked at once. Counts of good and of toxic documents go the same way.

The filters FILTERS judge a text by itself (A to D); E fails copies, the documents whose text a
smaller doc_id has too, whether that one is kept or not. Copies are found on digests of whole texts:
the smallest doc_id of a digest is a partial aggregation, and goes back to its row by a join on
digest and doc_id together, so a text that holds a third of the table is no hot key.

Edge cases: a null text is empty, a null part is the empty string, and so is not told apart
from one; a row without doc_id is nobody's copy, has no label and makes no copies; rows of the
same doc_id and text are no copies of each other, as neither is smaller; of several labels of
a doc_id one that says 1 is enough; labels of no document count nowhere; an empty table gives
an empty report; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import col, staged

#: Fixed values of the filters: fewest words, least percentage of distinct words, most percentage of capitals, forbidden characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
WHITE, CAPITALS = r"[\x20\x09-\x0D]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column, words: Column) -> list[Column]:
    """Whether a text fails A, B, C and D; words is the array of its words."""
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return [
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        100 * capitals.cast("bigint") > MOST_CAPITALS * F.char_length(text).cast("bigint"),
        F.regexp_like(text, F.lit(SYMBOLS)),
    ]


def as_mask(failures: list[Column]) -> Column:
    return sum((F.when(f, 1 << b).otherwise(0) for b, f in enumerate(failures)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    part = F.coalesce(col(part_col).cast("string"), F.lit(""))
    split = docs.select(col(id_col).alias("doc_id"), part.alias("part"), text.alias("text"), F.array_remove(F.split(text, WHITE), "").alias("words"))
    rows = split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), as_mask(text_failures(F.col("text"), F.col("words"))).alias("mask"))
    rows = staged(rows, "masks")  # texts are read and cut into words once

    known = rows.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    copy = F.when(F.col("first").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    judged = known.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left").select("part", (F.col("mask") + copy).alias("mask"), "good", "toxic")
    apart = rows.where("doc_id is null").select("part", "mask", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    return judged.union(apart).groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def survivors(counts: DataFrame, k: int) -> DataFrame:
    """By part: alone (documents by their exact mask), and z_n, z_good, z_toxic, where [m] counts documents whose mask lies inside m."""

    def by_mask(name: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(name))), F.lit(0)) for m in range(1 << k)])

    got = counts.groupBy("part").agg(by_mask("n").alias("alone"), *[by_mask(c).alias(f"z_{c}") for c in COUNTS])
    for b in range(k):
        got = got.withColumns({f"z_{c}": with_bit(f"z_{c}", 1 << b) for c in COUNTS})
    return got


def with_bit(name: str, bit: int) -> Column:
    """One step of the zeta transform: masks with the bit also get what the mask without it has."""
    return F.transform(name, lambda x, m: x + F.when(m.bitwiseAND(bit) != 0, F.get(name, m - bit)).otherwise(0))


def shapley_sums(k: int) -> Column:
    """For each filter, what it removes summed over all k! orders: a subset in front of it stands for |S|! (k-1-|S|)! of them."""
    full, factorial = (1 << k) - 1, [1]
    for i in range(1, k):
        factorial.append(factorial[-1] * i)

    def of(bit: int) -> Column:
        before = [s for s in range(full + 1) if not s & bit]
        return sum((factorial[s.bit_count()] * factorial[k - 1 - s.bit_count()] * (z(full ^ s) - z(full ^ s ^ bit)) for s in before), F.lit(0))

    def z(m: int) -> Column:
        return F.get("z_n", F.lit(m))

    return F.array(*[of(1 << b) for b in range(k)])


def order_report(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step in it, from counts (part, mask, n, good, toxic).

    letters names the filters, from the lowest bit of the mask; with k of them there are k! orders.
    """
    k = len(letters)
    full = (1 << k) - 1
    place = [F.instr(F.col("filter_order"), x) for x in letters]
    before = sum((F.when(p < F.col("step"), 1 << b).otherwise(0) for b, p in enumerate(place)), F.lit(0))
    own = sum((F.when(p == F.col("step"), 1 << b).otherwise(0) for b, p in enumerate(place)), F.lit(0))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = survivors(counts, k).withColumn("sums", shapley_sums(k)).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    steps = steps.withColumns({"before": full - before, "after": full - before - own, "own": own})

    def removed(c: str) -> Column:
        return F.get(f"z_{c}", F.col("before")) - F.get(f"z_{c}", F.col("after"))

    failing = F.get("z_n", F.lit(full)) - F.get("z_n", full - F.col("own"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("z_n", F.col("after")).alias("kept"),
        removed("n").alias("removed"),
        (failing - removed("n")).alias("redundant"),
        F.get("alone", F.col("own")).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.get("sums", F.instr(F.lit(letters), F.substr("filter_order", F.col("step"), F.lit(1))) - 1).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The report of the five filters over docs, with labels (doc_id, quality, toxic)."""
    return order_report(failure_counts(docs, labels, part_col, id_col, text_col))


def audit_sql() -> str:
    """The same report counted order by order from each document's own failures."""
    return rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{WHITE}'), lambda w: w <> '') AS words FROM documents),
f AS (
    SELECT doc_id, part, len(words) < {LEAST_WORDS} AS a, 100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words) AS b,
        100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(t) AS c, regexp_matches(t, '{SYMBOLS}') AS s,
        coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
    FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
    SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN s THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails,
        count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, letters WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS x, left(filter_order, step - 1) AS front FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
j AS (SELECT m.*, s.*, contains(fails, x) AS own, front <> '' AND regexp_matches(fails, '[' || front || '-]') AS gone FROM m, s),
g AS (
    SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost
    FROM j GROUP BY ALL)
SELECT * EXCLUDE (x), sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley FROM g
"""
