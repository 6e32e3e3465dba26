"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash within each source and ranked there; a row of rank r in a
source of n rows has the fractional rank (r - 1/2) / n. Sorted by it, the rows of all sources
interleave in proportion, so every cut into equal parts has the mixture of the whole.

The law is `rows`: shards hold counts at most one apart.

No window runs over a whole source or over the whole table. Ranks are found in two steps: rows
fall into buckets of the hash (then into ranges of the order by fractional rank and source),
whose counts are summed up to offsets, and a window ranks rows inside one bucket. The number of
buckets follows the number of rows, so a bucket keeps about the same size, and a source with a
third of all rows is spread over a third of the buckets. Sources of one row all have the
fractional rank 1/2; ranges of the whole order part them by source. Only the table of counts,
one row for each bucket, is summed in order.

Edge cases: a null text has no bytes, so its size is 16 and its checksum 0; a null source is a
source of its own; null doc_ids and repeated rows are told apart by nothing, and each gets its
own slot; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import placed
from ._common import col, staged

SHARDS = 40
ROWS_A_BUCKET = 4096
OVERHEAD_BYTES = 16


def seeded_hash(seed: int, *parts: Column) -> Column:
    """60 bits of MD5 over the seed and the parts, as bigint."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def offsets(rows: DataFrame, within: list[str], bucket: str) -> DataFrame:
    """For each bucket, the rows in lower buckets (of the same `within`) and in all of them."""
    counts = rows.groupBy(*within, bucket).agg(F.count("*").alias("n_here"))
    order = Window.partitionBy(*[F.col(c) for c in within]).orderBy(bucket) if within else Window.orderBy(bucket)
    return counts.select(*within, bucket, (F.sum("n_here").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_here")).alias("n_below"))


def interleaved(rows: DataFrame, source: str, shuffled: list[str], total: int) -> DataFrame:
    """rows with position: the place from 0 in the order of fractional rank."""
    buckets = max(1, -(-total // ROWS_A_BUCKET))
    rows = rows.withColumn("hash_bucket", F.pmod(F.shiftright(F.col(shuffled[0]), 20), F.lit(buckets)))
    sizes = rows.groupBy(source).agg(F.count("*").alias("n_source"))
    # Ranks by (bucket, hash): the order within a source is still a seeded shuffle.
    below = offsets(rows, [source], "hash_bucket").join(sizes, source)
    inside = Window.partitionBy(source, "hash_bucket").orderBy(*shuffled)
    ranked = rows.withColumn("rank_here", F.row_number().over(inside)).join(below, [source, "hash_bucket"])
    ranked = ranked.withColumn("fraction", (F.col("rank_here") + F.col("n_below") - F.lit(0.5)) / F.col("n_source")).drop("n_below", "hash_bucket", "rank_here", "n_source")
    return placed(ranked, ["fraction", source, *shuffled], "position", buckets).drop("fraction")


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard and slot, one row for each row of docs."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        col(id_col).cast("bigint").alias("doc_id"),
        # The prefixes keep a null source apart from every name.
        F.when(col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), col(source_col).cast("string"))).alias("stratum"),
        (F.octet_length(text) + OVERHEAD_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("shuffle_key", seeded_hash(seed, F.col("doc_id"), F.col("text_crc32")))
    rows = staged(rows, "shard_keys")  # texts are read once; what follows needs these columns only
    total = rows.count()
    ordered = interleaved(rows, "stratum", ["shuffle_key", "doc_id", "text_crc32", "size"], total)
    first, longer = divmod(total, shards)  # the first `longer` shards hold one row more
    edge = longer * (first + 1)
    position = F.col("position")
    shard = F.when(position < edge, F.floor(position / (first + 1))).otherwise(longer + F.floor((position - edge) / max(first, 1)))
    start = F.when(F.col("shard") < longer, F.col("shard") * (first + 1)).otherwise(edge + (F.col("shard") - longer) * first)
    return ordered.withColumn("shard", shard.cast("int")).select(
        "doc_id", F.when(F.col("stratum") != "-", F.expr("substring(stratum, 2)")).alias("source"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (position - start).cast("bigint").alias("slot")
    )
