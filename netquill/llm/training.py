"""Bounded samples of labelled rows, for models that are trained on the driver."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod

#: The bounds of a sample: rows, and bytes of all its texts together.
SAMPLE_ROWS, SAMPLE_BYTES = 8000, 64 << 20


def learn_rows(modulus: int, held_out: int) -> Column:
    """True for rows (doc_id) that may be learnt from."""
    return F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), modulus) != held_out)


def sample_texts(docs: DataFrame, labelled: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, object]]:
    """(text, label) of at most `rows` rows of docs (doc_id, text), whole texts of any length, chosen by a hash of the id.

    labelled has doc_id and label, learnable rows only. Ids are chosen first, from narrow rows,
    then cut, in the order of the hash, where their texts would pass most_bytes together; so
    length does not decide who is in the sample, but for a text that passes most_bytes alone.
    Of rows with the same id the longest text counts.
    """
    spark = docs.sparkSession
    one = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = one.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(rows).collect()
    if not chosen:
        return []
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")

    def of(ids: list) -> DataFrame:
        return docs.join(F.broadcast(spark.createDataFrame(ids, one.schema)), "doc_id")  # bounded by `rows`

    sizes = {r.doc_id: r.size for r in of(chosen).groupBy("doc_id").agg(F.max(F.octet_length(text)).alias("size")).collect()}
    able = [r for r in chosen if sizes.get(r.doc_id, most_bytes + 1) <= most_bytes]
    held = bisect_right(list(accumulate(sizes[r.doc_id] for r in able)), most_bytes)
    if not held:
        return []
    longest = of(able[:held]).groupBy("doc_id", "label").agg(F.max(F.struct(F.octet_length(text).alias("size"), text.alias("text"))).alias("t"))
    return [(bytes(r.t.text), r.label) for r in sorted(longest.toLocalIterator(), key=lambda r: r.doc_id)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Adam:
    """Steps for a dict of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.n = params, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, g in grads.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            self.params[k] -= scale * self.first[k] / (np.sqrt(self.second[k]) + 1e-8)
