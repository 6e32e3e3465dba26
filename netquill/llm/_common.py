"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..functions.staging import shared_folder, staged  # noqa: F401  (the operators take them from here)

#: ASCII white space, as the class [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its exact name, even if it holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns of these names renamed, and what gives back df's columns under their own names."""
    moved = {c: free_name(df, f"nq_own_{c}") for c in df.columns if c.lower() in names}
    own = df.columns
    return df.withColumnsRenamed(moved), lambda got: got.select(*[col(moved.get(c, c)).alias(c) for c in own])


def sheltered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under names that hold no dots and clash with none inside an operator, and the new name of each old one in lower case."""
    names = {c.lower(): f"nq_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*[f"nq_c{i}" for i in range(len(df.columns))]), names


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; an id that is null counts as 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def per_text(df: DataFrame, schema: str, make: Callable[[], Callable[[list[bytes]], list[pa.Array]]], keep: Iterable[str], text_col: str = "text") -> DataFrame:
    """Add columns computed from whole texts, batch by batch, in Arrow.

    make() is called once a task and returns the function from texts to new columns; the
    columns in keep pass through, but for those that a new column of the same name replaces.
    Output batches hold a slice of each input batch, so that memory stays bounded by the
    largest text rather than by the number of rows.
    """
    added = DataType.fromDDL(schema)
    names = [f.name for f in added]
    keep = [c for c in dict.fromkeys(keep) if c.lower() not in {n.lower() for n in names}]
    plain, at = sheltered(df)
    places, text_at = [at[c.lower()] for c in keep], at[text_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in by_bytes(batch, text_at):
                columns = [part.column(c) for c in places] + work(texts_of(part.column(text_at)))
                yield pa.RecordBatch.from_arrays(columns, names=[*places, *names])

    got = plain.select(*dict.fromkeys([*places, text_at])).mapInArrow(run, StructType([*(plain.schema[c] for c in places), *added]))
    return got.select(*[F.col(p).alias(c) for c, p in zip(keep, places, strict=True)], *[col(n) for n in names])


def by_bytes(batch: pa.RecordBatch, text_col: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts have about `most` bytes together, one text at least."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


import pyarrow.compute  # noqa: E402, F401  (makes pa.compute available)
