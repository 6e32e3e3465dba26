"""Whitening of embeddings by the eigenvectors of their covariance.

Entries become integers (SCALE times the entry, rounded down, plus SHIFT), so that sums are
exact. One aggregation counts the vectors and sums every dimension; a second one has a Spark
SQL expression sum(ci * cj) for every pair of the upper triangle, over the centred dimensions
c0, c1, ... Every task sums up its own rows, sums of neighbouring tasks meet in at most GROUPS
rows, and only those d * (d + 1) / 2 numbers each go to the driver, where they are added without
rounding errors and LAPACK decomposes the symmetric matrix. Rows are then projected where they are,
in batches, and the covariance of what came out is measured, not taken for granted.

Components have length 1 and are numbered by falling eigenvalue; the entry of a component with
the largest absolute value is positive.

Edge cases: vectors that are null or hold null or non-finite entries are left out. Of vectors
of several lengths the most frequent length counts (of ties the longest); others are left out.
Entries beyond MOST are taken as MOST. Repeated rows and null ids count like others. A
component whose eigenvalue is zero up to rounding (fewer vectors than dimensions, or constant
ones) has no scale: its rows have whitened null, and identity_error is over the others.
deviation is null where the exact sum passes 64 bits; deviation_exact then still has it, up to
38 digits. No vectors, or vectors without entries, give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import fsum
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ._common import col, staged

SCALE, SHIFT, COMPONENTS = 1024, 100000, 8
#: Largest absolute value of an entry that is told apart, 2^40.
MOST = float(1 << 40)
#: Rows of partial sums that reach the driver at most.
GROUPS = 64


class Model(NamedTuple):
    """What the fit list gives: n, sums by dimension, eigenvalues by falling size, components in rows, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    largest: int

    @property
    def usable(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > max(self.values.max(initial=0), 0) * len(self.sums) * np.finfo(float).eps


def as_integers(vector: Column) -> Column:
    scaled = lambda c: F.greatest(F.lit(-MOST * SCALE), F.least(F.lit(MOST * SCALE), c.cast("double") * SCALE))
    return F.transform(vector, lambda c: F.floor(scaled(c)) + F.lit(SHIFT))


def fit_list(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, x) of the vectors that count, as integers, and their length."""
    finite = F.forall(col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    able = vectors.where(col(vector_col).isNotNull() & finite).select(col(id_col).alias("id"), as_integers(col(vector_col)).alias("x"))
    common = able.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common.d if common else 0
    return able.where(F.size("x") == d), d


def dimension_sums(x: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Number of vectors, exact sum of each dimension, and largest absolute entry."""
    row = x.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest"), *[F.expr(f"sum(cast(x[{i}] as decimal(19, 0))) as s{i}") for i in range(d)]).first()
    return row.n, [int(row[f"s{i}"]) for i in range(d)], row.largest


def pair_sums(x: DataFrame, means: list[float]) -> np.ndarray:
    """The matrix of sums of centred products, from one aggregation with an expression for each pair."""
    d = len(means)
    # No entry is null; where Spark knows that, the code that it makes for each sum is half as long.
    centred = x.select((F.spark_partition_id() % GROUPS).alias("task"), *[F.expr(f"cast(coalesce(x[{i}], 0L) as double) - {m!r}D as c{i}") for i, m in enumerate(means)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = centred.groupBy("task").agg(*[F.expr(f"sum(c{i} * c{j}) as p{i}_{j}") for i, j in pairs]).drop("task").collect()  # at most GROUPS rows
    out = np.empty((d, d))
    for (i, j), parts in zip(pairs, zip(*rows, strict=True), strict=True):
        out[i, j] = out[j, i] = fsum(parts)
    return out


def fit_whitening(x: DataFrame, d: int, components: int = COMPONENTS) -> Model:
    """The model of vectors x (see fit_list)."""
    n, sums, largest = dimension_sums(x, d)
    covariance = pair_sums(x, [float(Fraction(s, n)) for s in sums]) / n
    values, vectors = np.linalg.eigh(covariance)
    values, rows = values[::-1][:components], vectors.T[::-1][:components]
    rows = rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]
    return Model(n, sums, values, rows, float(np.trace(covariance)), largest)


def project(x: DataFrame, model: Model) -> DataFrame:
    """(id, deviation, deviation_exact, w): the whitened components of each vector."""
    n, sums, d = model.n, model.sums, len(model.sums)
    means = np.array([float(Fraction(s, n)) for s in sums])
    usable = model.usable
    scaled = model.components[usable].T / np.sqrt(model.values[usable])
    small = n * (model.largest + 1) < 1 << 61
    added = DataType.fromDDL("deviation bigint, deviation_exact decimal(38,0), w array<double>")

    def deviations(rows: np.ndarray) -> list[int]:
        """Exact: in 64 bits where they hold the sum, else with Python's integers."""
        if small:
            apart = rows * n - np.array(sums)
            rough = (apart.astype(float) ** 2).sum(axis=1)
            fits = rough < 2.0**62
            out = (apart[fits] ** 2).sum(axis=1).tolist()
            if fits.all():
                return out
            whole = np.zeros(len(rows), object)
            whole[fits], whole[~fits] = out, [sum(v * v for v in r) for r in apart[~fits].tolist()]
            return whole.tolist()
        return [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in rows.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("x").flatten().to_numpy().reshape(-1, d)
            exact = deviations(rows)
            w = np.full((len(rows), len(usable)), np.nan)
            w[:, usable] = (rows - means) @ scaled
            flat = pa.array(w.ravel(), from_pandas=True)  # nan: no scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, len(usable)), pa.int32()), flat)
            whole = pa.array([v if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()), whole, lists], names=["id", "deviation", "deviation_exact", "w"])

    return x.select("id", "x").mapInArrow(run, StructType([x.schema["id"], *added]))


def identity_error(rows: DataFrame, model: Model) -> float | None:
    """Largest absolute entry of the covariance of w minus the identity."""
    at = np.flatnonzero(model.usable).tolist()
    if not at:
        return None
    means = rows.agg(*[F.expr(f"avg(w[{i}]) as m{i}") for i in at]).first()
    centred = rows.select(*[F.expr(f"w[{i}] - {means[f'm{i}']!r}D as c{i}") for i in at])
    pairs = [(i, j) for i in at for j in at if i <= j]
    sums = centred.agg(*[F.expr(f"sum(c{i} * c{j}) as p{i}_{j}") for i, j in pairs]).first()
    return max(abs(sums[f"p{i}_{j}"] / model.n - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector of the fit list and component: (id_col, component, n, deviation, whitened, explained, identity_error, deviation_exact)."""
    x, d = fit_list(vectors, id_col, vector_col)
    own = StructField(id_col, vectors.schema[id_col].dataType)
    rest = DataType.fromDDL("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    if not d:
        return vectors.sparkSession.createDataFrame([], StructType([own, *rest]))
    model = fit_whitening(x, d, components)
    rows = staged(project(x, model), "whitened")
    error = F.lit(identity_error(rows, model)).cast("double")
    shares = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else None).cast("double") for v in model.values])
    long = rows.select("id", "deviation", "deviation_exact", F.posexplode("w").alias("at", "whitened"))
    return long.select(col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), error.alias("identity_error"), "deviation_exact")
