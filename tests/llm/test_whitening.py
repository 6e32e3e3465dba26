"""Whitening against numpy on the same rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from netquill.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, component int, x string, id int"


def frame(spark, vectors, parts=3, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 5, "x", 1) for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(parts)


def brute(vectors):
    """{component: (whitened by row up to its sign, share of the trace)} and exact deviations."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    deviations = [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[float(v - Fraction(s, n)) for v, s in zip(r, sums, strict=True)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return centred, values[::-1], vectors[:, ::-1], deviations


def check(rows, vectors, components=8):
    centred, values, axes, deviations = brute(vectors)
    k = min(components, len(values))
    assert len(rows) == k * len(vectors) and {r.n for r in rows} == {len(vectors)}
    for c in range(k):
        mine = sorted((r for r in rows if r.component == c + 1), key=lambda r: r.vec_id)
        assert [r.deviation for r in mine] == deviations == [int(r.deviation_exact) for r in mine]
        want, have = centred @ axes[:, c] / math.sqrt(values[c]), np.array([r.whitened for r in mine])
        assert np.abs(have - want * np.sign(have @ want)).max() < 1e-8
        assert all(r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9) for r in mine)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-6


@pytest.mark.parametrize(("n", "d"), [(400, 12), (60, 3), (2000, 20)])
def test_against_numpy(spark, n, d):
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 5).astype(np.float32).tolist()
    check(whitening.whiten(frame(spark, vectors)).collect(), vectors)


def test_what_does_not_count(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(50, 9)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None] + [0.0] * 7, [float("nan")] + [0.0] * 8, [float("inf")] + [0.0] * 8, [float("-inf")] * 9, [1.0] * 8, [2.0] * 10]
    rows = whitening.whiten(frame(spark, vectors + odd)).collect()
    check(rows, vectors)


def test_repeated_rows_and_null_ids(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 4)).astype(np.float32).tolist()
    rows = whitening.whiten(frame(spark, vectors * 2 + [vectors[0]], ids=[*range(40)] * 2 + [None])).collect()
    assert len(rows) == 81 * 4 and sum(r.vec_id is None for r in rows) == 4 and rows[0].n == 81
    whitened = {(r.vec_id, r.component): r.whitened for r in rows}
    assert all(whitened[r.vec_id, r.component] == pytest.approx(r.whitened, abs=1e-12) for r in rows)
    assert whitened[None, 1] == pytest.approx(whitened[0, 1], abs=1e-12)


@pytest.mark.parametrize("vectors", [[], [None, []], [[float("nan")]]])
def test_nothing_to_fit(spark, vectors):
    df = whitening.whiten(frame(spark, vectors, 1))
    assert df.count() == 0 and df.columns[:3] == ["vec_id", "component", "n"]


def test_without_scale(spark):
    rows = whitening.whiten(frame(spark, [[1.0, 2.0]] * 5)).collect()
    assert len(rows) == 10 and all(r.whitened is None and r.identity_error is None and r.explained is None and r.deviation == 0 for r in rows)
    # Two vectors span one dimension only.
    rows = whitening.whiten(frame(spark, [[1.0, 2.0, 3.0], [2.0, 2.0, 5.0]])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in rows)
    assert sorted(r.whitened for r in rows if r.component == 1) == pytest.approx([-1, 1])
    assert rows[0].identity_error < 1e-9


def test_huge_entries(spark):
    """Exact sums that pass 64 bits; entries beyond 2^40 count as 2^40."""
    vectors = [[3e38, 1.0], [-3e38, 2.0], [0.0, 3.0]]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    most = 1024 * 2**40 + 100000
    x = [(most, 101024), (100000 - 1024 * 2**40, 102048), (100000, 103072)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((3 * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for i, r in enumerate(x)}
    assert {r.vec_id: int(r.deviation_exact) for r in rows} == want
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in rows)


def test_query_against_numpy(spark):
    path = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    check(queries.op12_whitening(spark, path).collect(), [vectors[i] for i in sorted(vectors)])
