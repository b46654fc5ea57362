"""Embedding whitening against an eigensolver and exact arithmetic."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm.whitening import Slices, Whitening, integers, products, tridiagonal, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, dims int, component string"


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", "n", 2, "c") for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def brute(vectors, most=32):
    """Whitened values of integer vectors, up to the sign of each component."""
    x = np.array(vectors)
    n, s = len(x), x.sum(axis=0)
    centred = n * x - s
    z = centred / n
    values, directions = np.linalg.eigh(z.T @ z / n)
    values, directions = values[::-1][:most], directions[:, ::-1][:, :most]
    return n, (centred**2).sum(axis=1), z @ directions / np.sqrt(values), values / np.trace(z.T @ z / n)


def table_of(df):
    got = df.collect()
    ids, k = sorted({r.vec_id for r in got}), max(r.component for r in got)
    out = {(r.vec_id, r.component): r for r in got}
    assert len(out) == len(got) == len(ids) * k
    return ids, k, out


@pytest.mark.parametrize("spread", [1, 40])
def test_against_an_eigensolver(spark, spread):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("embedding", F.transform("embedding", lambda c: c * spread))
    ids, k, got = table_of(whiten(rows))
    given = {r.vec_id: [math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in rows.collect()}
    assert ids == sorted(given) and k == 32
    n, deviation, white, explained = brute([given[i] for i in ids])
    own = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in ids])
    signs = np.sign((own * white).sum(axis=0))
    assert np.abs(own * signs - white).max() < 1e-8
    assert np.abs(own.T @ own / n - np.eye(k)).max() < 1e-9
    for i, d in zip(ids, deviation, strict=True):
        assert {got[i, c].deviation for c in range(1, k + 1)} == {int(d)} and got[i, 1].n == n
    assert np.allclose([got[ids[0], c].explained for c in range(1, k + 1)], explained, rtol=1e-10)
    assert len({r.identity_error for r in got.values()}) == 1 and got[ids[0], 1].identity_error < 1e-9


def test_rows_that_take_no_part(spark):
    draw = np.random.default_rng(1)
    good = draw.normal(size=(30, 3)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0], [1.0] * 4]
    docs = frame(spark, [*odd, *good]).withColumn("vec_id", F.when(F.col("vec_id") != 8, F.col("vec_id")))
    result = whiten(docs)
    assert result.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = result.collect()
    assert len(got) == 90 and {r.n for r in got} == {30}
    assert {r.vec_id for r in got} == {None, 7, *range(9, 37)}


def test_repeated_rows_weigh_each_time_and_one_vector_may_hold_a_third(spark):
    draw = np.random.default_rng(2)
    vectors = [*draw.normal(size=(20, 4)).tolist(), *[[1.0, 0.0, 0.5, -1.0]] * 10]
    ids, k, got = table_of(whiten(frame(spark, vectors)))
    _, deviation, white, _ = brute([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors])
    assert k == 4 and [got[i, 1].deviation for i in ids] == deviation.tolist()
    assert np.allclose(np.abs([[got[i, c].whitened for c in range(1, 5)] for i in ids]), np.abs(white), atol=1e-9)


def test_without_variance(spark):
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [[1.0, 2.0]])).count() == 0
    assert whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whiten(frame(spark, [None, []])).count() == 0
    # two of three directions vary
    ids, k, got = table_of(whiten(frame(spark, [[float(i), float(i * i % 7), 3.0] for i in range(12)])))
    assert k == 2 and got[0, 1].identity_error < 1e-9 and abs(got[0, 1].explained + got[0, 2].explained - 1) < 1e-12


def test_extreme_entries(spark):
    """Exact beyond 64 bits; entries beyond the bound count as the bound."""
    vectors = [[1e30, 1.0], [-1e30, 2.0], [3e9, 3.0], [-2.5e9, 4.0]]
    ids, k, got = table_of(whiten(frame(spark, vectors)))
    assert k >= 1 and all(math.isfinite(r.whitened) for r in got.values())
    assert got[0, 1].deviation is None
    x = spark.createDataFrame([([1e30, -1e30, 0.5],)], "v array<double>").select(integers(F.col("v"), 64, 7).alias("x")).first().x
    assert x == [2**48 + 7, 7 - 2**48, 39]
    y = np.array([[2**40, 3], [-(2**41), 5]])
    assert products(y).tolist() == [[2**80 + 2**82, 3 * 2**40 - 5 * 2**41], [3 * 2**40 - 5 * 2**41, 34]]
    few = np.random.default_rng(3).integers(-(2**25), 2**25, (40, 3))
    assert (products(few) == few.astype(object).T @ few.astype(object)).all()
    model = Whitening(3, np.zeros(1, np.int64), np.zeros(1, object), np.ones(1), np.ones((1, 1)), 1.0)
    assert Whitening.deviations(model.centred(np.array([[2**31], [2**29]]))) == [None, 9 * 2**58]


def matrices():
    draw = np.random.default_rng(4)
    q = np.linalg.qr(draw.normal(size=(40, 40)))[0]
    for values in ([5.0] * 10 + [3.0] * 10 + [0.0] * 20, 1 + 1e-9 * np.arange(40), np.ones(40), 10.0 ** -np.arange(40), np.arange(40.0), -np.arange(40.0), 1e-300 * np.arange(40)):
        m = (q * np.array(values)) @ q.T
        yield (m + m.T) / 2
    yield np.zeros((3, 3))
    yield np.array([[2.0]])
    yield np.array([[1.0, 2.0], [2.0, -3.0]])
    yield np.diag([1.0, 2.0, 2.0, 7.0])


@pytest.mark.parametrize("m", list(matrices()))
def test_slices(m):
    slices = Slices(m)
    want = np.linalg.eigvalsh(m)[::-1]
    got = slices.leading(32)
    scale = max(np.abs(want).max(), 1e-300)
    assert len(got) == min(32, len(m))
    assert np.abs(np.array([e for e, _ in got]) - want[: len(got)]).max() <= 1e-13 * scale
    v = np.array([u for _, u in got])
    assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-10
    assert max(np.linalg.norm(m @ u - e * u) for e, u in got) <= 1e-12 * scale


def test_counts_are_those_of_exact_pivots():
    """L D Lᵀ in fractions, as the definition has it."""
    m = np.random.default_rng(6).integers(-9, 9, (7, 7))
    m = m + m.T
    slices = Slices(m.astype(float))
    for shift in (-31, -7, 0, 3, 11, 40):
        a = [[Fraction(int(m[i, j])) - shift * (i == j) for j in range(7)] for i in range(7)]
        positive = 0
        for k in range(7):
            assert a[k][k] != 0
            positive += a[k][k] > 0
            for i in range(k + 1, 7):
                f = a[i][k] / a[k][k]
                a[i] = [x - f * y for x, y in zip(a[i], a[k], strict=True)]
        assert slices.above(shift / slices.unit) == positive
    diagonal, squares = tridiagonal(m.astype(float))
    t = np.diag(diagonal) + np.diag(np.sqrt(squares), 1) + np.diag(np.sqrt(squares), -1)
    assert np.allclose(np.linalg.eigvalsh(t), np.linalg.eigvalsh(m))
