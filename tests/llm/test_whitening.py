"""Whitening against a plain eigendecomposition, and exact sums."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gleaner.llm import whitening


def frame(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, component int, n string")


def test_factor_and_rotation():
    rng = np.random.default_rng(3)
    for size, rank in ((1, 1), (2, 2), (7, 7), (16, 16), (9, 4)):
        b = rng.normal(size=(size, rank)) * 10.0 ** rng.uniform(-3, 3, size=rank)
        v = b @ b.T
        low = whitening.cholesky(v)
        assert low.shape == (size, rank)
        assert np.allclose(low @ low.T, v, rtol=1e-10, atol=1e-12 * np.abs(v).max())
        e, axes = whitening.jacobi(low)
        want = np.linalg.eigvalsh(v)[::-1][:rank]
        assert np.allclose(e, want, rtol=1e-9, atol=1e-13 * want[0])
        assert np.abs(axes.T @ axes - np.eye(rank)).max() < 1e-9
        assert np.allclose(axes * e @ axes.T, v, rtol=1e-9, atol=1e-12 * np.abs(v).max())


def test_columns_of_any_count_meet_once():
    for n in range(2, 9):
        pairs = [(int(a), int(b)) for p, q in whitening._rounds(n) for a, b in zip(p, q)]
        assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i + 1, n)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-2 ** 40, 2 ** 40), min_size=3, max_size=3), min_size=1, max_size=8))
def test_products_are_exact(rows):
    got = whitening._products(np.array(rows, np.int64))
    assert got.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]


def test_report_equals_plain_whitening(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) / 10
    rows = [(i, [float(x) for x in v], 7, "x") for i, v in enumerate(data)]
    rows += [(1000, None, 1, "x"), (1001, [math.nan] * 12, 1, "x"), (1002, [None] + [0.5] * 11, 1, "x"), (1003, [math.inf] + [0.5] * 11, 1, "x"), (1004, [], 1, "x"),
             (1005, [1.0, 2.0], 1, "x"), (None, [float(x) for x in data[0]], 1, "x"), (0, [float(x) for x in data[0]], 1, "x")]
    out = whitening.report(frame(spark, rows).repartition(5), components=8)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    used = np.floor(1024 * np.concatenate([data, data[:1], data[:1]])).astype(np.int64) + 100000
    n, s = len(used), used.sum(0)
    assert len(got) == 8 * n and {r.n for r in got} == {302}
    centred = used - used.mean(0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    want = centred @ u[:, :8] / np.sqrt(e[:8])
    for k in range(8):
        mine = {r.vec_id: r for r in got if r.component == k + 1}
        sign = np.sign(mine[5].whitened * want[5, k])
        for i in range(300):
            assert mine[i].whitened * sign == pytest.approx(want[i, k], abs=1e-8)
            assert mine[i].deviation == int(((n * used[i] - s) ** 2).sum())
            assert mine[i].explained == pytest.approx(e[k] / e.sum(), rel=1e-10)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == list(range(300)) and sum(r.vec_id is None for r in got) == 8


def test_covariance_is_exact_whatever_the_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v], 0, "") for i, v in enumerate(rng.normal(size=(97, 5)) * [1, 1e6, 1e-3, 1e10, 1])]
    models = [whitening.fit(frame(spark, rows).repartition(k), shift=3) for k in (1, 7)]
    assert models[0].sums == models[1].sums and models[0].trace == models[1].trace
    assert (models[0].axes == models[1].axes).all() and (models[0].eigenvalues == models[1].eigenvalues).all()
    x = [[math.floor(1024 * c) + 3 for c in v] for _, v, _, _ in rows]
    total = sum(Fraction(sum(r[j] ** 2 for r in x), 97) - Fraction(sum(r[j] for r in x), 97) ** 2 for j in range(5))
    assert models[0].trace == float(total)


def test_few_and_constant_vectors(spark):
    assert whitening.report(frame(spark, [])).collect() == []
    assert whitening.report(frame(spark, [(1, None, 0, "")])).collect() == []
    assert whitening.report(frame(spark, [(1, [0.5, 0.25], 0, "")])).collect() == []
    assert whitening.report(frame(spark, [(i, [0.5, 0.25], 0, "") for i in range(4)])).collect() == []
    line = whitening.report(frame(spark, [(i, [float(i), 2.0 * i, 1.0], 0, "") for i in range(4)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 4 and line[0].explained == pytest.approx(1.0)


def test_extreme_components(spark):
    rows = [(0, [1e300, 0.0], 0, ""), (1, [-1e300, 1.0], 0, ""), (2, [1e-300, 2.0], 0, "")]
    got = whitening.report(frame(spark, rows)).collect()
    assert {(r.vec_id, r.deviation) for r in got} == {(0, None), (1, None), (2, 3072 ** 2)} and all(math.isfinite(r.whitened) for r in got)


def test_other_types(spark):
    rows = [(str(i), [float(i), float(i * i)]) for i in range(6)]
    got = whitening.report(spark.createDataFrame(rows, "key string, v array<float>"), "key", "v").collect()
    assert {r.vec_id for r in got} == {str(i) for i in range(6)}
