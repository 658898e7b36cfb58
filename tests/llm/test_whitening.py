"""Whitening against plain numpy with exact integers."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from featherline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "c", "n") for i, v in rows], SCHEMA.replace("float", kind))


def brute(rows, components):
    length = max({len(v) for _, v in rows}, key=lambda k: sum(len(v) == k for _, v in rows))
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in rows if len(v) == length], object)
    n, sums = len(x), x.sum(axis=0)
    d = n * x - sums
    centred = (d / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, (d * d).sum(axis=1).tolist(), centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening_is_that_of_numpy(spark, kind):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) + rng.normal(size=12) * 5).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    rows += [(3, rows[3][1]), (None, rows[5][1])]
    odd = [(900, None), (901, [None] * 12), (902, [1.0] * 11 + [float("nan")]), (903, [float("-inf")] + [0.0] * 11), (904, []), (905, [1.0])]
    got = whitening.whiten(table(spark, rows + odd, kind).repartition(5), 8).collect()
    n, deviation, want, explained = brute(rows, 8)
    assert {r.n for r in got} == {n} == {402} and len(got) == 8 * n
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9
    mine = defaultdict(list)
    for r in got:
        mine[r.vec_id].append(r)
    signs = np.array([np.sign(next(r.whitened for r in mine[0] if r.component == k + 1) * want[0, k]) for k in range(8)])
    for (vec_id, _), exact, row in zip(rows, deviation, want):
        for r in mine[vec_id]:
            assert int(r.deviation_exact) == exact
            assert abs(r.whitened * signs[r.component - 1] - row[r.component - 1]) < 1e-9
            assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert not set(mine) & {i for i, _ in odd}


def test_components_without_variance_have_no_rows(spark):
    rng = np.random.default_rng(4)
    flat = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 6))
    rows = [(i, np.floor(1024 * v).tolist()) for i, v in enumerate(np.c_[flat[:, :2], flat[:, :2], np.ones((60, 2))])]
    got = whitening.whiten(table(spark, rows, "double"), 8).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-9
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 9)).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e12 * i, -3.0 * i * i]) for i in range(50)] + [(99, [1e300, 0.5])]
    got = {r.vec_id: r for r in whitening.whiten(table(spark, rows, "double"), 1).collect()}
    x = [[min(math.floor(1024 * a), 1 << 52) + 100000, math.floor(1024 * b) + 100000] for _, (a, b) in rows]
    sums = [sum(v) for v in zip(*x)]
    for (vec_id, _), v in zip(rows, x):
        assert int(got[vec_id].deviation_exact) == sum((51 * a - s) ** 2 for a, s in zip(v, sums))


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_cholesky_and_jacobi(size):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(size, 2 * size)) * np.logspace(0, -6, size)[:, None]
    factor = whitening.pivoted_cholesky(a @ a.T)
    assert np.allclose(factor @ factor.T, a @ a.T, rtol=0, atol=1e-13 * np.abs(a @ a.T).max())
    values, axes = whitening.one_sided_jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(a @ a.T)[::-1][: len(values)], rtol=1e-9)
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-13)
