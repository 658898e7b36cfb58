"""Null rules, quantiles and the mixed model."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherline.functions import nulls
from featherline.operators import crossing, mixed_model
from featherline.operators.quantiles import group_quantiles, large_quantiles


def test_strict_and_lenient_aggregates(spark):
    df = spark.createDataFrame(
        [(1, 1.0, True), (1, 2.0, False), (2, None, True), (2, 3.0, True), (3, None, False), (4, 1.0, None)],
        "g int, x double, w boolean",
    )
    got = {
        r.g: (r.lo, r.hi, r.strict, r.lenient)
        for r in df.groupBy("g")
        .agg(
            nulls.strict_min(F.col("x")).alias("lo"),
            nulls.strict_max(F.col("x")).alias("hi"),
            nulls.strict_sum(F.col("x"), F.col("w")).alias("strict"),
            nulls.lenient_sum(F.col("x"), F.col("w")).alias("lenient"),
        )
        .collect()
    }
    assert got == {
        1: (1.0, 2.0, 1.0, 1.0),
        2: (None, None, None, 3.0),
        3: (None, None, 0.0, 0.0),
        4: (1.0, 1.0, None, 0.0),
    }


def test_conditions(spark):
    df = spark.createDataFrame([(None,), (True,), (False,)], "c boolean")
    got = [r[0] for r in df.select(nulls.if_known(F.col("c"), F.lit(1), F.lit(2))).collect()]
    assert got == [None, 1, 2]
    df = spark.createDataFrame([(None,), (2,), (9,)], "v int")
    assert [r[0] for r in df.select(nulls.among(F.col("v"), [1, 2])).collect()] == [False, True, False]


def test_large_quantiles_match_numpy(spark):
    rng = random.Random(2)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(3000)],
        "tied": [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(2000)],
        "skewed": [rng.random() ** 9 for _ in range(1500)] + [1e9],
        "pair": [1.0, 2.0],
        "single": [4.0],
        None: [1.0, 5.0, 6.0],
        "clustered": [1.0 + k * 2.0**-52 for k in range(3000)] + [-1e300, 1e300],
        "signs": [-0.0, 0.0, -5e-324, 5e-324, -1.5, -1e-9, 2.0, -7.0],
        "zeros": [0.0] * 2000 + [-0.0] * 10,
    }
    df = spark.createDataFrame(
        [(g, v) for g, vs in groups.items() for v in vs] + [("pair", None)], "g string, v double"
    )
    probs = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    out = large_quantiles(df.repartition(5), ["g"], "v", probs)
    got = {r.g: [r[n] for n in probs] for r in out.collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, list(probs.values()))), rel=1e-15, abs=1e-322)
    assert large_quantiles(df.where("g = 'pair' and v is null"), ["g"], "v", probs).count() == 0


@pytest.mark.parametrize("n", [1, 30_000])
def test_quantiles_of_infinite_values_are_the_same_at_every_size(spark, n):
    inf = float("inf")
    rows = [("top", inf)] * n + [("top", 1.0)] * n + [("low", -inf)] * n + [("low", 2.0)] + [("all", inf)] * n
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: tuple(r)[1:] for r in large_quantiles(df, ["g"], "v", {"p0": 0.0, "p25": 0.25, "p100": 1.0}).collect()}
    assert got["all"] == (inf, inf, inf)
    assert got["top"] == (1.0, inf if n == 1 else 1.0, inf)
    assert got["low"] == (-inf, -inf, 2.0)


def test_group_quantiles_of_counts(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 1, 2, 10)] + [("b", 3)], "g string, v int")
    got = {r.g: r.m for r in group_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 1.5, "b": 3.0}


def test_box_whiskers_end_at_data(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "g string, v double")
    r = crossing.box_stats(df, "g", "v").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.n_outside) == (3, 5, 7, 1, 8, 1)


def test_half_bin(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 1.0, 2.0, 5.0)], "id string, x double")
    assert crossing.half_bin(df, "x", "id").first().half_bin == 0.5
    assert crossing.half_bin(df, "x", "id", max_rows=1).first().half_bin == 0.5


def simulate(spread: float, seed: int = 4):
    rng = np.random.default_rng(seed)
    ids, y, x = [], [], []
    for tag in range(12):
        n = int(rng.integers(3, 12))
        shift = rng.normal(0, spread)
        for _ in range(n):
            b = int(rng.integers(0, 2))
            ids.append(tag)
            x.append(b)
            y.append(10 + 3 * b + shift + rng.normal(0, 1.5))
    return np.array(ids), np.array(y), np.array(x, dtype=float)


def dense(ids, y, x, ratio):
    design = np.column_stack([np.ones_like(x), x])
    v = np.eye(len(y)) + ratio * (ids[:, None] == ids[None, :])
    inverse = np.linalg.inv(v)
    a = design.T @ inverse @ design
    b = np.linalg.solve(a, design.T @ inverse @ y)
    rest = y - design @ b
    s2 = rest @ inverse @ rest / (len(y) - 2)
    deviance = (len(y) - 2) * (np.log(s2) + 1 + np.log(2 * np.pi)) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]
    return deviance, b, s2, np.linalg.inv(a) * s2


@pytest.mark.parametrize("ratio", [0.0, 0.1, 1.0, 5.0])
def test_model_profile_matches_dense_matrices(spark, ratio):
    ids, y, x = simulate(2.0)
    df = spark.createDataFrame(list(zip(ids.tolist(), y.tolist(), x.tolist())), "id int, y double, x double")
    r = mixed_model.profile(mixed_model.group_sums(df, "y", "x"), [ratio]).first()
    deviance, b, s2, cov = dense(ids, y, x, ratio)
    assert r.deviance == pytest.approx(deviance)
    assert (r.intercept, r.slope) == pytest.approx(tuple(b))
    assert r.var_residual == pytest.approx(s2)
    assert (r.se_intercept, r.se_slope) == pytest.approx((cov[0, 0] ** 0.5, cov[1, 1] ** 0.5))
    assert r.se_mean_other == pytest.approx((cov[0, 0] + cov[1, 1] + 2 * cov[0, 1]) ** 0.5)


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_model_finds_the_least_deviance(spark, spread):
    ids, y, x = simulate(spread)
    df = spark.createDataFrame(list(zip(ids.tolist(), y.tolist(), x.tolist())), "id int, y double, x double")
    r = mixed_model.barrier_model(df, "y", "x").first()
    fine = min(dense(ids, y, x, q)[0] for q in np.concatenate([[0], np.logspace(-6, 4, 4001)]))
    assert r.deviance == pytest.approx(fine, abs=1e-4)
    assert r.contrast == -r.slope and r.mean_other == r.intercept + r.slope


@pytest.mark.parametrize("mean", [0.0, 1e6])
def test_model_keeps_its_digits_at_large_means(spark, mean):
    ids, y, x = simulate(2.0)
    df = spark.createDataFrame(list(zip(ids.tolist(), (y + mean).tolist(), x.tolist())), "id int, y double, x double")
    r = mixed_model.barrier_model(df, "y", "x").first()
    _, b, s2, cov = dense(ids, y, x, r.ratio)
    assert r.converged
    assert (r.intercept - mean, r.slope, r.var_residual) == pytest.approx((b[0], b[1], s2), rel=1e-6)
    assert (r.se_intercept, r.se_slope) == pytest.approx((cov[0, 0] ** 0.5, cov[1, 1] ** 0.5), rel=1e-6)
    step = 1e-5
    assert r.deviance <= min(dense(ids, y, x, r.ratio * 10**d)[0] for d in (-step, step)) + 1e-9


def test_model_search_says_whether_it_has_converged(spark):
    # Tags differ and nothing else: the ratio grows without end.
    rows = [(t, float(t) + 2.0 * b, b) for t in range(5) for b in (0, 1, 1)]
    noise = [(t, v + 1e-9 * ((i * 7) % 5), b) for i, (t, v, b) in enumerate(rows)]
    df = spark.createDataFrame(noise, "id int, y double, x int")
    assert not mixed_model.barrier_model(df, "y", "x", limits=(-3.0, 2.0)).first().converged
    # No difference between tags: zero is the best ratio.
    flat = spark.createDataFrame([(t, float(b + w), b) for t in range(5) for b in (0, 1) for w in (0, 1, 2)], "id int, y double, x int")
    r = mixed_model.barrier_model(flat, "y", "x").first()
    assert (r.ratio, r.converged) == (0.0, True)
    assert mixed_model.barrier_model(flat.limit(0), "y", "x").count() == 0


def test_levels_of_a_factor(spark):
    df = spark.createDataFrame([("Inside",), ("Outside",), ("Elsewhere",), (None,)], "barrier string")
    assert [r.barrier for r in mixed_model.coded(df, "barrier", "Outside", "Inside").collect()] == [1, 0, None, None]
