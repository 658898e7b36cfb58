"""Window helpers against plain loops, with and without a tag split into segments."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from featherline.operators import series

START = dt.datetime(2024, 1, 1)


def make_rows(seed: int):
    rng = random.Random(seed)
    out = {}
    for tag, n in (("hot", 300), ("warm", 60), ("cold", 7), ("one", 1)):
        at, items = START, []
        for _ in range(n):
            at += dt.timedelta(minutes=rng.choice([1, 10, 60, 3000, 9000]))
            items.append((at, rng.choice([None, 1, 2, 3]), rng.random() < 0.5))
        out[tag] = items
    return out


@pytest.fixture(params=[None, 40, 3], ids=["whole", "split", "tiny segments"])
def table(request, spark):
    data = make_rows(7)
    flat = [(tag, *item) for tag, items in data.items() for item in items]
    random.Random(1).shuffle(flat)
    df = spark.createDataFrame(flat, "id string, date timestamp, v int, flag boolean")
    df = series.split_hot(df, max_rows=request.param)
    assert (series.SEGMENT in df.columns) == (request.param is not None)
    return data, df


def by_row(df, *columns):
    return {(r["id"], r["date"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_split_cuts_only_large_tags(spark):
    data = make_rows(7)
    flat = [(tag, *item) for tag, items in data.items() for item in items]
    df = spark.createDataFrame(flat, "id string, date timestamp, v int, flag boolean")
    parts = {
        r["id"]: r["n"]
        for r in series.split_hot(df, max_rows=40)
        .groupBy("id")
        .agg(F.count_distinct(series.SEGMENT).alias("n"))
        .collect()
    }
    assert parts["hot"] >= 4 and parts["warm"] >= 2 and parts["cold"] == 0 and parts["one"] == 0
    assert series.SEGMENT not in series.split_hot(df).columns


def test_neighbours(table):
    data, df = table
    got = by_row(
        series.neighbours(df, {"p": F.col("v")}, {"n": F.col("v")}, default=-1), "p", "n"
    )
    for tag, items in data.items():
        for i, (at, _, _) in enumerate(items):
            before = items[i - 1][1] if i else -1
            after = items[i + 1][1] if i + 1 < len(items) else -1
            assert got[tag, at] == (before, after)


def test_running_sum_and_per_key(table):
    data, df = table
    df = series.running_sum(df, {"s": F.when(F.col("flag"), 1).otherwise(0)})
    got = by_row(series.per_key(df, {"m": F.max("v"), "c": F.count(F.lit(1))}), "s", "m", "c")
    for tag, items in data.items():
        total, top = 0, max((v for _, v, _ in items if v is not None), default=None)
        for at, _, flag in items:
            total += flag
            assert got[tag, at] == (total, top, len(items))


def test_fill_both_ways(table):
    data, df = table
    got = by_row(
        series.fill_up(series.fill_down(df, "v", out="d"), "v", out="u"), "d", "u"
    )
    for tag, items in data.items():
        values = [v for _, v, _ in items]
        for i, (at, _, _) in enumerate(items):
            down = next((v for v in reversed(values[: i + 1]) if v is not None), None)
            up = next((v for v in values[i:] if v is not None), None)
            assert got[tag, at] == (down, up)


def test_run_id_treats_missing_as_a_value(table):
    data, df = table
    got = by_row(series.run_id(df, "v"), "run_id")
    for tag, items in data.items():
        run = 0
        for i, (at, v, _) in enumerate(items):
            run += i == 0 or v != items[i - 1][1]
            assert got[tag, at] == (run,)


def test_gap_sessions_open_at_the_gap_itself(table):
    data, df = table
    got = by_row(series.gap_sessions(df, 5), "session")
    for tag, items in data.items():
        session = 0
        for i, (at, _, _) in enumerate(items):
            session += i == 0 or (at.date() - items[i - 1][0].date()).days >= 5
            assert got[tag, at] == (session,)


@pytest.mark.parametrize("instants", [1, 900])
def test_a_burst_is_cut_by_row_keys(spark, instants):
    late = START + dt.timedelta(days=300)
    flat = [("hot", START + dt.timedelta(microseconds=i % instants), i) for i in range(900)]
    flat += [("hot", late, 900), ("hot", None, 901), ("cold", START, 902)]
    df = series.split_hot(spark.createDataFrame(flat, "id string, date timestamp, v int"), max_rows=50)
    sizes = [r["count"] for r in df.where("id = 'hot'").groupBy(series.SEGMENT).count().collect()]
    assert sum(sizes) == 902 and max(sizes) <= 100 and len(sizes) >= 9
    df = series.running_sum(df, {"nth": F.lit(1)})
    df = series.fill_down(series.neighbours(df, {"p": F.col("v")}, {"n": F.col("v")}), "v", out="d")
    got = sorted((r for r in df.collect() if r.id == "hot"), key=lambda r: r.nth)
    assert [r.nth for r in got] == list(range(1, 903))
    assert [r.p for r in got] == [None] + [r.v for r in got[:-1]]
    assert [r.n for r in got] == [r.v for r in got[1:]] + [None]
    assert [r.d for r in got] == [r.v for r in got] and {r.v for r in got} == set(range(902))
    times = [r.date for r in got]
    assert times[0] is None and times[1:] == sorted(times[1:])


def test_sampled_splitters_cut_evenly(spark, monkeypatch):
    monkeypatch.setattr(series, "CUTS_PER_TOP", 3)
    rows = spark.range(60_000).selectExpr("'hot' id", "timestamp_seconds(id * id) date", "id v")
    df = series.split_hot(rows, max_rows=2_000)
    sizes = {r[series.SEGMENT]: r["count"] for r in df.groupBy(series.SEGMENT).count().collect()}
    assert sum(sizes.values()) == 60_000 and len(sizes) >= 20 and max(sizes.values()) <= 4_000
    got = series.running_sum(df, {"nth": F.lit(1)}).where("nth <> v + 1")
    assert got.count() == 0


def test_first_where(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, 40.0), ("a", 2, 30.0), ("a", 3, 20.0), ("b", 1, 50.0)], "id string, date int, lat double"
    )
    out = series.first_where(df, {"x": F.col("lat") <= 37, "y": F.col("lat") <= 20})
    assert rows(out, "id", "x", "y") == [("a", 2, 3), ("b", None, None)]
