"""Migration periods: borders of each rule, and random tags against a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from featherline import study
from featherline.operators import periods, rules
from featherline.plans.flight_plan import flight_periods
from featherline.sources.inline import rule_table

DAY = dt.timedelta(days=1)
BASE = dt.datetime(2023, 8, 10, 20)
SCHEMA = "id string, flight_group int, takeoff_time timestamp, duration_hours double"


def table(spark, offsets, hours=10.0, tag="a", base=BASE):
    data = [(tag, i, base + o * DAY, hours) for i, o in enumerate(offsets)]
    return spark.createDataFrame(data, SCHEMA)


def periods_of(df, **rules_):
    return [r.period for r in flight_periods(df, **rules_).orderBy("id", "takeoff_time", "flight_group").collect()]


def test_gap_of_five_days_opens_a_period(spark):
    assert periods_of(table(spark, [0, 1, 2, 6, 7])) == [2.0] * 5
    assert periods_of(table(spark, [0, 1, 2, 7, 8, 9])) == [2.0] * 3 + [4.0] * 3


def test_density_window_is_five_days_either_side(spark):
    days = periods.gap_periods(periods.flight_days(table(spark, [0, 4, 8, 12])))
    assert {r.dense for r in periods.with_density(days).collect()} == {True}
    days = periods.gap_periods(periods.flight_days(table(spark, [0, 5, 10])), gap_days=6)
    assert {r.dense for r in periods.with_density(days).collect()} == {True}
    days = periods.gap_periods(periods.flight_days(table(spark, [0, 6, 12])), gap_days=7)
    assert {r.dense for r in periods.with_density(days).collect()} == {False}


@pytest.mark.parametrize("hours, valid", [(16.0 / 4, None), (16.04 / 4, 2.0)])
def test_total_hours_must_exceed_sixteen(spark, hours, valid):
    assert periods_of(table(spark, [0, 1, 2, 3], hours)) == [valid] * 4


def test_spring_periods_before_the_last_become_one(spark):
    base = dt.datetime(2024, 3, 1, 20)
    offsets = [0, 1, 2, 20, 21, 22, 40, 41, 42, 110, 111, 112]
    assert periods_of(table(spark, offsets, base=base)) == [2.0] * 6 + [4.0] * 3 + [6.0] * 3


def test_unknown_takeoff_gets_no_period(spark):
    df = table(spark, [0, 1, 2]).unionAll(
        spark.createDataFrame([("a", 9, None, 3.0)], SCHEMA)
    )
    got = {r.flight_group: (r.period, r.gap) for r in flight_periods(df).collect()}
    assert got == {0: (2.0, None), 1: (2.0, 1), 2: (2.0, 1), 9: (None, None)}


def test_recodes_do_not_feed_each_other(spark):
    df = spark.createDataFrame(
        [("DB6", 8.0), ("DB6", 10.0), ("DB6", 4.0), ("ACA", 12.0), ("ACA", 8.0), ("AC4", 8.0), ("DB6", None)],
        "id string, period double",
    )
    recodes = rule_table(
        spark, study.FLIGHT_RECODES, "id string, at_least double, at_most double, becomes double"
    )
    got = sorted((r.id, str(r.period)) for r in rules.recode_period(df, recodes).collect())
    assert got == sorted(
        [("DB6", "None"), ("DB6", "8.0"), ("DB6", "4.0"), ("ACA", "None"), ("ACA", "8.0"), ("AC4", "8.0"), ("DB6", "None")]
    )


def test_of_several_recodes_the_first_by_rank_counts(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 9.0)], "id string, period double")
    schema = "id string, at_least double, at_most double, becomes double, rank int"
    both = [("a", 0.0, None, 1.0, 2), ("a", 4.0, 6.0, 2.0, 1)]
    for order in (both, both[::-1]):
        ranked = rules.recode_period(df, spark.createDataFrame(order, schema)).collect()
        assert sorted(r.period for r in ranked) == [1.0, 2.0]
        plain = rules.recode_period(df, spark.createDataFrame(order, schema).drop("rank")).collect()
        assert [r.period for r in plain] == [1.0, 1.0]


def test_cut_at_period(spark):
    cuts = rule_table(spark, study.PERIOD_CUTS, "id string, period double, keep string, shift int")
    d = [dt.date(2023, 9, n) for n in range(1, 8)]
    df = spark.createDataFrame(
        [("ACA", d[0], 6.0), ("ACA", d[1], 8.0), ("ACA", d[2], None), ("ACA", d[3], None)]
        + [("AC2", d[0], 2.0), ("AC2", d[1], 2.0), ("AC2", d[2], 4.0)]
        + [("ACB", d[0], 2.0), ("90E", d[0], None)],
        "id string, date date, period double",
    )
    got = sorted((r.id, r.date.day) for r in rules.cut_at_period(df, cuts).collect())
    assert got == [("90E", 1), ("AC2", 2), ("AC2", 3), ("ACA", 1), ("ACA", 2), ("ACA", 3)]


def test_all_rules_of_a_tag_hold(spark):
    d = [dt.date(2023, 9, n) for n in range(1, 8)]
    df = spark.createDataFrame([("a", x, 2.0 * (i // 2)) for i, x in enumerate(d)], "id string, date date, period double")
    two = rule_table(spark, [("a", 2.0, "until", 0), ("a", 0.0, "until", 3)], "id string, period double, keep string, shift int")
    assert sorted(r.date.day for r in rules.cut_at_period(df, two).collect()) == [1, 2, 3, 4]
    none = two.unionByName(rule_table(spark, [("a", 9.0, "from", 0)], "id string, period double, keep string, shift int"))
    assert rules.cut_at_period(df, none).count() == 0
    cuts = rule_table(spark, [("a", "2023-09-03"), ("a", "2023-09-05"), ("a", None)], "id string, before date")
    assert sorted(r.date.day for r in rules.cut(df, cuts).collect()) == [1, 2]
    windows = spark.createDataFrame(
        [("a", d[0], d[4]), ("a", d[2], None)], "id string, crop_start date, crop_end date"
    )
    assert sorted(r.date.day for r in rules.crop(df, windows).collect()) == [3, 4]


def naive(items, window=5, gap=5, least=2, min_hours=6.0, spring=150):
    items = sorted(items)
    candidate, last, tagged = 0, None, []
    for at, hours in items:
        day = at.date()
        candidate += last is None or (day - last).days >= gap
        tagged.append([day, hours, candidate])
        last = day
    valid = {}
    for c in {t[2] for t in tagged}:
        own = [t for t in tagged if t[2] == c]
        dense = any(sum(abs((o[0] - t[0]).days) <= window for o in own) >= least for t in own)
        valid[c] = dense and sum(t[1] for t in own) > min_hours
    label = [t[2] if valid[t[2]] else None for t in tagged]
    early = [i for i, t in enumerate(tagged) if t[0].timetuple().tm_yday <= spring and label[i] is not None]
    if early:
        final = label[early[-1]]
        start = min(t[0] for t, x in zip(tagged, label) if x == final)
        for i in early:
            if tagged[i][0] < start:
                label[i] = -1
    order = []
    for x in label:
        if x is not None and x not in order:
            order.append(x)
    return [None if x is None else (order.index(x) + 1) * 2.0 for x in label]


def test_random_tags_match_the_loop(spark):
    rng = random.Random(11)
    data = {}
    for tag in range(60):
        at = dt.datetime(2023, 7, 1, 20)
        items = []
        for _ in range(rng.randint(1, 25)):
            at += dt.timedelta(days=rng.choice([0, 1, 1, 2, 4, 5, 6, 30]), minutes=rng.randint(1, 50))
            items.append((at, rng.choice([0.5, 2.25, 4.0])))
        data[str(tag)] = items
    flat = [(tag, i, at, h) for tag, items in data.items() for i, (at, h) in enumerate(items)]
    rng.shuffle(flat)
    out = flight_periods(spark.createDataFrame(flat, SCHEMA), min_flights=2, min_hours=6.0)
    got = {}
    for r in out.orderBy("id", "takeoff_time", "flight_group").collect():
        got.setdefault(r.id, []).append(r.period)
    assert got == {tag: naive(items) for tag, items in data.items()}
