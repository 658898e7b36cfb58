"""Flight rules on hand-made hours and against a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from featherline.operators import flights, rules
from featherline.plans.flight_plan import hourly_flights
from featherline.sources.inline import rule_table

NOON = dt.datetime(2023, 9, 1, 12)
HOUR = dt.timedelta(hours=1)
SCHEMA = "id string, date timestamp, acc3 int, acc4 int, acc5 int"


def hours(spark, sums, start=NOON, tag="a"):
    """Rows with `acc5` equal to the given number; None is unknown."""
    data = [(tag, start + i * HOUR, 0, 0, s) for i, s in enumerate(sums)]
    return spark.createDataFrame(data, SCHEMA)


def flown(df):
    return [
        (r.flight_group, r.takeoff_time, r.landing_time)
        for r in flights.flights(hourly_flights(df)).orderBy("id", "flight_group").collect()
    ]


def test_one_hour_flight_lands_with_the_next_row(spark):
    # 3 samples: up 30 minutes before the hour's end; the next, quiet hour has 1
    # sample, so its own landing is 50 minutes before its end.
    assert flown(hours(spark, [0, 3, 1, 0])) == [
        (1, NOON + HOUR - dt.timedelta(minutes=30), NOON + 2 * HOUR - dt.timedelta(minutes=50))
    ]


def test_full_edge_hours_take_their_neighbours(spark):
    assert flown(hours(spark, [2, 5, 6, 1])) == [
        (
            1,
            NOON + HOUR - dt.timedelta(minutes=50 + 20),
            NOON + 2 * HOUR + dt.timedelta(minutes=10),
        )
    ]


def test_unknown_previous_hour_leaves_takeoff_unknown(spark):
    (flight,) = flown(hours(spark, [5, 6, 0]))
    assert flight[1] is None and flight[2] is not None


def test_runs_are_numbered_and_unknown_hours_use_one_number(spark):
    df = hourly_flights(hours(spark, [3, 0, 3, None, 3, None, 3]))
    groups = [r.flight_group for r in df.orderBy("date").collect()]
    assert groups == [1, None, 2, None, 4, None, 5]


@pytest.mark.parametrize(
    "day, active", [("06-14", True), ("06-15", False), ("08-01", False), ("08-02", True)]
)
def test_mask_is_inclusive(spark, day, active):
    start = dt.datetime.fromisoformat(f"2023-{day}T12:00:00")
    assert hourly_flights(hours(spark, [4], start)).first().is_active is active


def test_flight_needs_a_high_class(spark):
    df = spark.createDataFrame([("a", NOON, 4, 0, 0), ("a", NOON + HOUR, 2, 1, 0)], SCHEMA)
    got = hourly_flights(df).orderBy("date").collect()
    assert [r.is_active for r in got] == [False, True]
    assert [r.flight_min for r in got] == [0, 30]


def test_cut_comes_before_the_look_ahead(spark):
    cuts = rule_table(spark, [("a", "2023-09-02")], "id string, before date")
    start = dt.datetime(2023, 9, 1, 22)
    got = hourly_flights(hours(spark, [0, 3, 0, 0], start), cuts=cuts)
    last = got.orderBy("date").collect()[-1]
    assert got.count() == 2 and last.next_landing is None
    assert rules.cut(hours(spark, [1], start, tag="b"), cuts).count() == 1


def naive(items):
    """The rules row by row for one tag."""
    n = len(items)
    total = [a3 + a4 + a5 for _, a3, a4, a5 in items]
    high = [a4 > 0 or a5 > 0 for _, a3, a4, a5 in items]
    masked = [(6, 15) <= (d.month, d.day) <= (8, 1) for d, *_ in items]
    active = [t >= 3 and h and not m for t, h, m in zip(total, high, masked)]
    idle = [i for i in range(n) if not active[i]]
    up, down = [], []
    for i, (date, *_rest) in enumerate(items):
        own = dt.timedelta(minutes=10 * total[i] if high[i] and not masked[i] else 0)
        first = (i == 0 or not active[i - 1]) if active[i] else i == idle[0]
        last = (i == n - 1 or not active[i + 1]) if active[i] else i == idle[-1]
        takeoff, landing = date - own, date - HOUR + own
        if first and total[i] >= 5:
            takeoff = None if i == 0 else date - own - dt.timedelta(minutes=10 * total[i - 1])
        if last and total[i] >= 5:
            landing = None if i == n - 1 else date + dt.timedelta(minutes=10 * total[i + 1])
        up.append(takeoff)
        down.append(landing)
    out, i = [], 0
    while i < n:
        if not active[i]:
            i += 1
            continue
        j = i
        while j + 1 < n and active[j + 1]:
            j += 1
        ups, downs = up[i : j + 1], down[i : j + 1]
        landing = (down[i + 1] if i + 1 < n else None) if i == j else None if None in downs else max(downs)
        out.append((len(out) + 1, None if None in ups else min(ups), landing))
        i = j + 1
    return out


@pytest.mark.parametrize("max_rows", [None, 25])
def test_random_tags_match_the_loop(spark, max_rows):
    rng = random.Random(3)
    data = {}
    for tag in range(12):
        start = dt.datetime(2023, rng.choice([5, 6, 7, 9]), rng.randint(1, 28))
        n = rng.randint(1, 120)
        data[str(tag)] = [
            (start + i * HOUR, rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 2)) for i in range(n)
        ]
    flat = [(tag, *item) for tag, items in data.items() for item in items]
    rng.shuffle(flat)
    table = hourly_flights(spark.createDataFrame(flat, SCHEMA), max_rows=max_rows)
    got = {}
    for r in flights.flights(table).orderBy("id", "flight_group").collect():
        got.setdefault(r.id, []).append((r.flight_group, r.takeoff_time, r.landing_time))
    assert got == {tag: naive(items) for tag, items in data.items() if naive(items)}


def test_short_flights_and_flights_without_pressure_drop_are_left_out(spark):
    df = hours(spark, [0, 3, 3, 3, 0, 3, 3, 3, 0, 3, 0])
    press = spark.createDataFrame(
        [("a", NOON + i * HOUR, 5.0, p) for i, p in enumerate([1000.0] * 2 + [900.0] * 2 + [1000.0] * 7)],
        "id string, date timestamp, temp_c double, pressure_hpa double",
    )
    table = hourly_flights(df, pressure=press)
    kept = flights.migratory_only(flights.flights(table), table).collect()
    assert [(r.flight_group, r.pressure_change) for r in kept] == [(1, -100.0)]


def test_pressure_of_an_hour_with_several_samples(spark):
    hour = dt.datetime(2024, 1, 1, 5)
    hourly = spark.createDataFrame([("a", hour), ("a", hour + dt.timedelta(hours=1)), ("b", hour)], "id string, date timestamp")
    samples = [("a", hour + dt.timedelta(minutes=m), t, p) for m, t, p in ((30, 2.0, 990.0), (10, 1.0, 980.0), (10, 1.0, 980.0), (59, None, None))]
    pressure = spark.createDataFrame(samples, "id string, date timestamp, temp_c double, pressure_hpa double")
    got = sorted(tuple(r) for r in flights.attach_pressure(hourly, pressure).select("id", "date", "temp_c", "pressure_hpa").collect())
    assert got == [("a", hour, 1.0, 980.0), ("a", hour + dt.timedelta(hours=1), None, None), ("b", hour, None, None)]
