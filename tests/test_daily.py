"""Days and their periods on hand-made tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from featherline import study
from featherline.operators import crossing, daily, rules
from featherline.operators.daily import quiet_hours, summarise_hours
from featherline.plans.daily_plan import summarise_days
from featherline.sources.inline import rule_table

NOON = dt.datetime(2023, 9, 1, 12)
HOUR = dt.timedelta(hours=1)
HOURS = (
    "id string, date timestamp, acc4 int, acc5 int, act_score double, is_active boolean, flight_min int, "
    "lat double, lon double, stap_id double, sunrise timestamp, sunset timestamp"
)


def day(spark, *items):
    """Hours from noon on: (acc4, acc5, score, active, lat, stap)."""
    data = [
        ("a", NOON + i * HOUR, a4, a5, s, act, 30, lat, 10.0, stap, None, None)
        for i, (a4, a5, s, act, lat, stap) in enumerate(items)
    ]
    return summarise_hours(quiet_hours(spark.createDataFrame(data, HOURS))).first()


def test_score_next_to_a_flight_is_taken_off(spark):
    r = day(
        spark,
        (1, 0, 10.0, False, 50.0, 1.0),
        (0, 1, 20.0, True, 49.0, 1.5),
        (0, 1, 9.0, False, 48.0, 2.0),
        (1, 0, 6.0, False, 46.0, 2.0),
    )
    assert r.total_flight_min == 30 and r.flight_rows == 1 and r.daytime_rows == 3
    assert r.daytime_act_score == 25.0
    assert r.daytime_act_score_no_flight == (10 - 4) + (9 - 5) + 6
    assert r.daytime_activity_percentage == pytest.approx(16 / 90 * 100)
    assert r.lat == 48.0 and r.stopover_id == 1.0


def test_day_without_quiet_hour_has_no_position_and_no_percentage(spark):
    r = day(spark, (0, 1, 10.0, True, 50.0, 1.5))
    assert (r.lat, r.stopover_id, r.daytime_activity_percentage) == (None, None, None)
    assert r.daytime_act_score == 0.0 and r.daytime_act_score_no_flight == 0.0


def test_unknown_activity_spoils_only_the_strict_sum(spark):
    r = day(spark, (0, 0, 3.0, False, 50.0, 1.0), (0, 0, 4.0, None, 40.0, 1.0))
    assert r.daytime_rows == 1 and r.daytime_act_score == 3.0 and r.lat == 50.0
    assert r.daytime_act_score_no_flight is None and r.daytime_activity_percentage is None


def test_fallback_daylight_is_inclusive(spark):
    data = [
        ("a", dt.datetime(2023, 9, 1, h), 0, 0, 1.0, False, 0, None, None, None, None, None)
        for h in (3, 4, 16, 17)
    ]
    r = summarise_hours(quiet_hours(spark.createDataFrame(data, HOURS))).first()
    assert r.daytime_rows == 2 and r.lat is None


def test_duplicate_path_rows_are_refused(spark):
    path = spark.createDataFrame([("a", NOON), ("a", NOON)], "id string, date timestamp")
    with pytest.raises(ValueError):
        daily.assert_unique(path, ["id", "date"])
    assert daily.assert_unique(path.distinct(), ["id", "date"]).count() == 1


def test_calendar_keeps_days_before_its_start(spark, rows):
    by_day = spark.createDataFrame(
        [("a", dt.date(2023, 6, 1), 2.0), ("a", dt.date(2023, 6, 14), 4.0), ("b", dt.date(2023, 5, 1), 2.0)],
        "id string, date date, period double",
    )
    got = rows(daily.complete_days(by_day), "id", "date", "period")
    assert [(i, d.month, d.day, p) for i, d, p in got] == [
        ("a", 6, 1, 2.0),
        ("a", 6, 12, None),
        ("a", 6, 13, None),
        ("a", 6, 14, 4.0),
        ("b", 5, 1, 2.0),
    ]


def test_calendar_is_one_pass_with_other_columns_and_missing_days(spark, rows):
    by_day = spark.createDataFrame(
        [("a", dt.date(2023, 6, 10), 2.0, "x"), ("a", dt.date(2023, 6, 11), 2.0, "y"), ("a", dt.date(2023, 6, 15), 4.0, "z"),
         ("b", dt.date(2023, 6, 14), 2.0, "x"), ("c", None, 6.0, "n"), ("c", dt.date(2023, 1, 1), 2.0, "m")],
        "id string, date date, period double, note string",
    )
    out = daily.complete_days(by_day)
    assert "Join" not in out._jdf.queryExecution().toString()
    got = [(i, d and (d.month, d.day), p, n) for i, d, p, n in rows(out, "id", "date", "period", "note")]
    assert sorted(got, key=str) == sorted(
        [("a", (6, 10), 2.0, "x"), ("a", (6, 11), 2.0, "y"), ("a", (6, 12), None, None), ("a", (6, 13), None, None),
         ("a", (6, 14), None, None), ("a", (6, 15), 4.0, "z"), ("b", (6, 12), None, None), ("b", (6, 13), None, None),
         ("b", (6, 14), 2.0, "x"), ("c", (1, 1), 2.0, "m"), ("c", None, 6.0, "n")],
        key=str,
    )


def test_first_flight_of_a_day_gives_its_period(spark):
    flights = spark.createDataFrame(
        [("a", 2, NOON + HOUR, 4.0), ("a", 1, NOON, None)],
        "id string, flight_group int, takeoff_time timestamp, period double",
    )
    assert [r.period for r in daily.periods_by_day(flights).collect()] == [None]


def days(spark, periods, tag="a"):
    data = [(tag, dt.date(2023, 9, 1) + dt.timedelta(days=i), p) for i, p in enumerate(periods)]
    return spark.createDataFrame(data, "id string, date date, period double")


def filled(df):
    return [r.period for r in df.orderBy("id", "date").collect()]


def test_fill_in_runs_and_between_them(spark):
    known = days(spark, [None, 2.0, None, 2.0, None, 4.0, None])
    assert filled(daily.fill_same_run(known)) == [None, 2.0, 2.0, 2.0, None, 4.0, None]
    full = daily.fill_stationary(daily.fill_same_run(known))
    assert filled(full) == [1.0, 2.0, 2.0, 2.0, 3.0, 4.0, 5.0]


def test_both_forms_of_the_run_fill_agree(spark):
    rng = random.Random(5)
    parts = None
    for tag in range(30):
        part = days(spark, [rng.choice([None, None, 2.0, 4.0]) for _ in range(25)], str(tag))
        parts = part if parts is None else parts.unionAll(part)
    a, b = daily.fill_same_run(parts), daily.fill_runs_by_join(parts).select("id", "date", "period")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_first_migration_day_counts_for_the_stopover(spark):
    got = daily.period_activity(days(spark, [1.0, 2.0, 2.0, 3.0, 4.0])).orderBy("date").collect()
    assert [r.period_activity for r in got] == [1.0, 1.0, 2.0, 3.0, 3.0]
    got = daily.period_activity(days(spark, [2.0, 2.0, 3.0])).orderBy("date").collect()
    assert [r.period_activity for r in got] == [None, 2.0, 3.0]


def test_recaptured_days_drop_also_when_the_period_is_unknown(spark):
    df = spark.createDataFrame(
        [(13.0, 0.0), (13.0, 1.0), (None, 0.0), (None, 1.0), (4.0, 0.0)],
        "period double, daytime_act_score double",
    )
    assert rules.drop_recaptured(df).count() == 3


def test_seasons(spark):
    df = rules.with_season(days(spark, [1.0, 2.0, 8.0, 9.0, 10.0, 12.0, 13.0, 14.0, None]), study.DAILY_SEASONS)
    assert [r.season for r in df.orderBy("date").collect()] == [
        "Breeding", "Autumn", "Autumn", "Wintering", "Spring", "Spring", "Breeding", None, None,
    ]


def test_seasons_sort_in_calendar_order(spark):
    df = spark.createDataFrame([("Spring",), ("Breeding",), ("Wintering",), ("Autumn",)], "season string")
    got = df.orderBy(rules.season_rank(study.DAILY_SEASONS)).collect()
    assert [r.season for r in got] == ["Breeding", "Autumn", "Wintering", "Spring"]


@pytest.mark.parametrize("max_rows", [20, 7])
def test_daily_rows_of_a_split_tag(spark, max_rows):
    rng = random.Random(9)
    sun = NOON.replace(hour=5), NOON.replace(hour=19)
    data = [
        (tag, NOON + i * HOUR, rng.randint(0, 2), rng.randint(0, 2), float(rng.randint(0, 30)),
         rng.choice([True, False, False, None]), 30, rng.random() * 50, 1.0, rng.choice([1.0, 1.5, 2.0]), *sun)
        for tag, n in (("hot", 150), ("cold", 10)) for i in range(n)
    ]
    df = spark.createDataFrame(data, HOURS)
    whole = summarise_days(df).drop("lat")
    split = summarise_days(df, max_rows=max_rows).drop("lat")
    assert whole.exceptAll(split).isEmpty() and split.exceptAll(whole).isEmpty()


def test_season_is_carried_over_flights_outside_periods(spark):
    flights = rules.with_season(days(spark, [None, 2.0, None, 10.0, None]), study.FLIGHT_SEASONS)
    got = daily.fill_season(flights).orderBy("date").collect()
    assert [r.season for r in got] == [None, "Autumn", "Autumn", "Spring", "Spring"]


def test_daily_cuts(spark):
    cuts = rule_table(spark, list(study.DAILY_CUTS.items()), "id string, before date")
    df = spark.createDataFrame(
        [("ACA", dt.date(2024, 2, 28)), ("ACA", dt.date(2024, 2, 29)), ("90E", dt.date(2025, 1, 1))],
        "id string, date date",
    )
    assert sorted(r.id for r in rules.cut(df, cuts).collect()) == ["90E", "ACA"]


def test_latitude_bins_round_half_to_even(spark, rows):
    df = spark.createDataFrame([(4.5, 1.0), (7.5, 2.0), (1.5, 3.0)], "lat double, mean_activity double")
    assert rows(crossing.lat_bins(df), "lat_bin", "mean_across") == [(0.0, 3.0), (6.0, 1.5)]


def test_standard_error_divides_by_all_rows(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 1.0, 4.0), ("a", 1.0, None), ("b", 1.0, 5.0)],
        "id string, lat double, daytime_activity_percentage double",
    )
    got = {r.id: r for r in crossing.activity_by_lat(df).collect()}
    assert got["a"].se == pytest.approx(2**0.5 / 3**0.5) and got["a"].mean_activity == 3.0
    assert got["b"].se is None


def test_crossing_needs_both_ends(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, 40.0), ("a", 2, 36.0), ("a", 3, 17.0), ("a", 4, 30.0), ("b", 1, 30.0)],
        "id string, date int, lat double",
    )
    assert rows(crossing.autumn_crossing(df), "id", "xmin", "xmax") == [("a", 2, 3)]


def test_unknown_landings_count_as_one_more_tag(spark):
    df = spark.createDataFrame(
        [("a", "Autumn", 5.0, 1.0), ("a", "Autumn", 15.0, 2.0), ("b", "Autumn", -5.0, 3.0), ("c", "Autumn", None, 4.0)],
        "id string, season string, minutes_after_sunrise double, duration_hours double",
    ).withColumn("after_sunrise", F.col("minutes_after_sunrise") > 0)
    r = crossing.season_flight_stats(df).first()
    assert (r.n_flights, r.n_after_sunrise, r.n_ids_known, r.n_ids) == (4, 2, 1, 2)
    assert (r.mean_minutes_after, r.median_minutes_after, r.median_flight_duration) == (10.0, 10.0, 1.5)


def test_band_edges_belong_to_the_barrier(spark):
    df = spark.createDataFrame(
        [(18.0, 1.0), (37.0, 1.0), (17.9, 1.0), (None, 1.0), (20.0, None)],
        "lat double, daytime_activity_percentage double",
    )
    got = sorted((r.lat, r.barrier) for r in crossing.with_barrier(df, 18, 37).collect())
    assert got == [(17.9, crossing.OUTSIDE), (18.0, crossing.INSIDE), (37.0, crossing.INSIDE)]


def test_crop_to_period_and_nights(spark):
    data = []
    for i in range(10):
        d = dt.datetime(2023, 9, 1) + dt.timedelta(days=i)
        has_sun = i != 5
        data.append(
            ("a", d, d.date(), 4.0 if i in (4, 5) else 3.0, d + 5 * HOUR if has_sun else None, d + 18 * HOUR)
        )
    data.append(("b", NOON, NOON.date(), 3.0, None, None))
    hourly = spark.createDataFrame(
        data, "id string, date timestamp, date_day date, period double, sunrise timestamp, sunset timestamp"
    )
    cropped = crossing.crop_to_period(hourly, 4)
    assert [r.date_day.day for r in cropped.orderBy("date").collect()] == [4, 5, 6, 7, 8]
    nights = crossing.night_intervals(cropped).orderBy("date_day").collect()
    assert [(r.date_day.day, r.next_sunrise.day) for r in nights] == [(4, 5), (5, 7), (7, 8)]
    gaps = crossing.night_intervals(cropped, keep_gaps=True).orderBy("date_day").collect()
    assert [(r.date_day.day, r.next_sunrise.day) for r in gaps] == [(4, 5), (6, 7), (7, 8)]
