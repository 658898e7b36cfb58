"""Days, periods of days, barriers and latitude."""

from __future__ import annotations

from pyspark.sql import functions as F

from featherline.operators import activity, crossing, daily, mixed_model, quantiles
from featherline.session import keep
from workload import adaptors, steps  # noqa: F401
from workload.adaptors import rounded, table
from workload.registry import query, step

BAND = (18.0, 37.0)


@query(
    "hours_with_position",
    "SELECT id, date, flight_group, lat, lon, stap_id, sunrise, sunset FROM merged_rows",
)
def hours_with_position(spark, sf_dir):
    path = daily.assert_unique(adaptors.path(spark, sf_dir), ["id", "date"])
    return daily.join_path(adaptors.flight_rows(spark, sf_dir), path).select(
        "id", "date", "flight_group", "lat", "lon", "stap_id", "sunrise", "sunset"
    )


@query(
    "suspicious_hours",
    """
SELECT id, date, acc_sum FROM merged_rows
WHERE NOT is_active AND NOT masked AND date BETWEEN sunrise AND sunset AND acc_high
""",
)
def suspicious_hours(spark, sf_dir):
    return activity.suspicious_hours(adaptors.merged(spark, sf_dir)).select("id", "date", "acc_sum")


DAY_COLUMNS = [
    "id",
    "date",
    "total_flight_min",
    "flight_rows",
    "daytime_rows",
    "daytime_act_score",
    "daytime_act_score_no_flight",
    "stopover_id",
]


@query(
    "daily_summary",
    """
SELECT id, date, total_flight_min, flight_rows, daytime_rows, daytime_act_score, daytime_act_score_no_flight,
       stopover_id, round(lat, 6) AS lat, round(lon, 6) AS lon,
       round(daytime_activity_percentage, 6) + 0.0::DOUBLE AS daytime_activity_percentage
FROM day_row
""",
)
def daily_summary(spark, sf_dir):
    return daily.summarise_hours(adaptors.merged(spark, sf_dir)).select(
        *DAY_COLUMNS,
        rounded("lat").alias("lat"),
        rounded("lon").alias("lon"),
        rounded("daytime_activity_percentage").alias("daytime_activity_percentage"),
    )


@query("first_flight_per_day", "SELECT id, date, flight_group, period FROM ("
    "SELECT *, row_number() OVER (PARTITION BY id, date ORDER BY takeoff_time, flight_group) AS rn "
    "FROM event_period WHERE date IS NOT NULL) WHERE rn = 1")
def first_flight_per_day(spark, sf_dir):
    known = adaptors.event_periods(spark, sf_dir).where(F.col("date").isNotNull())
    return daily.first_per_day(known).select("id", "date", "flight_group", "period")


@query("period_calendar", "SELECT id, date, period FROM calendar")
def period_calendar(spark, sf_dir):
    by_day = daily.periods_by_day(adaptors.event_periods(spark, sf_dir))
    return daily.complete_days(by_day, *adaptors.CALENDAR_START).select("id", "date", "period")


def _known_days(spark, sf_dir):
    hours = adaptors.kept_hours(spark, sf_dir)
    by_day = daily.periods_by_day(adaptors.periods_of(hours))
    calendar = daily.complete_days(by_day, *adaptors.CALENDAR_START)
    return daily.add_period(daily.summarise_hours(hours), calendar)


@query("days_filled_in_runs", "SELECT id, date, day_of_year, filled AS period FROM day_filled")
def days_filled_in_runs(spark, sf_dir):
    return daily.fill_same_run(_known_days(spark, sf_dir)).select(
        "id", "date", "day_of_year", "period"
    )


@query("days_filled_by_join", "SELECT id, date, day_of_year, filled AS period FROM day_filled")
def days_filled_by_join(spark, sf_dir):
    return daily.fill_runs_by_join(_known_days(spark, sf_dir)).select(
        "id", "date", "day_of_year", "period"
    )


@query(
    "days_of_runs",
    """
SELECT id, known AS period, unnest(generate_series(start::TIMESTAMP, stop::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
FROM day_run
""",
)
def days_of_runs(spark, sf_dir):
    return daily.run_days(_known_days(spark, sf_dir))


@query("stationary_days", "SELECT id, date, period FROM day_stationary")
def stationary_days(spark, sf_dir):
    return daily.fill_stationary(daily.fill_same_run(_known_days(spark, sf_dir))).select(
        "id", "date", "period"
    )


@query(
    "daily_periods",
    "SELECT id, date, day_of_year, period, period_activity, season FROM day_period",
)
def daily_periods(spark, sf_dir):
    return adaptors.days_with_periods(spark, sf_dir).select(
        "id", "date", "day_of_year", "period", "period_activity", "season"
    )


@query(
    "hours_with_period",
    "SELECT id, date, date_day, period, season, round(act_score * 100 / 30, 6) AS activity_percentage FROM hour_period",
)
def hours_with_period(spark, sf_dir):
    df = activity.activity_percentage(adaptors.merged_with_period(spark, sf_dir))
    return df.select(
        "id",
        "date",
        "date_day",
        "period",
        "season",
        rounded("activity_percentage").alias("activity_percentage"),
    )


@query("sunrise_by_day", "SELECT id, yday, sunrise, latitude FROM sunrise_day")
def sunrise_by_day(spark, sf_dir):
    rows = daily.join_path(adaptors.hourly(spark, sf_dir), adaptors.path(spark, sf_dir))
    return daily.sunrise_by_day(rows)


def _late_flights(spark, sf_dir):
    hours = adaptors.kept_hours(spark, sf_dir)
    flights = adaptors.seasonal(adaptors.periods_of(hours))
    return daily.flights_vs_sunrise(flights, daily.sunrise_by_day(hours))


@query(
    "flight_seasons",
    "SELECT id, flight_group, period, season FROM season_flight",
)
def flight_seasons(spark, sf_dir):
    return adaptors.seasonal(adaptors.event_periods(spark, sf_dir)).select(
        "id", "flight_group", "period", "season"
    )


@query(
    "flights_against_sunrise",
    """
SELECT id, flight_group, season, sunrise, latitude, round(minutes_after_sunrise, 6) AS minutes_after_sunrise,
       after_sunrise
FROM late_flight
""",
)
def flights_against_sunrise(spark, sf_dir):
    return _late_flights(spark, sf_dir).select(
        "id",
        "flight_group",
        "season",
        "sunrise",
        "latitude",
        rounded("minutes_after_sunrise").alias("minutes_after_sunrise"),
        "after_sunrise",
    )


# The given flights all land before the next morning, so the threshold is moved
# to midnight less eight hours for the report.
step(
    "shifted_flight",
    """
SELECT * REPLACE (minutes_after_sunrise + 1440 AS minutes_after_sunrise,
                  minutes_after_sunrise + 1440 > 0 AS after_sunrise)
FROM late_flight
""",
)


@query(
    "season_flight_stats",
    """
SELECT season, count(*) AS n_flights, count(*) FILTER (after_sunrise) AS n_after_sunrise,
       count(DISTINCT id) FILTER (after_sunrise) AS n_ids_known,
       count(DISTINCT id) FILTER (after_sunrise)
         + max(CASE WHEN after_sunrise IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_ids,
       round(avg(minutes_after_sunrise) FILTER (after_sunrise), 6) AS mean_minutes_after,
       round(quantile_cont(minutes_after_sunrise, 0.5) FILTER (after_sunrise), 6) AS median_minutes_after,
       round(min(minutes_after_sunrise) FILTER (after_sunrise), 6) AS min_minutes_after,
       round(max(minutes_after_sunrise) FILTER (after_sunrise), 6) AS max_minutes_after,
       round(quantile_cont(duration_hours, 0.5) FILTER (after_sunrise), 6) AS median_flight_duration
FROM shifted_flight GROUP BY season
""",
)
def season_flight_stats(spark, sf_dir):
    late = F.col("minutes_after_sunrise") + 1440
    flights = _late_flights(spark, sf_dir).withColumns(
        {"minutes_after_sunrise": late, "after_sunrise": late > 0}
    )
    stats = crossing.season_flight_stats(flights)
    doubles = [c for c, t in stats.dtypes if t == "double"]
    return stats.withColumns({c: rounded(c) for c in doubles})


@query(
    "barrier_days",
    """
SELECT id, date, round(daytime_activity_percentage, 6) + 0.0::DOUBLE AS activity,
       CASE WHEN lat >= 18 AND lat <= 37 THEN 'Inside barrier' ELSE 'Outside barrier' END AS barrier
FROM day_period WHERE season = 'Autumn' AND lat IS NOT NULL AND daytime_activity_percentage IS NOT NULL
""",
)
def barrier_days(spark, sf_dir):
    autumn = adaptors.days_with_periods(spark, sf_dir).where(F.col("season") == "Autumn")
    return crossing.with_barrier(autumn, *BAND).select(
        "id", "date", rounded("daytime_activity_percentage").alias("activity"), "barrier"
    )


step(
    "bird_period",
    """
SELECT id, period_activity, count(DISTINCT date) AS n_days_observed,
       avg(daytime_activity_percentage) AS mean_daytime_activity_id,
       count(*) FILTER (daytime_activity_percentage <= 2) AS n_days_low,
       count(*) FILTER (daytime_activity_percentage = 0) AS n_days_zero,
       count(DISTINCT date) FILTER (lat BETWEEN 18 AND 37) AS n_days_inside_barrier,
       count(*) FILTER (daytime_activity_percentage = 0 AND lat BETWEEN 18 AND 37) AS n_days_zero_barrier,
       count(*) FILTER (daytime_activity_percentage <= 2 AND lat BETWEEN 18 AND 37) AS n_days_low_barrier,
       count(*) FILTER (daytime_activity_percentage <= 2)
         - count(*) FILTER (daytime_activity_percentage <= 2 AND lat BETWEEN 18 AND 37) AS n_days_low_outside
FROM day_period WHERE lat IS NOT NULL GROUP BY id, period_activity
""",
)


@query(
    "period_stats_by_tag",
    """
SELECT * REPLACE (round(mean_daytime_activity_id, 6) + 0.0::DOUBLE AS mean_daytime_activity_id) FROM bird_period
""",
)
def period_stats_by_tag(spark, sf_dir):
    stats = crossing.period_stats_by_id(adaptors.days_with_periods(spark, sf_dir), *BAND)
    return stats.withColumn("mean_daytime_activity_id", rounded("mean_daytime_activity_id"))


MEASURES = {
    "daytime_activity": "mean_daytime_activity_id",
    "days_observed": "n_days_observed",
    "days_low_activity": "n_days_low",
    "days_zero_activity": "n_days_zero",
    "days_inside_barrier": "n_days_inside_barrier",
    "days_zero_activity_barrier": "n_days_zero_barrier",
    "days_low_activity_barrier": "n_days_low_barrier",
    "days_low_activity_outside": "n_days_low_outside",
}


@query(
    "period_stats",
    "SELECT period_activity, count(DISTINCT id) AS n_ids, "
    + ", ".join(
        f"round(avg({c}), 6) + 0.0::DOUBLE AS mean_{m}, round(stddev_samp({c}), 6) + 0.0::DOUBLE AS sd_{m}"
        for m, c in MEASURES.items()
    )
    + ", quantile_cont(n_days_inside_barrier, 0.5) AS median_days_inside_barrier,"
    " round(avg(n_days_low) / avg(n_days_observed), 6) AS proportion_days_low_activity"
    " FROM bird_period GROUP BY period_activity",
)
def period_stats(spark, sf_dir):
    by_id = crossing.period_stats_by_id(adaptors.days_with_periods(spark, sf_dir), *BAND)
    stats = crossing.period_stats(by_id)
    doubles = [c for c, t in stats.dtypes if t == "double" and c[:2] != "pe" and c[:3] != "med"]
    return stats.withColumns({c: rounded(c) for c in doubles})


step(
    "lat_profile",
    """
SELECT id, lat, count(*) AS n_rows, avg(daytime_activity_percentage) AS mean_activity,
       stddev_samp(daytime_activity_percentage) / sqrt(count(*)) AS se
FROM day_period WHERE day_of_year BETWEEN 5 AND 28 AND id <> 7 GROUP BY id, lat
""",
)


def _profile_days(spark, sf_dir):
    from featherline.operators.rules import keep_days

    return keep_days(adaptors.days_with_periods(spark, sf_dir), 5, 28, exclude=[7])


@query(
    "activity_by_latitude",
    """
SELECT id, round(lat, 6) AS lat, n_rows, 1::BIGINT AS n_birds, round(mean_activity, 6) + 0.0::DOUBLE AS mean_activity, round(se, 6) AS se
FROM lat_profile
""",
)
def activity_by_latitude(spark, sf_dir):
    return crossing.activity_by_lat(_profile_days(spark, sf_dir)).select(
        "id",
        rounded("lat").alias("lat"),
        "n_rows",
        "n_birds",
        rounded("mean_activity").alias("mean_activity"),
        rounded("se").alias("se"),
    )


@query(
    "activity_by_latitude_and_stopover",
    """
SELECT DISTINCT p.id, round(p.lat, 6) AS lat, p.n_rows, round(p.mean_activity, 6) + 0.0::DOUBLE AS mean_activity,
       round(p.se, 6) AS se, d.stopover_id
FROM lat_profile p JOIN day_period d
ON p.id = d.id AND p.lat IS NOT DISTINCT FROM d.lat AND d.day_of_year BETWEEN 5 AND 28
""",
)
def activity_by_latitude_and_stopover(spark, sf_dir):
    return crossing.activity_by_lat(_profile_days(spark, sf_dir), per_stopover=True).select(
        "id",
        rounded("lat").alias("lat"),
        "n_rows",
        rounded("mean_activity").alias("mean_activity"),
        rounded("se").alias("se"),
        "stopover_id",
    )


@query(
    "activity_by_latitude_bin",
    """
SELECT round_even(lat / 3, 0) * 3 + 0.0::DOUBLE AS lat_bin, round(avg(mean_activity), 6) + 0.0::DOUBLE AS mean_across,
       round(stddev_samp(mean_activity) / sqrt(count(*)), 6) AS se_across
FROM lat_profile GROUP BY ALL
""",
)
def activity_by_latitude_bin(spark, sf_dir):
    return crossing.lat_bins(crossing.activity_by_lat(_profile_days(spark, sf_dir))).select(
        (F.col("lat_bin") + 0.0).alias("lat_bin"),
        rounded("mean_across").alias("mean_across"),
        rounded("se_across").alias("se_across"),
    )


@query(
    "activity_by_latitude_bin_and_stopover",
    """
SELECT round_even(lat / 3, 0) * 3 + 0.0::DOUBLE AS lat_bin, round(avg(mean_activity), 6) + 0.0::DOUBLE AS mean_across,
       round(stddev_samp(mean_activity) / sqrt(count(*)), 6) AS se_across
FROM (SELECT DISTINCT p.id, p.lat, p.mean_activity, d.stopover_id
      FROM lat_profile p JOIN day_period d
      ON p.id = d.id AND p.lat IS NOT DISTINCT FROM d.lat AND d.day_of_year BETWEEN 5 AND 28)
GROUP BY ALL
""",
)
def activity_by_latitude_bin_and_stopover(spark, sf_dir):
    """The autumn form: a tag counts once for each stopover at a latitude."""
    rows = crossing.activity_by_lat(_profile_days(spark, sf_dir), per_stopover=True)
    return crossing.lat_bins(rows).select(
        (F.col("lat_bin") + 0.0).alias("lat_bin"),
        rounded("mean_across").alias("mean_across"),
        rounded("se_across").alias("se_across"),
    )


step(
    "cropped_hour",
    """
SELECT h.* FROM hour_period h
JOIN (SELECT id, min(date_day) - 1 AS lo, max(date_day) + 2 AS hi FROM hour_period WHERE period = 4 GROUP BY id) b
ON h.id = b.id AND h.date_day BETWEEN b.lo AND b.hi
""",
)


def _cropped(spark, sf_dir):
    hours = adaptors.kept_hours(spark, sf_dir)
    days = keep(adaptors.days_of(hours).select("id", "date", "period", "season"))
    return crossing.crop_to_period(daily.hourly_with_period(hours, days), 4, days=days)


@query("hours_around_period", "SELECT id, date, date_day, period, lat FROM cropped_hour")
def hours_around_period(spark, sf_dir):
    return _cropped(spark, sf_dir).select("id", "date", "date_day", "period", "lat")


@query(
    "night_intervals",
    """
SELECT id, date_day, sunset, sunrise, next_sunrise
FROM (SELECT *, lead(sunrise) OVER (PARTITION BY id ORDER BY date_day) AS next_sunrise
      FROM (SELECT id, date_day, max(sunset) AS sunset, min(sunrise) AS sunrise FROM cropped_hour GROUP BY ALL)
      WHERE sunset IS NOT NULL AND sunrise IS NOT NULL)
WHERE next_sunrise IS NOT NULL
""",
)
def night_intervals(spark, sf_dir):
    return crossing.night_intervals(_cropped(spark, sf_dir))


@query(
    "night_intervals_with_gaps",
    """
SELECT id, date_day, sunset, sunrise, next_sunrise
FROM (SELECT *, lead(sunrise) OVER (PARTITION BY id ORDER BY date_day) AS next_sunrise
      FROM (SELECT id, date_day, max(sunset) AS sunset, min(sunrise) AS sunrise FROM cropped_hour GROUP BY ALL))
WHERE next_sunrise IS NOT NULL AND sunset IS NOT NULL
""",
)
def night_intervals_with_gaps(spark, sf_dir):
    return crossing.night_intervals(_cropped(spark, sf_dir), keep_gaps=True)


@query(
    "autumn_crossings",
    """
SELECT * FROM (SELECT id, min(date) FILTER (lat <= 37) AS xmin, min(date) FILTER (lat <= -20) AS xmax
               FROM cropped_hour GROUP BY id) WHERE xmin IS NOT NULL AND xmax IS NOT NULL
""",
)
def autumn_crossings(spark, sf_dir):
    return crossing.autumn_crossing(_cropped(spark, sf_dir), 37, -20)


@query(
    "spring_crossings",
    """
SELECT * FROM (SELECT id, min(date) FILTER (lat >= 12) AS xmin, min(date) FILTER (lat >= 60) AS xmax
               FROM cropped_hour GROUP BY id) WHERE xmin IS NOT NULL AND xmax IS NOT NULL
""",
)
def spring_crossings(spark, sf_dir):
    return crossing.spring_crossing(_cropped(spark, sf_dir), 12, 60)


@query(
    "barrier_box_stats",
    """
WITH q AS (SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.25) AS q1,
                  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem GROUP BY ALL)
SELECT flag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (l_extendedprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outside,
       count(*) AS n
FROM lineitem JOIN q ON l_returnflag = flag GROUP BY ALL
""",
)
def barrier_box_stats(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    stats = crossing.box_stats(df, "flag", "l_extendedprice")
    return stats.withColumns({c: rounded(c) for c in ("q1", "median", "q3")})


@query(
    "daily_box_stats",
    """
SELECT CASE WHEN lat >= 18 AND lat <= 37 THEN 'Inside barrier' ELSE 'Outside barrier' END AS barrier, round(quantile_cont(daytime_activity_percentage, 0.25), 6) AS q1,
       round(quantile_cont(daytime_activity_percentage, 0.5), 6) AS median,
       round(quantile_cont(daytime_activity_percentage, 0.75), 6) AS q3
FROM day_period WHERE lat IS NOT NULL AND daytime_activity_percentage IS NOT NULL GROUP BY ALL
""",
)
def daily_box_stats(spark, sf_dir):
    days = keep(
        crossing.with_barrier(adaptors.days_with_periods(spark, sf_dir), *BAND).select(
            "barrier", "daytime_activity_percentage"
        )
    )
    boxes = quantiles.large_quantiles(
        days, ["barrier"], "daytime_activity_percentage", {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    return boxes.withColumns({c: rounded(c) for c in ("q1", "median", "q3")})


@query(
    "half_bin_of_ship_dates",
    """
SELECT id, quantile_cont(step, 0.5) / 2 AS half_bin
FROM (SELECT l_returnflag AS id,
             x - lag(x) OVER (PARTITION BY l_returnflag ORDER BY x) AS step
      FROM (SELECT DISTINCT l_returnflag, epoch_us(l_shipdate)::DOUBLE / 8.64e10 AS x FROM lineitem))
WHERE step IS NOT NULL GROUP BY id
""",
)
def half_bin_of_ship_dates(spark, sf_dir):
    from featherline.functions.times import micros

    df = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_returnflag").alias("id"),
            (micros(F.col("l_shipdate")) / F.lit(8.64e10)).alias("x"),
        )
        .distinct()
    )
    return crossing.half_bin(df, "x", "id")


GRID = [0.0] + [10 ** (-4 + 0.25 * i) for i in range(25)]
step(
    "model_row",
    """
SELECT l_suppkey AS id, l_discount + (l_suppkey % 7) / 50.0 AS y, (l_quantity > 25)::INT::DOUBLE AS x FROM lineitem
""",
)
step(
    "model_sum",
    """
SELECT id, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy
FROM model_row GROUP BY id
""",
)
step(
    "model_profile",
    f"""
SELECT ratio, sum(n) AS m, sum(n - c * n * n) AS a11, sum(sx - c * n * sx) AS a1x, sum(sxx - c * sx * sx) AS axx,
       sum(sy - c * n * sy) AS a1y, sum(sxy - c * sx * sy) AS axy, sum(syy - c * sy * sy) AS ayy,
       sum(ln(1 + n * ratio)) AS log_v
FROM (SELECT *, ratio / (1 + n * ratio) AS c
      FROM (SELECT *, unnest([{", ".join(repr(float(g)) + "::DOUBLE" for g in GRID)}]) AS ratio FROM model_sum))
GROUP BY ratio
""",
)


def _model_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id"),
        (F.col("l_discount") + (F.col("l_suppkey") % 7) / 50).alias("y"),
        (F.col("l_quantity") > 25).cast("int").alias("x"),
    )


@query(
    "barrier_model_profile",
    """
SELECT round(log10(ratio + 1e-9), 4) AS log_ratio, round(b0, 6) AS intercept, round(b1, 6) AS slope,
       round(s2, 8) AS var_residual, round(ratio * s2, 8) AS var_id,
       round((m - 2) * (ln(s2) + 1 + ln(2 * pi())) + log_v + ln(a11 * axx - a1x * a1x), 3) AS deviance
FROM (SELECT *, (ayy - b0 * a1y - b1 * axy) / (m - 2) AS s2
      FROM (SELECT *, (axx * a1y - a1x * axy) / (a11 * axx - a1x * a1x) AS b0,
                   (a11 * axy - a1x * a1y) / (a11 * axx - a1x * a1x) AS b1 FROM model_profile))
""",
)
def barrier_model_profile(spark, sf_dir):
    sums = mixed_model.group_sums(_model_rows(spark, sf_dir), "y", "x")
    return mixed_model.profile(sums, GRID).select(
        F.round(F.log10(F.col("ratio") + 1e-9), 4).alias("log_ratio"),
        rounded("intercept").alias("intercept"),
        rounded("slope").alias("slope"),
        rounded("var_residual", 8).alias("var_residual"),
        rounded("var_id", 8).alias("var_id"),
        rounded("deviance", 3).alias("deviance"),
    )


# The search in SQL: rounds of grids, each ten times finer around the best ratio of the one before, from plain sums.
ROUNDS = 7
step("model_grid_0", "SELECT 10 ** (-4 + 0.25 * i) AS ratio FROM range(25) t(i)")
for _k in range(ROUNDS):
    step(
        f"model_best_{_k}",
        f"""
SELECT *, (m - 2) * (ln(s2) + 1 + ln(2 * pi())) + log_v + ln(det) AS deviance
FROM (SELECT *, (ayy - b0 * a1y - b1 * axy) / (m - 2) AS s2
      FROM (SELECT *, (axx * a1y - a1x * axy) / det AS b0, (a11 * axy - a1x * a1y) / det AS b1
            FROM (SELECT *, a11 * axx - a1x * a1x AS det
                  FROM (SELECT ratio, sum(n) AS m, sum(n - c * n * n) AS a11, sum(sx - c * n * sx) AS a1x, sum(sxx - c * sx * sx) AS axx,
                               sum(sy - c * n * sy) AS a1y, sum(sxy - c * sx * sy) AS axy, sum(syy - c * sy * sy) AS ayy, sum(ln(1 + n * ratio)) AS log_v
                        FROM (SELECT *, ratio / (1 + n * ratio) AS c FROM model_sum, model_grid_{_k}) GROUP BY ratio))))
ORDER BY deviance LIMIT 1
""",
    )
    step(
        f"model_grid_{_k + 1}",
        f"SELECT 10 ** (log10(ratio) + {0.25 / 10**_k!r} * i / 10) AS ratio FROM model_best_{_k}, range(-10, 11) t(i)",
    )


@query(
    "barrier_model",
    f"""
SELECT round(log10(ratio), 3) AS log_ratio, round(b0, 6) AS intercept, round(b0 + b1, 6) AS mean_other, round(-b1, 6) AS contrast,
       round(sqrt(s2 * axx / det), 6) AS se_intercept, round(sqrt(s2 * a11 / det), 6) AS se_slope,
       round(sqrt(s2 * (axx + a11 - 2 * a1x) / det), 6) AS se_mean_other, round(s2, 7) AS var_residual,
       round(ratio * s2, 6) AS var_id, round(deviance, 3) AS deviance, true AS converged
FROM model_best_{ROUNDS - 1}
""",
)
def barrier_model(spark, sf_dir):
    found = mixed_model.barrier_model(_model_rows(spark, sf_dir), "y", "x")
    return found.select(
        F.round(F.log10("ratio"), 3).alias("log_ratio"),
        *[rounded(c).alias(c) for c in ("intercept", "mean_other", "contrast", "se_intercept", "se_slope", "se_mean_other")],
        rounded("var_residual", 7).alias("var_residual"),
        rounded("var_id").alias("var_id"),
        rounded("deviance", 3).alias("deviance"),
        "converged",
    )
