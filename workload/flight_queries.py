"""Hourly activity, flights and migration periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from featherline.operators import activity, flights, periods, rules, series
from featherline.plans import flight_plan
from workload import adaptors, steps  # noqa: F401
from workload.adaptors import MASK, ORDER_PERIODS, rounded, table
from workload.registry import query


@query(
    "activity_hours",
    "SELECT id, date, acc_sum, acc_high, masked, is_active, flight_min FROM active_rows",
)
def activity_hours(spark, sf_dir):
    df = activity.with_activity(adaptors.hourly(spark, sf_dir))
    return activity.flight_hours(activity.season_mask(df, *MASK)).select(
        "id", "date", "acc_sum", "acc_high", "masked", "is_active", "flight_min"
    )


@query(
    "activity_from_samples",
    """
SELECT user_id AS id, date_trunc('hour', ts)::TIMESTAMP AS date, count(*) AS n_samples,
       count(*) FILTER (value > 20) AS n_high, count(*) FILTER (value > 20) >= 2 AS is_active
FROM events GROUP BY ALL
""",
)
def activity_from_samples(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("ts").alias("date"), "value"
    )
    return activity.flight_hours_from_samples(samples, k=2, threshold=20)


@query(
    "flight_hours",
    """
SELECT id, date, is_active, flight_group, first_row, last_row, flight_min, prev_acc_sum, next_acc_sum,
       takeoff_adjusted, landing_adjusted, next_landing
FROM flight_row
""",
)
def flight_hours(spark, sf_dir):
    return adaptors.flight_rows(spark, sf_dir).select(
        "id",
        "date",
        "is_active",
        "flight_group",
        "first_row",
        "last_row",
        "flight_min",
        "prev_acc_sum",
        "next_acc_sum",
        "takeoff_adjusted",
        "landing_adjusted",
        "next_landing",
    )


@query(
    "flights",
    """
SELECT id, flight_group, takeoff_time, landing_time, round(duration_hours, 6) AS duration_hours FROM flight
""",
)
def flight_list(spark, sf_dir):
    return adaptors.event_flights(spark, sf_dir).withColumn(
        "duration_hours", rounded("duration_hours")
    )


@query(
    "total_flight_hours",
    """
SELECT id, round(coalesce(sum(duration_hours), 0), 6) AS total_flight_hours FROM flight GROUP BY id
""",
)
def total_flight_hours(spark, sf_dir):
    return flights.total_hours(adaptors.event_flights(spark, sf_dir)).withColumn(
        "total_flight_hours", rounded("total_flight_hours")
    )


@query(
    "activity_runs",
    """
SELECT id, date, event_type,
       sum(opens) OVER (PARTITION BY id ORDER BY date)::BIGINT AS run_id
FROM (SELECT user_id AS id, ts AS date, event_type,
             CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1
                  THEN 0 ELSE 1 END AS opens
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
""",
)
def activity_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("ts").alias("date"), "event_type"
    )
    return series.without_segments(series.run_id(series.split_hot(rows), "event_type"))


@query(
    "hourly_pressure",
    """
SELECT f.id, f.date, f.flight_group, round(p.temp_c, 6) AS temp_c, round(p.pressure_hpa, 6) AS pressure_hpa
FROM flight_row f LEFT JOIN pressure_rows p ON f.id = p.id AND date_trunc('hour', f.date)::TIMESTAMP = p.hour
""",
)
def hourly_pressure(spark, sf_dir):
    rows = flight_plan.hourly_flights(
        adaptors.hourly(spark, sf_dir), MASK, pressure=adaptors.pressure(spark, sf_dir)
    )
    return rows.select(
        "id",
        "date",
        "flight_group",
        rounded("temp_c").alias("temp_c"),
        rounded("pressure_hpa").alias("pressure_hpa"),
    )


@query(
    "migratory_flights",
    """
SELECT f.id, f.flight_group, round(f.duration_hours, 6) AS duration_hours,
       round(p.low - p.first, 6) AS pressure_change
FROM flight f
JOIN (SELECT r.id, r.flight_group, min(p.pressure_hpa) AS low, arg_min(p.pressure_hpa, r.date) AS first
      FROM flight_row r JOIN pressure_rows p ON r.id = p.id AND date_trunc('hour', r.date)::TIMESTAMP = p.hour
      WHERE r.flight_group IS NOT NULL GROUP BY ALL) p
ON f.id = p.id AND f.flight_group = p.flight_group
WHERE f.duration_hours >= 1.5 AND p.low - p.first < 0
""",
)
def migratory_flights(spark, sf_dir):
    rows = flight_plan.hourly_flights(
        adaptors.hourly(spark, sf_dir), MASK, pressure=adaptors.pressure(spark, sf_dir)
    )
    return flights.migratory_only(flights.flights(rows), rows).select(
        "id",
        "flight_group",
        rounded("duration_hours").alias("duration_hours"),
        rounded("pressure_change").alias("pressure_change"),
    )


@query(
    "flight_hours_after_cut",
    """
SELECT a.id, a.date, a.flight_group, a.landing_adjusted,
       lead(a.landing_adjusted) OVER (PARTITION BY a.id ORDER BY a.date) AS next_landing
FROM adjusted_rows a LEFT JOIN nation n ON a.id = n.n_nationkey
WHERE n.n_nationkey IS NULL OR a.date::DATE < DATE '2024-01-15' + n.n_regionkey
""",
)
def flight_hours_after_cut(spark, sf_dir):
    cuts = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.expr("date_add(DATE'2024-01-15', n_regionkey)").alias("before"),
    )
    rows = flight_plan.hourly_flights(adaptors.hourly(spark, sf_dir), MASK, cuts=cuts)
    return rows.select("id", "date", "flight_group", "landing_adjusted", "next_landing")


@query(
    "cropped_hours",
    """
SELECT h.id, h.date, h.act_score
FROM hourly h LEFT JOIN nation n ON h.id = n.n_nationkey
WHERE n.n_nationkey IS NULL
   OR (h.date >= TIMESTAMP '2024-01-03' + to_days(n.n_regionkey) AND h.date < TIMESTAMP '2024-01-25')
""",
)
def cropped_hours(spark, sf_dir):
    windows = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.expr("cast(date_add(DATE'2024-01-03', n_regionkey) AS timestamp_ntz)").alias("crop_start"),
        F.expr("TIMESTAMP_NTZ'2024-01-25'").alias("crop_end"),
    )
    return rules.crop(adaptors.hourly(spark, sf_dir), windows).select("id", "date", "act_score")


@query(
    "order_sessions",
    """
SELECT id, date, gap, sum(CASE WHEN gap IS NULL OR gap >= 3 THEN 1 ELSE 0 END)
                        OVER (PARTITION BY id ORDER BY date)::BIGINT AS session
FROM (SELECT id, date, date_diff('day', lag(date) OVER (PARTITION BY id ORDER BY date), date)::INT AS gap
      FROM (SELECT DISTINCT o_orderpriority AS id, o_orderdate::DATE AS date FROM orders))
""",
)
def order_sessions(spark, sf_dir):
    dates = (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderpriority").alias("id"), F.to_date("o_orderdate").alias("date"))
        .distinct()
    )
    return series.gap_sessions(dates, 3)


@query(
    "flight_period_days",
    """
SELECT id, date, any_value(candidate) AS candidate, count(*) AS n_flights, round(sum(duration_hours), 6) AS hours,
       any_value(period) AS period
FROM order_period GROUP BY id, date
""",
)
def flight_period_days(spark, sf_dir):
    days = periods.period_days(adaptors.order_flights(spark, sf_dir), **ORDER_PERIODS)
    return days.select(
        "id", "date", "candidate", "n_flights", rounded("hours").alias("hours"), "period"
    )


@query(
    "flight_periods",
    """
SELECT id, flight_group, takeoff_time, date, yday, gap, period FROM order_period
""",
)
def flight_periods(spark, sf_dir):
    out = flight_plan.flight_periods(adaptors.order_flights(spark, sf_dir), **ORDER_PERIODS)
    return out.select("id", "flight_group", "takeoff_time", "date", "yday", "gap", "period")


@query(
    "dense_candidates",
    "SELECT id, candidate, dense FROM order_dense",
)
def dense_candidates(spark, sf_dir):
    days = periods.gap_periods(
        periods.flight_days(adaptors.order_flights(spark, sf_dir)), ORDER_PERIODS["gap_days"]
    )
    days = periods.with_density(days, ORDER_PERIODS["window_days"], ORDER_PERIODS["min_flights"])
    return days.groupBy("id", "candidate").agg(F.max("dense").alias("dense"))


@query(
    "long_periods",
    """
SELECT c.id, c.date, any_value(c.candidate) AS candidate
FROM order_candidate c JOIN order_long l ON c.id = l.id AND c.candidate = l.candidate AND l.long
GROUP BY c.id, c.date
""",
)
def long_periods(spark, sf_dir):
    days = periods.gap_periods(
        periods.flight_days(adaptors.order_flights(spark, sf_dir)), ORDER_PERIODS["gap_days"]
    )
    return periods.long_periods(days, ORDER_PERIODS["min_hours"]).select("id", "date", "candidate")


@query(
    "event_flight_periods",
    "SELECT id, flight_group, date, gap, period FROM event_period",
)
def event_flight_periods(spark, sf_dir):
    return adaptors.event_periods(spark, sf_dir).select("id", "flight_group", "date", "gap", "period")


@query(
    "assignment_counts",
    """
SELECT id, count(*) FILTER (period IS NOT NULL) AS n_assigned, count(*) FILTER (period IS NULL) AS n_unassigned
FROM order_period GROUP BY id
""",
)
def assignment_counts(spark, sf_dir):
    return periods.assignment_counts(
        flight_plan.flight_periods(adaptors.order_flights(spark, sf_dir), **ORDER_PERIODS)
    )


@query(
    "recoded_periods",
    """
SELECT p.id, p.flight_group,
       CASE WHEN c.c_mktsegment = 'BUILDING' AND p.period >= 6 THEN NULL
            WHEN c.c_mktsegment = 'MACHINERY' AND p.period = 4 THEN NULL
            WHEN c.c_mktsegment = 'MACHINERY' AND p.period = 6 THEN 4
            ELSE p.period END AS period
FROM order_period p JOIN customer c ON p.id = c.c_custkey
""",
)
def recoded_periods(spark, sf_dir):
    segment = F.col("c_mktsegment")
    rule = F.when(segment == "BUILDING", F.expr("array(struct(6D, cast(null as double), cast(null as double)))")).when(
        segment == "MACHINERY",
        F.expr("array(struct(4D, 4D, cast(null as double)), struct(6D, 6D, 4D))"),
    )
    recodes = (
        table(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("id"), F.explode(rule).alias("r"))
        .select(
            "id",
            F.col("r.col1").alias("at_least"),
            F.col("r.col2").alias("at_most"),
            F.col("r.col3").alias("becomes"),
        )
    )
    out = flight_plan.flight_periods(
        adaptors.order_flights(spark, sf_dir), recodes=recodes, **ORDER_PERIODS
    )
    return out.select("id", "flight_group", "period")


@query(
    "flights_cut_at_period",
    """
SELECT p.id, p.flight_group, p.date, p.period
FROM order_period p JOIN customer c ON p.id = c.c_custkey
LEFT JOIN (SELECT id, max(date) FILTER (period = 4) AS until, min(date) FILTER (period = 2) AS since
           FROM order_period GROUP BY id) b ON p.id = b.id
WHERE CASE WHEN c.c_mktsegment = 'BUILDING' THEN p.date <= b.until + 1
           WHEN c.c_mktsegment = 'MACHINERY' THEN p.date >= b.since + 1
           ELSE true END
""",
)
def flights_cut_at_period(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    until = F.col("c_mktsegment") == "BUILDING"
    cuts = customers.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        F.col("c_custkey").alias("id"),
        F.when(until, 4.0).otherwise(2.0).alias("period"),
        F.when(until, "until").otherwise("from").alias("keep"),
        F.lit(1).alias("shift"),
    )
    out = flight_plan.flight_periods(
        adaptors.order_flights(spark, sf_dir), period_cuts=cuts, **ORDER_PERIODS
    )
    return out.select("id", "flight_group", "date", "period")
