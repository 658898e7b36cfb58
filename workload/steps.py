"""SQL steps shared by several queries."""

from __future__ import annotations

from workload.adaptors import EVENT_PERIODS, ORDER_PERIODS
from workload.registry import step

step(
    "hourly",
    """
SELECT user_id AS id, ts AS date, acc3, acc4, acc5,
       (acc3 * 3 + acc4 * 4 + acc5 * 5)::DOUBLE AS act_score
FROM (SELECT user_id, ts,
             (floor(value)::INT % 3)::INT AS acc3,
             (floor(value / 3)::INT % 3)::INT AS acc4,
             (floor(value / 9)::INT % 3)::INT AS acc5
      FROM events)
""",
)
step(
    "path_rows",
    """
SELECT user_id AS id, ts AS date,
       (regexp_extract(props, '([0-9]+)', 1)::INT - 27)::DOUBLE AS lat,
       (event_id % 40)::DOUBLE AS lon,
       (event_id % 9)::DOUBLE / 2 AS stap_id,
       CASE WHEN event_type <> 'error' THEN date_trunc('day', ts)::TIMESTAMP + INTERVAL 3 HOUR END AS sunrise,
       CASE WHEN event_type <> 'click' THEN date_trunc('day', ts)::TIMESTAMP + INTERVAL 17 HOUR END AS sunset
FROM events WHERE event_type <> 'signup'
""",
)
step(
    "pressure_rows",
    """
SELECT user_id AS id, date_trunc('hour', ts)::TIMESTAMP AS hour,
       avg(regexp_extract(props, '([0-9]+)', 1)::INT) AS temp_c,
       1000 - avg(value) AS pressure_hpa
FROM events GROUP BY ALL
""",
)
step(
    "active_rows",
    """
SELECT *, acc_sum >= 3 AND acc_high AND NOT masked AS is_active,
       CASE WHEN acc_high AND NOT masked THEN acc_sum * 10 ELSE 0 END AS flight_min
FROM (SELECT *, acc3 + acc4 + acc5 AS acc_sum, acc4 > 0 OR acc5 > 0 AS acc_high,
             strftime(date, '%m-%d') BETWEEN '01-10' AND '01-12' AS masked
      FROM hourly)
""",
)
# Runs by the difference of two row numbers, then numbered by their first row.
step(
    "grouped_rows",
    """
SELECT a.*, g.flight_group
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date)
              - row_number() OVER (PARTITION BY id, is_active ORDER BY date) AS island
      FROM active_rows) a
LEFT JOIN (SELECT id, island, row_number() OVER (PARTITION BY id ORDER BY min(date))::INT AS flight_group
           FROM (SELECT id, date, is_active,
                        row_number() OVER (PARTITION BY id ORDER BY date)
                        - row_number() OVER (PARTITION BY id, is_active ORDER BY date) AS island
                 FROM active_rows)
           WHERE is_active GROUP BY id, island) g
ON a.is_active AND a.id = g.id AND a.island = g.island
""",
)
step(
    "edged_rows",
    """
SELECT *,
       lag(acc_sum) OVER (PARTITION BY id ORDER BY date) AS prev_acc_sum,
       lead(acc_sum) OVER (PARTITION BY id ORDER BY date) AS next_acc_sum,
       row_number() OVER (PARTITION BY id, flight_group ORDER BY date) = 1 AS first_row,
       row_number() OVER (PARTITION BY id, flight_group ORDER BY date DESC) = 1 AS last_row
FROM grouped_rows
""",
)
step(
    "adjusted_rows",
    """
SELECT *,
       CASE WHEN first_row AND acc_sum >= 5
            THEN date - to_minutes(flight_min) - to_minutes(prev_acc_sum * 10)
            ELSE date - to_minutes(flight_min) END AS takeoff_adjusted,
       CASE WHEN last_row AND acc_sum >= 5 THEN date + to_minutes(next_acc_sum * 10)
            ELSE date - INTERVAL 60 MINUTE + to_minutes(flight_min) END AS landing_adjusted
FROM edged_rows
""",
)
step(
    "flight_row",
    """
SELECT *, lead(landing_adjusted) OVER (PARTITION BY id ORDER BY date) AS next_landing
FROM adjusted_rows
""",
)
step(
    "flight",
    """
SELECT *, (epoch_us(landing_time) - epoch_us(takeoff_time)) / 3.6e9 AS duration_hours
FROM (SELECT id, flight_group,
             CASE WHEN count(takeoff_adjusted) = count(*) THEN min(takeoff_adjusted) END AS takeoff_time,
             CASE WHEN count(*) = 1 THEN min(next_landing)
                  WHEN count(landing_adjusted) = count(*) THEN max(landing_adjusted) END AS landing_time
      FROM flight_row WHERE flight_group IS NOT NULL GROUP BY id, flight_group)
""",
)
step(
    "order_flight",
    """
SELECT o_custkey AS id, o_orderkey AS flight_group, o_orderdate AS takeoff_time,
       o_totalprice / 10000 AS duration_hours
FROM orders
""",
)


def period_steps(prefix: str, source: str, rules: dict) -> None:
    """Flight by flight, with a self join for the density rule."""
    step(
        f"{prefix}_gap",
        f"""
SELECT *, takeoff_time::DATE AS date, dayofyear(takeoff_time)::INT AS yday,
       date_diff('day', lag(takeoff_time::DATE) OVER w, takeoff_time::DATE)::INT AS gap
FROM {source} WHERE takeoff_time IS NOT NULL
WINDOW w AS (PARTITION BY id ORDER BY takeoff_time, flight_group)
""",
    )
    step(
        f"{prefix}_candidate",
        f"""
SELECT *, sum(CASE WHEN gap IS NULL OR gap >= {rules["gap_days"]} THEN 1 ELSE 0 END)
            OVER (PARTITION BY id ORDER BY takeoff_time, flight_group)::BIGINT AS candidate
FROM {prefix}_gap
""",
    )
    step(
        f"{prefix}_dense",
        f"""
SELECT id, candidate, max(near) >= {rules["min_flights"]} AS dense
FROM (SELECT a.id, a.candidate, a.flight_group, count(*) AS near
      FROM {prefix}_candidate a JOIN {prefix}_candidate b
      ON a.id = b.id AND a.candidate = b.candidate
         AND abs(date_diff('day', a.date, b.date)) <= {rules["window_days"]}
      GROUP BY ALL)
GROUP BY ALL
""",
    )
    step(
        f"{prefix}_long",
        f"""
SELECT id, candidate, round(coalesce(sum(duration_hours), 0), 9) > {rules["min_hours"]} AS long
FROM {prefix}_candidate GROUP BY ALL
""",
    )
    step(
        f"{prefix}_valid",
        f"""
SELECT c.*, CASE WHEN d.dense AND l.long THEN c.candidate END AS valid
FROM {prefix}_candidate c
JOIN {prefix}_dense d ON c.id = d.id AND c.candidate = d.candidate
JOIN {prefix}_long l ON c.id = l.id AND c.candidate = l.candidate
""",
    )
    step(
        f"{prefix}_spring",
        f"""
SELECT v.*, CASE WHEN v.yday <= {rules["last_spring_yday"]} AND v.valid IS NOT NULL AND v.date < s.start
                 THEN -1 ELSE v.valid END AS label
FROM {prefix}_valid v
LEFT JOIN (SELECT m.id, min(v2.date) AS start
           FROM (SELECT id, arg_max(valid, date) AS last_valid FROM {prefix}_valid
                 WHERE yday <= {rules["last_spring_yday"]} AND valid IS NOT NULL GROUP BY id) m
           JOIN {prefix}_valid v2 ON v2.id = m.id AND v2.valid = m.last_valid
           GROUP BY m.id) s ON v.id = s.id
""",
    )
    step(
        f"{prefix}_period",
        f"""
SELECT s.*, n.number AS period
FROM {prefix}_spring s
LEFT JOIN (SELECT id, label, (row_number() OVER (PARTITION BY id ORDER BY min(date)) * 2)::DOUBLE AS number
           FROM {prefix}_spring WHERE label IS NOT NULL GROUP BY id, label) n
ON s.id = n.id AND s.label = n.label
UNION ALL BY NAME SELECT * FROM {source} WHERE takeoff_time IS NULL
""",
    )


period_steps("order", "order_flight", ORDER_PERIODS)
period_steps("event", "flight", EVENT_PERIODS)

step(
    "merged_rows",
    """
SELECT f.*, p.lat, p.lon, p.stap_id, p.sunrise, p.sunset
FROM flight_row f LEFT JOIN path_rows p ON f.id = p.id AND f.date = p.date
""",
)
step(
    "quiet_rows",
    """
SELECT *, NOT is_active AND date >= coalesce(sunrise, date_trunc('day', date)::TIMESTAMP + INTERVAL 4 HOUR)
          AND date <= coalesce(sunset, date_trunc('day', date)::TIMESTAMP + INTERVAL 16 HOUR) AS daytime,
       act_score - CASE WHEN coalesce(lag(is_active) OVER w, false) OR coalesce(lead(is_active) OVER w, false)
                        THEN acc5 * 5 + acc4 * 4 ELSE 0 END AS score_left
FROM merged_rows WINDOW w AS (PARTITION BY id ORDER BY date)
""",
)
step(
    "day_row",
    """
SELECT *, CASE WHEN daytime_rows > 0
               THEN daytime_act_score_no_flight / (daytime_rows * 30) * 100 END AS daytime_activity_percentage
FROM (SELECT id, date::DATE AS date,
             coalesce(sum(flight_min) FILTER (is_active), 0)::BIGINT AS total_flight_min,
             count(*) FILTER (is_active) AS flight_rows,
             count(*) FILTER (daytime) AS daytime_rows,
             coalesce(sum(act_score) FILTER (daytime), 0) AS daytime_act_score,
             coalesce(sum(score_left) FILTER (daytime), 0) AS daytime_act_score_no_flight,
             avg(lat) FILTER (NOT is_active) AS lat,
             avg(lon) FILTER (NOT is_active) AS lon,
             min(stap_id) FILTER (NOT is_active AND stap_id % 1 = 0) AS stopover_id
      FROM quiet_rows GROUP BY id, date::DATE)
""",
)
step(
    "flight_day",
    """
SELECT id, date, period FROM (
  SELECT id, date, period, row_number() OVER (PARTITION BY id, date ORDER BY takeoff_time, flight_group) AS rn
  FROM event_period WHERE date IS NOT NULL) WHERE rn = 1
""",
)
step(
    "calendar",
    """
SELECT coalesce(c.id, f.id) AS id, coalesce(c.date, f.date) AS date, f.period
FROM (SELECT id, unnest(generate_series(make_date(year(lo), 1, 3)::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
      FROM (SELECT id, min(date) AS lo, max(date) AS hi FROM flight_day GROUP BY id)
      WHERE make_date(year(lo), 1, 3) <= hi) c
FULL JOIN flight_day f ON c.id = f.id AND c.date = f.date
""",
)
step(
    "day_known",
    """
SELECT d.*, c.period AS known, dayofyear(d.date)::INT AS day_of_year
FROM day_row d LEFT JOIN calendar c ON d.id = c.id AND d.date = c.date
""",
)
# Runs of one period among the known days, filled from first to last day.
step(
    "day_run",
    """
SELECT id, known, min(date) AS start, max(date) AS stop
FROM (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY date) AS run
      FROM (SELECT id, date, known,
                   CASE WHEN known = lag(known) OVER (PARTITION BY id ORDER BY date) THEN 0 ELSE 1 END AS opens
            FROM day_known WHERE known IS NOT NULL))
GROUP BY id, run, known
""",
)
step(
    "day_filled",
    """
SELECT d.*, coalesce(r.known, d.known) AS filled
FROM day_known d LEFT JOIN day_run r ON d.id = r.id AND d.date BETWEEN r.start AND r.stop
""",
)
step(
    "day_stationary",
    """
SELECT *, CASE WHEN filled IS NOT NULL THEN filled
               WHEN next_known IS NOT NULL THEN next_known - 1
               ELSE last_known + 1 END AS period
FROM (SELECT *,
             (SELECT arg_min(n.filled, n.date) FROM day_filled n
              WHERE n.id = d.id AND n.date > d.date AND n.filled IS NOT NULL) AS next_known,
             (SELECT arg_max(n.filled, n.date) FROM day_filled n
              WHERE n.id = d.id AND n.date < d.date AND n.filled IS NOT NULL) AS last_known
      FROM day_filled d)
""",
)
step(
    "day_period",
    """
SELECT *, CASE WHEN period_activity IN (1, 7) THEN 'Breeding' WHEN period_activity IN (2, 3, 4) THEN 'Autumn'
               WHEN period_activity = 5 THEN 'Wintering' WHEN period_activity IN (6, 8) THEN 'Spring' END AS season
FROM (SELECT *, CASE WHEN period % 2 = 0 AND before <> period THEN before
                     WHEN period % 2 = 0 AND before IS NULL THEN NULL
                     ELSE period END AS period_activity
      FROM (SELECT *, lag(period) OVER (PARTITION BY id ORDER BY date) AS before
            FROM day_stationary WHERE NOT (period = 9 AND daytime_act_score = 0)))
""",
)
step(
    "hour_period",
    """
SELECT m.*, m.date::DATE AS date_day, d.period, d.season
FROM merged_rows m LEFT JOIN day_period d ON m.id = d.id AND m.date::DATE = d.date
""",
)
step(
    "sunrise_day",
    """
SELECT id, dayofyear(date)::INT AS yday, max(sunrise) + INTERVAL 1 DAY AS sunrise, arg_min(lat, date) AS latitude
FROM merged_rows WHERE sunrise IS NOT NULL GROUP BY ALL
""",
)
step(
    "season_flight",
    """
SELECT *, last_value(own_season IGNORE NULLS) OVER (PARTITION BY id ORDER BY takeoff_time, flight_group
                                                    ROWS UNBOUNDED PRECEDING) AS season
FROM (SELECT *, CASE WHEN period IN (2, 4) THEN 'Autumn' WHEN period IN (6, 8) THEN 'Spring' END AS own_season
      FROM event_period)
""",
)
step(
    "late_flight",
    """
SELECT f.*, s.sunrise, s.latitude, (epoch_us(f.landing_time) - epoch_us(s.sunrise)) / 6e7 AS minutes_after_sunrise,
       (epoch_us(f.landing_time) - epoch_us(s.sunrise)) / 6e7 > 0 AS after_sunrise
FROM season_flight f LEFT JOIN sunrise_day s ON f.id = s.id AND f.yday = s.yday
""",
)
