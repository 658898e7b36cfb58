"""The given tables seen as tracking data.

``events`` are activity rows (user = tag), ``orders`` are flights (customer =
tag), ``lineitem`` days with a response, ``labels`` hand-edited labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featherline.functions.times import at_hour
from featherline.operators import daily, flights, rules
from featherline.plans import daily_plan, flight_plan
from featherline.session import keep

MASK = ("01-10", "01-12")
EVENT_PERIODS = {"gap_days": 3, "window_days": 2, "min_flights": 3, "min_hours": 2.5, "last_spring_yday": 12}
ORDER_PERIODS = {
    "gap_days": 200,
    "window_days": 150,
    "min_flights": 3,
    "min_hours": 60.0,
    "last_spring_yday": 150,
}
CALENDAR_START = (1, 3)
SEASONS = {"Breeding": [1, 7], "Autumn": [2, 3, 4], "Wintering": [5], "Spring": [6, 8]}
FLIGHT_SEASONS = {"Autumn": [2, 4], "Spring": [6, 8]}

HOUR_COLUMNS = (
    "id date act_score lat lon stap_id sunrise sunset is_active flight_min flight_group takeoff_adjusted "
    "landing_adjusted next_landing day quiet daytime act_score_no_flight"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column | str, places: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, places) + F.lit(0.0)


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")

    def level(width: int) -> Column:
        return (F.floor(v / width).cast("int") % 3).cast("int")

    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("id"),
            F.col("ts").alias("date"),
            level(1).alias("acc3"),
            level(3).alias("acc4"),
            level(9).alias("acc5"),
        )
        .withColumn(
            "act_score", (F.col("acc3") * 3 + F.col("acc4") * 4 + F.col("acc5") * 5).cast("double")
        )
    )


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions for all events but signups; some without sun times."""
    day = F.to_date("ts")
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") != "signup")
        .select(
            F.col("user_id").alias("id"),
            F.col("ts").alias("date"),
            (_k() - 27).cast("double").alias("lat"),
            (F.col("event_id") % 40).cast("double").alias("lon"),
            ((F.col("event_id") % 9) / 2).alias("stap_id"),
            F.when(F.col("event_type") != "error", at_hour(day, 3, "timestamp_ntz")).alias("sunrise"),
            F.when(F.col("event_type") != "click", at_hour(day, 17, "timestamp_ntz")).alias("sunset"),
        )
    )


def pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means per tag."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("id"), hour.alias("date"))
        .agg(F.avg(_k()).alias("temp_c"), (1000 - F.avg("value")).alias("pressure_hpa"))
    )


def flight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flight_plan.hourly_flights(hourly(spark, sf_dir), MASK)


def event_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flights.flights(flight_rows(spark, sf_dir))


def periods_of(hours: DataFrame) -> DataFrame:
    return flight_plan.flight_periods(flights.flights(hours), **EVENT_PERIODS)


def event_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_of(flight_rows(spark, sf_dir))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_plan.hours_with_positions(hourly(spark, sf_dir), path(spark, sf_dir), MASK)


def kept_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`merged`, written once for queries that read it for flights and for days."""
    return keep(merged(spark, sf_dir).select(*HOUR_COLUMNS))


def days_of(hours: DataFrame) -> DataFrame:
    return daily_plan.days_with_periods(
        daily.summarise_hours(hours),
        periods_of(hours),
        calendar_start=CALENDAR_START,
        seasons=SEASONS,
        last_period=9,
    )


def days_with_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days_of(kept_hours(spark, sf_dir))


def merged_with_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = kept_hours(spark, sf_dir)
    return daily.hourly_with_period(hours, days_of(hours))


def order_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderkey").alias("flight_group"),
        F.col("o_orderdate").alias("takeoff_time"),
        (F.col("o_totalprice") / 10000).alias("duration_hours"),
    )


def seasonal(flight_table: DataFrame) -> DataFrame:
    return daily.fill_season(rules.with_season(flight_table, FLIGHT_SEASONS))
