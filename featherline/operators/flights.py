"""Flights from hourly activity: runs, edge-adjusted times, one row per flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.functions.nulls import strict_max, strict_min
from featherline.functions.times import hours_between, minutes
from featherline.operators import series

FULL_HOUR = 5


def flight_groups(hourly: DataFrame) -> DataFrame:
    """Number the runs of flight hours 1, 2, ... per tag; other hours get NULL.

    Also attaches the activity sums and flight flags of the neighbouring hours.
    An hour with unknown activity uses up one number the first time it occurs.
    """
    active = F.col("is_active")
    df = series.neighbours(
        hourly,
        before={"prev_acc_sum": F.col("acc_sum"), "_prev": active},
        after={"next_acc_sum": F.col("acc_sum"), "_next": active},
    )
    starts = active & ~F.coalesce(F.col("_prev"), F.lit(False))
    df = series.running_sum(
        df,
        {
            "_runs": F.when(starts, 1).otherwise(0),
            "_unknown": F.when(active.isNull(), 1).otherwise(0),
        },
    )
    number = F.col("_runs") + F.when(F.col("_unknown") > 0, 1).otherwise(0)
    return df.withColumn("flight_group", F.when(active, number.cast("int"))).drop("_runs", "_unknown")


def group_edges(hourly: DataFrame) -> DataFrame:
    """Flags for the first and last hour of each flight.

    All hours outside flights form one further group per tag, with its own
    first and last hour.
    """
    active = F.coalesce(F.col("is_active"), F.lit(False))
    idle_at = F.when(~active, F.col("date"))
    df = series.per_key(hourly, {"_idle_from": F.min(idle_at), "_idle_to": F.max(idle_at)})
    return df.withColumns(
        {
            "first_row": F.when(active, ~F.coalesce("_prev", F.lit(False))).otherwise(
                F.col("date") == F.col("_idle_from")
            ),
            "last_row": F.when(active, ~F.coalesce("_next", F.lit(False))).otherwise(
                F.col("date") == F.col("_idle_to")
            ),
        }
    ).drop("_prev", "_next", "_idle_from", "_idle_to")


def adjust_times(hourly: DataFrame, full_hour: int = FULL_HOUR) -> DataFrame:
    """Take-off and landing of each hour; `date` is the hour's end.

    A nearly full first or last hour also takes the minutes of the hour before
    or after it.
    """
    date, own = F.col("date"), minutes(F.col("flight_min"))
    full = F.col("acc_sum") >= full_hour
    at = hourly.schema["date"].dataType
    takeoff = F.when(
        F.col("first_row") & full, date - own - minutes(F.col("prev_acc_sum") * 10)
    ).otherwise(date - own)
    landing = F.when(
        F.col("last_row") & full, date + minutes(F.col("next_acc_sum") * 10)
    ).otherwise(date - minutes(F.lit(60)) + own)
    return hourly.withColumns({"takeoff_adjusted": takeoff.cast(at), "landing_adjusted": landing.cast(at)})


def with_next_landing(hourly: DataFrame) -> DataFrame:
    """Landing of the following hour of the tag; apply after any date cut."""
    return series.neighbours(hourly, after={"next_landing": F.col("landing_adjusted")})


def attach_pressure(hourly: DataFrame, pressure: DataFrame) -> DataFrame:
    """Add temperature and pressure of the same hour, by key rather than by position.

    Of several samples of an hour the first counts, so that no hour is repeated.
    """
    at = hourly.schema["date"].dataType
    hour = F.date_trunc("hour", F.col("date")).cast(at)
    sample = F.struct("temp_c", "pressure_hpa")
    press = (
        pressure.groupBy("id", F.date_trunc("hour", F.col("date")).cast(at).alias("_hour"))
        .agg(F.min_by(sample, F.struct("date", "temp_c", "pressure_hpa")).alias("_sample"))
        .select("id", "_hour", "_sample.*")
    )
    return hourly.withColumn("_hour", hour).join(press, ["id", "_hour"], "left").drop("_hour")


def flights(hourly: DataFrame) -> DataFrame:
    """One row per flight with take-off, landing and hours in the air."""
    landing = F.when(F.count(F.lit(1)) == 1, F.first("next_landing")).otherwise(
        strict_max(F.col("landing_adjusted"))
    )
    return (
        hourly.where(F.col("flight_group").isNotNull())
        .groupBy("id", "flight_group")
        .agg(strict_min(F.col("takeoff_adjusted")).alias("takeoff_time"), landing.alias("landing_time"))
        .withColumn(
            "duration_hours", hours_between(F.col("takeoff_time"), F.col("landing_time"))
        )
    )


def total_hours(flights: DataFrame) -> DataFrame:
    return flights.groupBy("id").agg(
        F.coalesce(F.sum("duration_hours"), F.lit(0.0)).alias("total_flight_hours")
    )


def migratory_only(flights: DataFrame, hourly: DataFrame, min_hours: float = 1.5) -> DataFrame:
    """Keep flights that last `min_hours` and during which the pressure falls.

    The hourly table already names the flight of each hour, so this is an equi
    join on the flight and not a search by time.
    """
    drop = (
        hourly.where(F.col("flight_group").isNotNull() & F.col("pressure_hpa").isNotNull())
        .groupBy("id", "flight_group")
        .agg(
            (F.min("pressure_hpa") - F.min_by("pressure_hpa", "date")).alias("pressure_change")
        )
    )
    return flights.join(drop, ["id", "flight_group"]).where(
        (F.col("duration_hours") >= min_hours) & (F.col("pressure_change") < 0)
    )
