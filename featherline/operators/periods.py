"""Flights grouped into migration periods.

Every rule looks at the calendar date of a flight only, so flights are first
counted per tag and day.  That table holds at most one row per tag and calendar
day, which bounds each window below whatever the number of flights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EARLIER = -1.0


def with_flight_date(flights: DataFrame) -> DataFrame:
    day = F.to_date("takeoff_time")
    return flights.withColumns({"date": day, "yday": F.dayofyear(day)})


def flight_days(flights: DataFrame) -> DataFrame:
    """Flights and flight hours per tag and day."""
    return (
        with_flight_date(flights)
        .where(F.col("date").isNotNull())
        .groupBy("id", "date")
        .agg(
            F.count(F.lit(1)).alias("n_flights"),
            F.coalesce(F.sum("duration_hours"), F.lit(0.0)).alias("hours"),
            F.min(F.struct("takeoff_time", "flight_group")).alias("_first"),
        )
    )


def gap_periods(days: DataFrame, gap_days: int = 5) -> DataFrame:
    """Candidate periods: a step of `gap_days` or more since the last flight day opens one."""
    w = Window.partitionBy("id").orderBy("date")
    gap = F.datediff("date", F.lag("date").over(w))
    opens = F.when(gap.isNull() | (gap >= gap_days), 1).otherwise(0)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        days.withColumn("gap", gap)
        .withColumn("_opens", opens)
        .withColumn("candidate", F.sum("_opens").over(upto))
        .drop("_opens")
    )


def with_density(days: DataFrame, window_days: int = 5, min_flights: int = 3) -> DataFrame:
    """Whether some flight of the candidate has enough flights within `window_days` of it."""
    near = (
        Window.partitionBy("id", "candidate")
        .orderBy(F.unix_date("date"))
        .rangeBetween(-window_days, window_days)
    )
    whole = Window.partitionBy("id", "candidate")
    return days.withColumn("flights_near", F.sum("n_flights").over(near)).withColumn(
        "dense", F.max("flights_near").over(whole) >= min_flights
    )


def with_period_hours(days: DataFrame) -> DataFrame:
    whole = Window.partitionBy("id", "candidate")
    return days.withColumn("period_hours", F.sum("hours").over(whole))


def long_periods(days: DataFrame, min_hours: float = 16) -> DataFrame:
    """Keep the days of candidates with strictly more than `min_hours` in the air."""
    long = (
        days.groupBy("id", "candidate")
        .agg(F.sum("hours").alias("_hours"))
        .where(F.col("_hours") > min_hours)
    )
    return days.join(long, ["id", "candidate"], "left_semi")


def split_spring(days: DataFrame, last_yday: int = 150) -> DataFrame:
    """Merge the valid spring candidates before the last one of them into a single period."""
    whole = Window.partitionBy("id")
    spring = F.col("period").isNotNull() & (F.dayofyear("date") <= last_yday)
    df = days.withColumn("_spring", spring).withColumn(
        "_last", F.max_by(F.when(spring, F.col("period")), F.when(spring, F.col("date"))).over(whole)
    )
    start = F.min(F.when(F.col("period") == F.col("_last"), F.col("date"))).over(whole)
    return (
        df.withColumn("_start", start)
        .withColumn(
            "period",
            F.when(F.col("_spring") & (F.col("date") < F.col("_start")), F.lit(EARLIER)).otherwise(
                F.col("period")
            ),
        )
        .drop("_spring", "_last", "_start")
    )


def renumber(days: DataFrame) -> DataFrame:
    """Number the periods of a tag 2, 4, 6, ... by their first day."""
    first_day = F.min("date").over(Window.partitionBy("id", "period"))
    by_first = Window.partitionBy("id", F.col("period").isNull()).orderBy("_first_day")
    return (
        days.withColumn("_first_day", first_day)
        .withColumn("_rank", F.dense_rank().over(by_first))
        .withColumn(
            "period", F.when(F.col("period").isNotNull(), (F.col("_rank") * 2).cast("double"))
        )
        .drop("_first_day", "_rank")
    )


def period_days(
    flights: DataFrame,
    gap_days: int = 5,
    window_days: int = 5,
    min_flights: int = 3,
    min_hours: float = 16,
    last_spring_yday: int = 150,
) -> DataFrame:
    """The period of every tag and flight day, NULL where no rule is met."""
    days = with_period_hours(
        with_density(gap_periods(flight_days(flights), gap_days), window_days, min_flights)
    )
    valid = F.col("dense") & (F.col("period_hours") > min_hours)
    days = days.withColumn("period", F.when(valid, F.col("candidate").cast("double")))
    return renumber(split_spring(days, last_spring_yday))


def flight_periods(flights: DataFrame, **rules) -> DataFrame:
    """Flights with date, day of year, gap to the previous flight in days, and period."""
    days = period_days(flights, **rules).select("id", "date", "gap", "period", "_first")
    opens_day = (F.col("takeoff_time") == F.col("_first.takeoff_time")) & (
        F.col("flight_group") == F.col("_first.flight_group")
    )
    return (
        with_flight_date(flights)
        .join(days, ["id", "date"], "left")
        .withColumn(
            "gap", F.when(F.col("date").isNotNull(), F.when(opens_day, F.col("gap")).otherwise(0))
        )
        .drop("_first")
    )


def assignment_counts(periods: DataFrame) -> DataFrame:
    return periods.groupBy("id").agg(
        F.count_if(F.col("period").isNotNull()).alias("n_assigned"),
        F.count_if(F.col("period").isNull()).alias("n_unassigned"),
    )
