"""Hourly activity: class sums, seasonal mask, flight-hour rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.functions.nulls import if_known
from featherline.functions.times import month_day


def with_activity(hourly: DataFrame) -> DataFrame:
    """Number of ten-minute samples in the three highest classes, and whether any is in the top two."""
    return hourly.withColumns(
        {
            "acc_sum": F.col("acc3") + F.col("acc4") + F.col("acc5"),
            "acc_high": (F.col("acc4") > 0) | (F.col("acc5") > 0),
        }
    )


def season_mask(hourly: DataFrame, first: str, last: str) -> DataFrame:
    """Mark hours between two ``MM-dd`` days, both inclusive."""
    low, high = (int(d[:2]) * 100 + int(d[3:]) for d in (first, last))
    return hourly.withColumn("masked", month_day(F.col("date")).between(low, high))


def flight_hours(hourly: DataFrame, min_sum: int = 3) -> DataFrame:
    """Classify flight hours and count their flight minutes."""
    usable = F.col("acc_high") & ~F.col("masked")
    return hourly.withColumns(
        {
            "is_active": (F.col("acc_sum") >= min_sum) & usable,
            "flight_min": if_known(usable, F.col("acc_sum") * 10, F.lit(0)),
        }
    )


def flight_hours_from_samples(samples: DataFrame, k: int = 4, threshold: float = 4) -> DataFrame:
    """The ten-minute form of the rule: at least `k` samples of an hour above `threshold`.

    The hour is named by its start.
    """
    at = samples.schema["date"].dataType
    hour = F.date_trunc("hour", "date").cast(at)
    return (
        samples.groupBy("id", hour.alias("date"))
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.count_if(F.col("value") > threshold).alias("n_high"),
        )
        .withColumn("is_active", F.col("n_high") >= k)
    )


def suspicious_hours(merged: DataFrame) -> DataFrame:
    """Daylight hours outside the mask with high-class samples that are not flight hours."""
    return merged.where(
        ~F.col("is_active")
        & ~F.col("masked")
        & F.col("date").between(F.col("sunrise"), F.col("sunset"))
        & F.col("acc_high")
    )


def activity_percentage(hourly: DataFrame, full_score: int = 30) -> DataFrame:
    return hourly.withColumn("activity_percentage", F.col("act_score") * 100 / full_score)
