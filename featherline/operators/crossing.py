"""Barrier crossings, activity over barriers and along latitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featherline.functions.nulls import standard_error
from featherline.operators.quantiles import group_quantiles, large_quantiles
from featherline.operators.series import (
    MAX_ROWS,
    first_where,
    neighbours,
    split_hot,
    without_segments,
)
from featherline.session import keep

INSIDE, OUTSIDE = "Inside barrier", "Outside barrier"


def with_barrier(daily: DataFrame, low: float, high: float) -> DataFrame:
    """Class of each day with known position and activity; the latitude band is inclusive."""
    return daily.where(
        F.col("lat").isNotNull() & F.col("daytime_activity_percentage").isNotNull()
    ).withColumn("barrier", F.when(F.col("lat").between(low, high), INSIDE).otherwise(OUTSIDE))


def crop_to_period(
    hourly: DataFrame, period: int, before: int = 1, after: int = 2, days: DataFrame | None = None
) -> DataFrame:
    """Hours from some days before to some days after a period; tags without it drop out.

    `days` is the daily table (id, date, period) that the hours have their periods from; with it the
    bounds are found without reading the hours.
    """
    known = hourly.select("id", "period", "date_day") if days is None else days.select("id", "period", F.col("date").alias("date_day"))
    bounds = (
        known.where(F.col("period") == period)
        .groupBy("id")
        .agg(
            F.date_sub(F.min("date_day"), before).alias("_from"),
            F.date_add(F.max("date_day"), after).alias("_to"),
        )
    )
    return (
        hourly.join(bounds, "id")
        .where(F.col("date_day").between(F.col("_from"), F.col("_to")))
        .drop("_from", "_to")
    )


def night_intervals(hourly: DataFrame, keep_gaps: bool = False) -> DataFrame:
    """Sunset of each day with the sunrise of the next one.

    Days without sun times are left out before looking ahead, so the next
    sunrise may be some days away; `keep_gaps` looks ahead first.
    """
    nights = hourly.groupBy("id", "date_day").agg(
        F.max("sunset").alias("sunset"), F.min("sunrise").alias("sunrise")
    )
    if not keep_gaps:
        nights = nights.where(F.col("sunset").isNotNull() & F.col("sunrise").isNotNull())
    w = Window.partitionBy("id").orderBy("date_day")
    return nights.withColumn("next_sunrise", F.lead("sunrise").over(w)).where(
        F.col("sunset").isNotNull() & F.col("next_sunrise").isNotNull()
    )


def crossing_interval(hourly: DataFrame, start: Column, end: Column) -> DataFrame:
    """First time each condition holds, for tags that meet both."""
    return first_where(hourly, {"xmin": start, "xmax": end}).dropna(subset=["xmin", "xmax"])


def autumn_crossing(hourly: DataFrame, north: float = 37, south: float = 18) -> DataFrame:
    return crossing_interval(hourly, F.col("lat") <= north, F.col("lat") <= south)


def spring_crossing(hourly: DataFrame, south: float = 12, north: float = 30) -> DataFrame:
    return crossing_interval(hourly, F.col("lat") >= south, F.col("lat") >= north)


def season_flight_stats(flights: DataFrame) -> DataFrame:
    """Landings after sunrise per season: counts, minutes, flight hours.

    `n_ids` counts an unknown landing as one further tag; `n_ids_known` does not.
    """
    flights = keep(
        flights.select("id", "season", "minutes_after_sunrise", "after_sunrise", "duration_hours")
    )
    late = F.col("after_sunrise")
    minutes = F.when(late, F.col("minutes_after_sunrise"))
    per_tag = flights.groupBy("season", "id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(late).alias("n_late"),
        F.count_if(late.isNull()).alias("n_unknown"),
        F.sum(minutes).alias("total"),
        F.min(minutes).alias("shortest"),
        F.max(minutes).alias("longest"),
    )
    counts = per_tag.groupBy("season").agg(
        F.sum("n").alias("n_flights"),
        F.sum("n_late").alias("n_after_sunrise"),
        F.count_if(F.col("n_late") > 0).alias("n_ids_known"),
        F.max((F.col("n_unknown") > 0).cast("int")).alias("_unknown"),
        F.try_divide(F.sum("total"), F.sum("n_late")).alias("mean_minutes_after"),
        F.min("shortest").alias("min_minutes_after"),
        F.max("longest").alias("max_minutes_after"),
    ).withColumn("n_ids", F.col("n_ids_known") + F.col("_unknown"))
    values = F.array(
        F.struct(F.lit("minutes").alias("what"), F.col("minutes_after_sunrise").alias("x")),
        F.struct(F.lit("hours").alias("what"), F.col("duration_hours").alias("x")),
    )
    landed = flights.where(late).select(F.col("season").alias("_season"), F.inline(values))
    medians = (
        large_quantiles(landed, ["_season", "what"], "x", {"m": 0.5})
        .groupBy("_season")
        .agg(
            F.max(F.when(F.col("what") == "minutes", F.col("m"))).alias("median_minutes_after"),
            F.max(F.when(F.col("what") == "hours", F.col("m"))).alias("median_flight_duration"),
        )
    )
    return (
        counts.drop("_unknown")
        .join(medians, F.col("season").eqNullSafe(F.col("_season")), "left")
        .drop("_season")
    )


def period_stats_by_id(daily: DataFrame, low: float, high: float, few: float = 2) -> DataFrame:
    """Days observed, quiet days and barrier days per tag and period.

    Days are unique per tag, so counting rows counts days.
    """
    y, inside = F.col("daytime_activity_percentage"), F.col("lat").between(low, high)
    return (
        daily.where(F.col("lat").isNotNull())
        .groupBy("id", "period_activity")
        .agg(
            F.count(F.lit(1)).alias("n_days_observed"),
            F.avg(y).alias("mean_daytime_activity_id"),
            F.count_if(y <= few).alias("n_days_low"),
            F.count_if(y == 0).alias("n_days_zero"),
            F.count_if(inside).alias("n_days_inside_barrier"),
            F.count_if((y == 0) & inside).alias("n_days_zero_barrier"),
            F.count_if((y <= few) & inside).alias("n_days_low_barrier"),
        )
        .withColumn("n_days_low_outside", F.col("n_days_low") - F.col("n_days_low_barrier"))
    )


def period_stats(by_id: DataFrame, period: int | None = None) -> DataFrame:
    """Means and deviations over tags of `period_stats_by_id`, for one period or all of them."""
    if period is not None:
        by_id = by_id.where(F.col("period_activity") == period)
    measures = {
        "daytime_activity": "mean_daytime_activity_id",
        "days_observed": "n_days_observed",
        "days_low_activity": "n_days_low",
        "days_zero_activity": "n_days_zero",
        "days_inside_barrier": "n_days_inside_barrier",
        "days_zero_activity_barrier": "n_days_zero_barrier",
        "days_low_activity_barrier": "n_days_low_barrier",
        "days_low_activity_outside": "n_days_low_outside",
    }
    spread = [F.avg(c).alias(f"mean_{name}") for name, c in measures.items()]
    spread += [F.stddev_samp(c).alias(f"sd_{name}") for name, c in measures.items()]
    # One row per tag and period, so counting rows counts tags.
    means = by_id.groupBy("period_activity").agg(F.count(F.lit(1)).alias("n_ids"), *spread)
    medians = group_quantiles(
        by_id, ["period_activity"], "n_days_inside_barrier", {"median_days_inside_barrier": 0.5}
    ).withColumnRenamed("period_activity", "_period")
    return (
        means.join(medians, F.col("period_activity").eqNullSafe(F.col("_period")), "left")
        .drop("_period")
        .withColumn(
            "proportion_days_low_activity",
            F.try_divide("mean_days_low_activity", "mean_days_observed"),
        )
    )


def activity_by_lat(daily: DataFrame, per_stopover: bool = False) -> DataFrame:
    """Activity per tag and latitude; `per_stopover` gives each stopover there its own row."""
    y = F.col("daytime_activity_percentage")
    groups = daily.groupBy("id", "lat").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(1).cast("bigint").alias("n_birds"),
        F.avg(y).alias("mean_activity"),
        standard_error(y).alias("se"),
        *([F.collect_set(F.struct("stopover_id")).alias("_stops")] if per_stopover else []),
    )
    if not per_stopover:
        return groups
    return groups.withColumn("_stop", F.explode("_stops")).select(
        "id", "lat", "n_rows", "n_birds", "mean_activity", "se", F.col("_stop.stopover_id").alias("stopover_id")
    )


def lat_bins(by_lat: DataFrame, width: int = 3) -> DataFrame:
    """Mean and standard error over latitude bins, ties rounded to even."""
    latitude = F.bround(F.col("lat") / width, 0) * width
    return by_lat.groupBy(latitude.alias("lat_bin")).agg(
        F.avg("mean_activity").alias("mean_across"),
        standard_error(F.col("mean_activity")).alias("se_across"),
    )


def box_stats(
    daily: DataFrame, by: str, y: str, limits: tuple[float, float] | None = None
) -> DataFrame:
    """Quartiles and whisker ends (the last value within 1.5 quartile ranges) per class.

    Values outside the drawn `limits` are left out before anything is computed.
    """
    if limits is not None:
        daily = daily.where(F.col(y).between(*limits))
    # Written, so that Spark knows their size when it chooses the join.
    boxes = keep(large_quantiles(daily, [by], y, {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(y).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        daily.select(by, y)
        .where(F.col(y).isNotNull())
        .join(boxes, by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(y))).alias("whisker_low"),
            F.max(F.when(inside, F.col(y))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outside"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def half_bin(df: DataFrame, x: str, by: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Half the median step between neighbouring values of `x`, per group."""
    rows = split_hot(df, key=by, order=x, max_rows=max_rows)
    steps = without_segments(neighbours(rows, {"_before": F.col(x)}, key=by, order=x))
    steps = steps.withColumn("_step", (F.col(x) - F.col("_before")).cast("double"))
    return large_quantiles(steps, [by], "_step", {"_median": 0.5}).select(
        by, (F.col("_median") / 2).alias("half_bin")
    )
