"""Hours rolled up to days, and the migration or stopover period of every day.

Daily tables hold at most one row per tag and calendar day, so windows over a
tag's days stay small for any number of hourly rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featherline.functions.nulls import if_known, lenient_sum, strict_sum
from featherline.functions.times import at_hour, days, minutes_between
from featherline.operators import series


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Stop when a key occurs twice; a duplicate would multiply joined rows."""
    twice = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1)
    if twice.count():
        raise ValueError(f"duplicate key in {keys}")
    return df


def join_path(hourly: DataFrame, path: DataFrame) -> DataFrame:
    """Add the estimated position of each hour; `path` must be unique in id and date."""
    return hourly.join(path, ["id", "date"], "left")


def quiet_hours(merged: DataFrame, sunrise_hour: int = 4, sunset_hour: int = 16) -> DataFrame:
    """Mark daytime hours outside flights and the activity score left without flight.

    Missing sun times fall back to fixed hours.  The score of the two highest
    classes is taken off when the hour before or after is a flight hour.
    """
    at = merged.schema["date"].dataType.simpleString()
    df = series.neighbours(
        merged,
        before={"_prev": F.col("is_active")},
        after={"_next": F.col("is_active")},
        default=False,
    )
    day = F.to_date("date")
    quiet = ~F.col("is_active")
    rises = F.coalesce(F.col("sunrise"), at_hour(day, sunrise_hour, at))
    sets = F.coalesce(F.col("sunset"), at_hour(day, sunset_hour, at))
    taken = if_known(F.col("_prev") | F.col("_next"), F.col("acc5") * 5 + F.col("acc4") * 4, F.lit(0))
    return df.withColumns(
        {
            "day": day,
            "quiet": quiet,
            "daytime": quiet & (F.col("date") >= rises) & (F.col("date") <= sets),
            "act_score_no_flight": F.col("act_score") - taken,
        }
    ).drop("_prev", "_next")


def summarise_hours(hours: DataFrame, full_score: int = 30) -> DataFrame:
    """One row per tag and day: flight minutes, daytime activity, mean position, stopover.

    Takes the output of `quiet_hours`.
    """
    daytime, quiet, active = F.col("daytime"), F.col("quiet"), F.col("is_active")
    whole_stap = F.when(quiet & (F.col("stap_id") % 1 == 0), F.col("stap_id"))
    return (
        hours.groupBy("id", F.col("day").alias("date"))
        .agg(
            lenient_sum(F.col("flight_min"), active).alias("total_flight_min"),
            F.count_if(active).alias("flight_rows"),
            F.count_if(daytime).alias("daytime_rows"),
            lenient_sum(F.col("act_score"), daytime).alias("daytime_act_score"),
            strict_sum(F.col("act_score_no_flight"), daytime).alias("daytime_act_score_no_flight"),
            F.avg(F.when(quiet, F.col("lat"))).alias("lat"),
            F.avg(F.when(quiet, F.col("lon"))).alias("lon"),
            F.min(whole_stap).alias("stopover_id"),
        )
        .withColumn(
            "daytime_activity_percentage",
            F.try_divide(
                F.col("daytime_act_score_no_flight"), F.col("daytime_rows") * F.lit(float(full_score))
            )
            * 100,
        )
    )


def periods_by_day(flights: DataFrame) -> DataFrame:
    """One row per tag and flight day; the earliest flight's period wins."""
    return (
        flights.where(F.col("takeoff_time").isNotNull())
        .groupBy("id", F.to_date("takeoff_time").alias("date"))
        .agg(F.min_by("period", F.struct("takeoff_time", "flight_group")).alias("period"))
    )


def first_per_day(flights: DataFrame) -> DataFrame:
    """The whole earliest row of each tag and day."""
    row = F.min_by(F.struct(*flights.columns), F.struct("takeoff_time", "flight_group"))
    return (
        flights.groupBy("id", F.col("date").alias("_day"))
        .agg(row.alias("_row"))
        .select("_row.*")
    )


def complete_days(by_day: DataFrame, month: int = 6, day: int = 12) -> DataFrame:
    """Add every calendar day from `month`-`day` of the first year to the tag's last day.

    Rows before that day are kept.  Each row is stretched to the day before the tag's next row, the first
    one also back to the start, so the table is read once and nothing is joined.
    """
    w = Window.partitionBy("id").orderBy(F.col("date").asc_nulls_last())
    rows = by_day.withColumns(
        {
            "_next": F.lead("date").over(w),
            "_place": F.row_number().over(w),
            "_lo": F.min("date").over(Window.partitionBy("id")),
        }
    ).withColumn("_start", F.make_date(F.year("_lo"), F.lit(month), F.lit(day)))
    begin = F.when(F.col("_place") == 1, F.least("date", "_start")).otherwise(F.col("date"))
    end = F.greatest(F.col("date"), F.date_sub("_next", 1))  # a missing next day is left out
    own = F.col("_day").eqNullSafe(F.col("date"))
    rest = [c for c in by_day.columns if c not in ("id", "date")]
    return (
        rows.withColumn("_day", F.explode_outer(F.when(F.col("date").isNotNull(), F.sequence(begin, end))))
        .where(own | (F.col("_day") >= F.col("_start")))
        .select("id", F.col("_day").alias("date"), *[F.when(own, F.col(c)).alias(c) for c in rest])
    )


def add_period(daily: DataFrame, by_day: DataFrame) -> DataFrame:
    return daily.join(by_day.select("id", "date", "period"), ["id", "date"], "left").withColumn(
        "day_of_year", F.dayofyear("date")
    )


def _nearest(column: str, up_to: int) -> tuple[Column, Column]:
    """Last known value before and next known value after a day; 0 includes the day itself."""

    def towards(order: Column) -> Column:
        w = Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, up_to)
        return F.last(column, ignorenulls=True).over(w)

    return towards(F.col("date").asc()), towards(F.col("date").desc())


def fill_same_run(daily: DataFrame) -> DataFrame:
    """Fill days between two known days of the same period, with no other period between them."""
    before, after = _nearest("period", -1)
    return daily.withColumn(
        "period", F.coalesce(F.col("period"), F.when(before == after, before))
    )


def run_days(daily: DataFrame) -> DataFrame:
    """Every calendar day from first to last day of each run of one period."""
    known = daily.where(F.col("period").isNotNull())
    runs = series.run_id(known, "period", "period_run")
    spans = runs.groupBy("id", "period", "period_run").agg(
        F.min("date").alias("start"), F.max("date").alias("end")
    )
    return spans.select("id", "period", F.explode(F.sequence("start", "end")).alias("date"))


def fill_runs_by_join(daily: DataFrame) -> DataFrame:
    """`fill_same_run` by joining the days of each run back to the table."""
    inside = run_days(daily).withColumnRenamed("period", "_filled")
    return (
        daily.join(inside, ["id", "date"], "left")
        .withColumn("period", F.coalesce("_filled", "period"))
        .drop("_filled")
    )


def fill_stationary(daily: DataFrame) -> DataFrame:
    """Days between migrations get the odd number between their neighbours' even numbers."""
    before, after = _nearest("period", 0)
    return daily.withColumn("period", F.coalesce(F.col("period"), after - 1, before + 1))


def period_activity(daily: DataFrame) -> DataFrame:
    """The period a day's activity counts for: a migration's first day still belongs to the stopover."""
    w = Window.partitionBy("id").orderBy("date")
    before, now = F.lag("period").over(w), F.col("period")
    opens = (now % 2 == 0) & (before != now)
    return daily.withColumn("period_activity", if_known(opens, before, now))


def hourly_with_period(merged: DataFrame, daily: DataFrame) -> DataFrame:
    """Give each hour the period and season of its day."""
    info = daily.select("id", F.col("date").alias("date_day"), "period", "season")
    return merged.withColumn("date_day", F.to_date("date")).join(info, ["id", "date_day"], "left")


def sunrise_by_day(merged: DataFrame) -> DataFrame:
    """The following morning's sunrise per tag and day of year."""
    return (
        merged.where(F.col("sunrise").isNotNull())
        .groupBy("id", F.dayofyear("date").alias("yday"))
        .agg(F.max("sunrise").alias("sunrise"), F.min_by("lat", "date").alias("latitude"))
        .withColumn(
            "sunrise", (F.col("sunrise") + days(1)).cast(merged.schema["sunrise"].dataType)
        )
    )


def flights_vs_sunrise(flights: DataFrame, sunrises: DataFrame) -> DataFrame:
    """Minutes from the next sunrise to landing."""
    return (
        flights.join(sunrises, ["id", "yday"], "left")
        .withColumn("minutes_after_sunrise", minutes_between(F.col("sunrise"), F.col("landing_time")))
        .withColumn("after_sunrise", F.col("minutes_after_sunrise") > 0)
    )


def fill_season(flights: DataFrame) -> DataFrame:
    """Carry the season forward over flights outside any period.

    Flights of one day share their period, so the days of a tag are filled and
    joined back.
    """
    by_day = flights.groupBy("id", "date").agg(F.max("season").alias("_season"))
    w = (
        Window.partitionBy("id")
        .orderBy(F.col("date").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = by_day.select(
        F.col("id").alias("_id"),
        F.col("date").alias("_date"),
        F.last("_season", ignorenulls=True).over(w).alias("_season"),
    )
    same_day = (F.col("id") == F.col("_id")) & F.col("date").eqNullSafe(F.col("_date"))
    return (
        flights.join(filled, same_day, "left")
        .withColumn("season", F.col("_season"))
        .drop("_id", "_date", "_season")
    )
