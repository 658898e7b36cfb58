"""Small rule tables applied to tags: windows, cuts, recodes, season names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherline.functions.nulls import among


def crop(df: DataFrame, windows: DataFrame, order: str = "date") -> DataFrame:
    """Keep rows inside the tag's ``crop_start``..``crop_end``; tags without a window stay whole.

    The end is exclusive: a crop date means its midnight.  Of several windows of
    a tag their overlap counts.
    """
    at = F.col(order)
    bounds = windows.groupBy("id").agg(F.max("crop_start").alias("crop_start"), F.min("crop_end").alias("crop_end"))
    return (
        df.join(bounds, "id", "left")
        .where(F.col("crop_start").isNull() | (at >= F.col("crop_start")))
        .where(F.col("crop_end").isNull() | (at < F.col("crop_end")))
        .drop("crop_start", "crop_end")
    )


def cut(df: DataFrame, rules: DataFrame, order: str = "date") -> DataFrame:
    """Keep dates before ``before`` (exclusive, the earliest of a tag) for the tags listed in `rules`."""
    day = F.to_date(order)
    return (
        df.join(rules.groupBy("id").agg(F.min("before").alias("before")), "id", "left")
        .where(F.col("before").isNull() | (day < F.col("before")))
        .drop("before")
    )


def cut_at_period(flights: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop flights beyond a day derived from one of the tag's periods.

    `rules` has ``id, period, keep, shift``: ``keep='until'`` keeps dates up to
    the last date of the period plus `shift` days, ``keep='from'`` keeps dates
    from the first date of the period plus `shift` days.  All rules of a tag
    hold; a tag with a rule on a period that it does not have loses all its rows.
    """
    rules = rules.select(
        "id", F.col("period").alias("_period"), F.col("keep").alias("_keep"), F.col("shift").alias("_shift")
    )
    hits = flights.select("id", "date", "period").join(rules, "id")
    in_period = F.when(F.col("period") == F.col("_period"), F.col("date"))
    until = F.col("_keep") == "until"
    borders = hits.groupBy("id", "_keep", "_period", "_shift").agg(
        F.max(in_period).alias("_last"), F.min(in_period).alias("_first")
    )
    borders = borders.groupBy("id").agg(
        F.min(F.when(until, F.date_add("_last", F.col("_shift")))).alias("_until"),
        F.max(F.when(~until, F.date_add("_first", F.col("_shift")))).alias("_from"),
        F.bool_or(F.col("_last").isNull()).alias("_lost"),
    )
    return (
        flights.join(borders, "id", "left")
        .where(~F.coalesce("_lost", F.lit(False)))
        .where(F.col("_until").isNull() | (F.col("date") <= F.col("_until")))
        .where(F.col("_from").isNull() | (F.col("date") >= F.col("_from")))
        .drop("_until", "_from", "_lost")
    )


def recode_period(df: DataFrame, rules: DataFrame, column: str = "period") -> DataFrame:
    """Replace periods of single tags; `rules` has ``id, at_least, at_most, becomes``.

    All rules of a tag look at the value before recoding, so 8 -> NULL and
    10 -> 8 can stand side by side.  Of several rules that hit, the first by the
    column ``rank`` counts; without it, or at equal ranks, the first by the other columns.
    """
    x = F.col(column)
    hit = F.filter(
        "_rules", lambda r: (x >= r["at_least"]) & (r["at_most"].isNull() | (x <= r["at_most"]))
    )
    rank = ["rank"] if "rank" in rules.columns else []
    grouped = rules.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct(*rank, "at_least", "at_most", "becomes"))).alias("_rules")
    )
    return (
        df.join(grouped, "id", "left")
        .withColumn("_hit", hit)
        .withColumn(
            column, F.when(F.size("_hit") > 0, F.element_at("_hit", 1)["becomes"]).otherwise(x)
        )
        .drop("_rules", "_hit")
    )


def with_season(
    df: DataFrame, seasons: dict[str, list[int]], column: str = "period", out: str = "season"
) -> DataFrame:
    """Name the season of a period; periods in no list get NULL."""
    name = None
    for season, periods in seasons.items():
        hit = among(F.col(column), periods)
        name = F.when(hit, season) if name is None else name.when(hit, season)
    return df.withColumn(out, name)


def season_rank(seasons: dict[str, list[int]], column: str = "season") -> Column:
    """Place of a season in the order in which `seasons` names them, for sorting."""
    levels = F.array(*[F.lit(s) for s in seasons])
    return F.array_position(levels, F.col(column))


def keep_days(df: DataFrame, first: int, last: int, exclude=()) -> DataFrame:
    """Keep a day-of-year range and leave out single tags."""
    inside = F.dayofyear("date").between(first, last)
    return df.where(inside & ~F.col("id").isin(*exclude)) if exclude else df.where(inside)


def drop_recaptured(daily: DataFrame, period: int = 13) -> DataFrame:
    """Drop days of the last period on which a removed logger recorded no activity at all."""
    return daily.where(~((F.col("period") == period) & (F.col("daytime_act_score") == 0)))
