"""From flight hours, flights and positions to daily activity by period and season."""

from __future__ import annotations

from pyspark.sql import DataFrame

from featherline import study
from featherline.operators import daily, rules
from featherline.operators.series import MAX_ROWS, split_hot, without_segments
from featherline.plans import flight_plan


def hours_with_positions(
    hourly: DataFrame,
    path: DataFrame,
    mask: tuple[str, str] = study.MASK,
    cuts: DataFrame | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Flight hours with positions and daytime flags.

    Positions are joined first, so that the windows of the flight rules and of
    the daytime rules share one shuffle by tag.
    """
    rows = daily.join_path(split_hot(hourly, max_rows=max_rows), path)
    rows = flight_plan.hourly_flights(rows, mask, cuts=cuts, max_rows=None, keep_segments=True)
    return without_segments(daily.quiet_hours(rows))


def summarise_days(merged: DataFrame, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """The daily table before periods are added; `merged` holds flight hours with positions."""
    return daily.summarise_hours(daily.quiet_hours(split_hot(merged, max_rows=max_rows)))


def days_with_periods(
    days: DataFrame,
    flights: DataFrame,
    cuts: DataFrame | None = None,
    recodes: DataFrame | None = None,
    calendar_start: tuple[int, int] = (6, 12),
    seasons: dict[str, list[int]] = study.DAILY_SEASONS,
    last_period: int = 13,
) -> DataFrame:
    """Give every day its period, the period its activity counts for, and its season."""
    by_day = daily.complete_days(daily.periods_by_day(flights), *calendar_start)
    out = daily.fill_stationary(daily.fill_same_run(daily.add_period(days, by_day)))
    if cuts is not None:
        out = rules.cut(out, cuts)
    out = rules.drop_recaptured(out, last_period)
    if recodes is not None:
        out = rules.recode_period(out, recodes)
    return rules.with_season(daily.period_activity(out), seasons, "period_activity")


def seasonal_flights(flights: DataFrame, seasons: dict[str, list[int]] = study.FLIGHT_SEASONS) -> DataFrame:
    return daily.fill_season(rules.with_season(flights, seasons))


