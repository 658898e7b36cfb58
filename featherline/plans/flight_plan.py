"""From hourly activity to flights and migration periods."""

from __future__ import annotations

from pyspark.sql import DataFrame

from featherline import study
from featherline.operators import activity, flights, periods, rules
from featherline.operators.series import MAX_ROWS, split_hot, without_segments


def hourly_flights(
    hourly: DataFrame,
    mask: tuple[str, str] = study.MASK,
    pressure: DataFrame | None = None,
    cuts: DataFrame | None = None,
    max_rows: int | None = MAX_ROWS,
    keep_segments: bool = False,
) -> DataFrame:
    """Hours with flight number, adjusted times and the next hour's landing.

    Further columns of `hourly` are passed through.
    """
    df = split_hot(hourly, max_rows=max_rows)
    df = activity.flight_hours(activity.season_mask(activity.with_activity(df), *mask))
    df = flights.adjust_times(flights.group_edges(flights.flight_groups(df)))
    if cuts is not None:
        df = rules.cut(df, cuts)
    df = flights.with_next_landing(df)
    df = df if keep_segments else without_segments(df)
    return df if pressure is None else flights.attach_pressure(df, pressure)


def flight_periods(
    all_flights: DataFrame,
    recodes: DataFrame | None = None,
    period_cuts: DataFrame | None = None,
    **period_rules,
) -> DataFrame:
    """Flights with their migration period, after recodes and cuts of single tags."""
    out = periods.flight_periods(all_flights, **(study.PERIOD_RULES | period_rules))
    if recodes is not None:
        out = rules.recode_period(out, recodes)
    if period_cuts is not None:
        out = rules.cut_at_period(out, period_cuts)
    return out
