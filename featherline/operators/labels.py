"""Hand-edited labels of twilights and pressure samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherline.functions.times import minute_of_day, offset_minutes

DISCARD = "discard"


def stap_of_label(label: Column) -> Column:
    """Stationary period of a label; a dash is a decimal point, so ``37-5`` is the flight 37.5."""
    return F.regexp_replace(label, "-", ".").try_cast("double")


def with_stap(labelled: DataFrame) -> DataFrame:
    """Parse labels: stationary period, flight flag, discard flag."""
    stap = stap_of_label(F.col("label"))
    return labelled.withColumns(
        {
            "stap_id": stap,
            "is_flight": stap % 1 != 0,
            "discarded": F.col("label").eqNullSafe(F.lit(DISCARD)),
        }
    )


def valid_labels(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("label") != DISCARD)


def label_diff(before: DataFrame, after: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Rows added, removed or relabelled between two revisions."""
    a = before.select(*keys, F.col(label).alias("label_before"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.col(label).alias("label_after"), F.lit(True).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(~F.col("label_before").eqNullSafe(F.col("label_after")), "relabelled")
    )
    return (
        a.join(b, keys, "full_outer")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .drop("_a", "_b")
    )


def with_twilight_value(twilights: DataFrame, offset: float) -> DataFrame:
    """Minutes since a day start that lies `offset` minutes before midnight."""
    return twilights.withColumn("value", offset_minutes(F.col("timestamp"), offset))


def normalise_series(twilights: DataFrame, longitude: float = 0.0) -> DataFrame:
    """Name twilights by local clock: before noon is morning.

    The names in the files cannot be trusted; some loggers swap them.
    """
    local = F.pmod(minute_of_day(F.col("timestamp")) + longitude * 4, F.lit(1440.0))
    return twilights.withColumn("event", F.when(local < 720, "morning").otherwise("evening"))
