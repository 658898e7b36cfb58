"""Parameters per tag: a table of dotted keys, tag values over defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "default"


def resolve_params(params: DataFrame) -> DataFrame:
    """One value per tag and key; `params` has ``id, key, value`` and an id ``default``.

    A key given for the tag replaces the default, other defaults remain.
    """
    defaults = params.where(F.col("id") == DEFAULT)
    own = params.where(F.col("id") != DEFAULT)
    pairs = defaults.agg(F.collect_list(F.struct("key", "value")).alias("pairs"))
    inherited = (
        own.select("id")
        .distinct()
        .withColumn("_pairs", pairs.scalar())
        .select("id", F.explode("_pairs").alias("_p"))
        .select("id", F.col("_p.key").alias("key"), F.col("_p.value").alias("default_value"))
    )
    return inherited.join(own, ["id", "key"], "full_outer").select(
        "id",
        "key",
        F.coalesce("value", "default_value").alias("value"),
        F.col("value").isNotNull().alias("overridden"),
    )


def crop_windows(params: DataFrame) -> DataFrame:
    """Crop dates per tag from resolved parameters."""
    value = F.col("value").try_cast("timestamp_ntz")
    return params.groupBy("id").agg(
        F.max(F.when(F.col("key") == "tag_create.crop_start", value)).alias("crop_start"),
        F.max(F.when(F.col("key") == "tag_create.crop_end", value)).alias("crop_end"),
    )


def number_param(params: DataFrame, key: str, name: str) -> DataFrame:
    """One numeric parameter as a table of ``id`` and `name`."""
    return params.where(F.col("key") == key).select(
        "id", F.col("value").try_cast("double").alias(name)
    )


def weighted(df: DataFrame, expression: str, out: str = "weight") -> DataFrame:
    """A user-given pooling weight, written as SQL over the table's columns, e.g. ``ln(n)/n``."""
    return df.withColumn(out, F.expr(expression))
