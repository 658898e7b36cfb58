"""Writers.  Each writes one folder per table, split by tag where readers ask for single tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.operators.tables import missing_tags


def _by_tag(df: DataFrame, mode: str = "overwrite"):
    """A writer that replaces the folders of the tags it holds and leaves those of others."""
    return df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("id")


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, one folder per tag; folders of other tags stay."""
    _by_tag(df, mode).parquet(path)


def write_twilight(df: DataFrame, path: str) -> None:
    """Label text for hand editing, one folder per tag."""
    text = df.select(
        "id",
        "series",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        "value",
        "label",
    )
    _by_tag(text).option("header", "true").csv(path)


def export_path(paths: DataFrame, tags: DataFrame, path: str, only: list[str] | None = None) -> DataFrame:
    """Write the positions of the tags that have some; return the tags that have none."""
    if only is not None:
        paths, tags = paths.where(F.col("id").isin(*only)), tags.where(F.col("id").isin(*only))
    write_results(paths, path)
    return missing_tags(tags, paths)


def export_tags(coverage: DataFrame) -> DataFrame:
    """One row per tag: first and last record over all sensors."""
    return coverage.groupBy("id").agg(
        F.min("first").alias("attached"),
        F.max("last").alias("detached"),
        F.count_distinct("sensor").alias("n_sensors"),
    )


def export_observations(coverage: DataFrame) -> DataFrame:
    """Two rows per tag: when it was put on and when it was taken off."""
    tags = export_tags(coverage)
    events = F.array(
        F.struct(F.lit("equipment").alias("observation_type"), F.col("attached").alias("date")),
        F.struct(F.lit("retrieval").alias("observation_type"), F.col("detached").alias("date")),
    )
    return tags.select("id", F.inline(events))


def export_package(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{path.rstrip('/')}/{name}")
