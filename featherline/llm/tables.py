"""Intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from featherline import session

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back; its shuffle files go once it is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return session.keep(df)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def with_texts(small: DataFrame, texts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join rows to their texts by sorting both sides, with one plan at every size."""
    return small.join(texts.hint("merge"), key, how)
