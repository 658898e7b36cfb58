"""Column clean-up, coverage and constraint reports for exported tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop columns whose name is empty or starts with three dots."""
    named = [c for c in df.columns if c and not re.match(r"^(\.\.\.|_c\d+$)", c)]
    return df.select(*[F.col(f"`{c}`") for c in named])


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns without a single value; one pass over the table."""
    seen = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if seen[i] > 0])


def union_tables(*parts: DataFrame) -> DataFrame:
    """Stack tables by column name; columns missing in one of them become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def coverage(series: dict[str, DataFrame]) -> DataFrame:
    """Samples, first and last time per tag and sensor; each table has ``id, date``."""
    parts = [
        df.groupBy("id").agg(
            F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
        ).withColumn("sensor", F.lit(sensor))
        for sensor, df in series.items()
    ]
    return union_tables(*parts)


def check_table(
    df: DataFrame,
    key: list[str],
    required: list[str] = (),
    domains: dict[str, list] | None = None,
    references: dict[str, tuple[DataFrame, str]] | None = None,
) -> DataFrame:
    """Number of rows that break each constraint: missing, duplicate, outside a domain, dangling."""
    checks = {f"missing {c}": F.count_if(F.col(c).isNull()) for c in required}
    for c, allowed in (domains or {}).items():
        checks[f"domain {c}"] = F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*allowed))
    reports = []
    if checks:
        names = list(checks)
        row = df.agg(*[checks[n].alias(f"_{i}") for i, n in enumerate(names)])
        cells = F.array(
            *[
                F.struct(F.lit(n).alias("check"), F.col(f"_{i}").alias("n_failed"))
                for i, n in enumerate(names)
            ]
        )
        reports.append(row.select(F.inline(cells)))
    repeats = df.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("_more"))
    reports.append(
        repeats.agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("n_failed")).select(
            F.lit("unique " + ",".join(key)).alias("check"), "n_failed"
        )
    )
    for c, (other, other_key) in (references or {}).items():
        targets = other.select(F.col(other_key).alias(c)).distinct()
        dangling = df.where(F.col(c).isNotNull()).join(targets, c, "left_anti")
        reports.append(
            dangling.agg(F.count(F.lit(1)).alias("n_failed")).select(
                F.lit(f"reference {c}").alias("check"), "n_failed"
            )
        )
    return union_tables(*reports)


def missing_tags(tags: DataFrame, table: DataFrame) -> DataFrame:
    """Tags without a row in `table`."""
    return tags.select("id").distinct().join(table.select("id").distinct(), "id", "left_anti")
