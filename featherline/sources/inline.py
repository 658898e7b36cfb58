"""Small rule tables written down in code."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table whose size Spark knows, so that it decides itself whether to broadcast it."""
    fields = T._parse_datatype_string(schema).fields
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    table = pa.table(
        {f.name: pa.array([None if v is None else str(v) for v in c], pa.string()) for f, c in zip(fields, columns)}
    )
    df = spark.createDataFrame(table)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in fields])
