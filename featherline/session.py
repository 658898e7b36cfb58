"""Session settings shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_ready(spark: SparkSession) -> None:
    """Point the session at ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="featherline-"))


def keep(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a table that several later steps read, once, and read it back.

    The Parquet copy in the shared folder cuts the lineage: a lost executor
    costs no recomputation, consumers scan only the columns they use, and Spark
    knows the table's size.  `by` splits it by a column that readers select on.
    """
    spark = df.sparkSession
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
