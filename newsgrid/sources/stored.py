"""Tables that several later steps read, written once in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tables of more rows than this are not broadcast unless a join asks for it.
FEW_ROWS = 1 << 16


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/newsgrid-{uuid.uuid4().hex}"


def of_rows(df: DataFrame, n: int) -> DataFrame:
    """df, known to have n rows; where these are many, joins on it shuffle both sides.

    Spark plans with the size of the files. Compressed columns may take a hundredth of what their rows take in memory, so a
    table of millions of rows would be gathered by the driver and sent to all machines.
    """
    return df.hint("merge") if n > FEW_ROWS else df


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """As stored, and the number of rows; a table of many is never broadcast, nor is what it is joined with."""
    spark, path = df.sparkSession, _folder(df.sparkSession)
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    n = rows.get["n"]
    return of_rows(spark.read.schema(df.schema).parquet(path), n), n


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet under spark.checkpoint.dir and read again, which also cuts its lineage. Where that setting is
    absent, as in tests, the warehouse's folder takes its place."""
    spark, path = df.sparkSession, _folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
