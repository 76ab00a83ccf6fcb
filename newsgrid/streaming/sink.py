"""A table that micro-batches of streams are appended to exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_LEDGER = StructType([StructField("n_rows", LongType()), StructField("stream", StringType()), StructField("batch", LongType())])


def _place(path: str, kind: str, stream: str, batch: int) -> str:
    return f"{path.rstrip('/')}/{kind}/stream={stream}/batch={batch}"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(n_rows, stream, batch) of the batches that are in the table; none where there is no table yet."""
    root = f"{path.rstrip('/')}/ledger"
    if not _exists(spark, root):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).parquet(root)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_once(path: str, stream: str, transform: Callable[[DataFrame], DataFrame] = lambda batch: batch, rows_in_file: int = 1_000_000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds transform(batch) to the table at path, once for each batch of the named stream.

    Rows of a batch have a folder of their own, named by stream and batch; writing it again replaces it. The batch counts
    from the moment its one ledger file is in place: before that readers do not see its rows, and a batch that stopped
    anywhere is written again from the start; after that a replay returns at once. Nothing is appended twice, and nothing
    of half a batch is ever read. Streams with different names share a table; a name stands for one checkpoint.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = f"{_place(path, 'ledger', stream, number)}/_SUCCESS"
        if _exists(spark, done):
            return
        rows = _place(path, "rows", stream, number)
        transform(batch).write.mode("overwrite").option("maxRecordsPerFile", rows_in_file).parquet(rows)
        # counted from what was written: a transform that is not repeatable cannot differ
        written = spark.read.parquet(rows).agg(F.count("*").alias("n_rows"))
        written.coalesce(1).write.mode("overwrite").parquet(_place(path, "ledger", stream, number))

    return run


def read_committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows, stream and batch of all batches in the ledger. schema: that of the rows, for tables that are still empty."""
    whole = StructType([*schema.fields, StructField("stream", StringType()), StructField("batch", LongType())])
    root = f"{path.rstrip('/')}/rows"
    if not _exists(spark, root):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(root).join(ledger(spark, path).select("stream", "batch"), ["stream", "batch"], "left_semi").select(*whole.names)
