"""Token-id output (operator 10): ORC files of ids in ascending doc_id order, with row indexes and Bloom filters on doc_id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgrid.llm.common import shared_folder, table
from newsgrid.llm.segments import WordEncoder, kept, vocabulary

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = 1, stripe_mb: int = 16) -> None:
    """Encode every whole text of docs (doc_id, text; null: empty), append end_id, and write ORC files under path.

    Rows are range-partitioned and sorted by doc_id (nulls first; equal ids by a hash of the text, so that one id may
    have any number of rows), and file after file the ids ascend. Each row has its ids, the number of its file's task (part) and the count of ids before it in that part.
    ORC packs the ids by integer run-length encoding; stripes of stripe_mb can be read in parallel, and row indexes and
    Bloom filters on doc_id let a reader skip stripes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = kept(WordEncoder, vocab or vocabulary("word_bpe_49k.json")), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                rows = [np.append(x, np.int32(end_id)) for x in encoder.encode([t or "" for t in b.column("text").to_pylist()])]
                sizes = np.array([len(x) for x in rows], np.int64)
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(rows), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(np.full(len(rows), part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes), ids],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        ordered.mapInArrow(run, SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_mb << 20)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before this one, over all files.

    Only one row for each part is summed up to place the parts one after the other; that table has as many rows as the
    write had tasks.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    placed = rows.join(F.broadcast(before), "part")
    return placed.select("doc_id", (F.coalesce("before", F.lit(0)) + F.col("part_start")).alias("start"), "n_tokens", "ids")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; the predicate reaches the ORC reader, which skips stripes by index and Bloom filter."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def ids_crc32(rows: DataFrame, column: str = "ids") -> DataFrame:
    """rows without that array column, and with ids_crc32: the unsigned crc32 of its ids as little-endian 32-bit integers."""
    others = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(column)
            values, ends = np.asarray(lists.values).astype("<u4", copy=False), np.asarray(lists.offsets)
            view = memoryview(np.ascontiguousarray(values)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(crc, pa.int64())], [*others, "ids_crc32"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in others), "ids_crc32 long"]))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    write_token_files(table(spark, sf_dir, "documents"), path)
    return ids_crc32(read_token_files(spark, path))
