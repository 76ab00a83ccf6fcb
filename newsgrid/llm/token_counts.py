"""Token counts (operator 5): lengths only, from Arrow batches, each cut into groups of about equal bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrid.llm.common import table
from newsgrid.llm.segments import TokenCounter, kept, vocabulary


def count_tokens(docs: DataFrame, vocab: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text).

    vocab: path of a byte-level BPE file on every machine; the public one by default. A null text counts as empty: 0
    bytes, 0 tokens. Repeated rows give repeated rows; other columns are ignored; no rows give no rows. One pass, no
    shuffle: the scan deals out bytes, and a text of any length is encoded whole, in chunks cut at safe boundaries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(TokenCounter, vocab or vocabulary("byte_bpe_50k.json"))
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(counter.counts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
