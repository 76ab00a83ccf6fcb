"""What the two vector operators share: usable vectors, bounded pivots, and blocks of neighbouring vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, *more: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, more) without null ids, null or empty vectors, and null or non-finite components."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *more)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix; shorter vectors are padded with zeros."""
    values, ends = np.asarray(lists.values), np.asarray(lists.offsets)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == dim).all():
        return values[ends[0] : ends[-1]].reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    for i, (a, n) in enumerate(zip(ends[:-1], sizes)):
        out[i, :n] = values[a : a + n]
    return out


def pivots(rows: DataFrame, count: int, dim: int) -> np.ndarray:
    """At most `count` vectors, those with the smallest hashes of their ids: the only vectors the driver sees."""
    found = rows.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(count).collect()
    out = np.zeros((len(found), dim))
    for i, r in enumerate(found):
        out[i, : len(r["v"])] = r["v"]
    return out


def blocks(placed: DataFrame, rows_in_block: int, pack: Callable[[pa.Table], list], schema: str, names: list[str], kinds: list) -> DataFrame:
    """Runs of rows of placed (pivot, distance, vec_id, ...), sorted by these, of one pivot and at most rows_in_block.

    Sorting is by range, so that a pivot with many vectors is dealt over many tasks. pack turns a run into the values
    after block (a number unique to the run).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part, held = 0, TaskContext.get().partitionId(), None

        def cut(t: pa.Table, end: bool) -> tuple[list[pa.Table], pa.Table]:
            key = t.column("pivot").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            out, last = [], 0
            for a, z in zip(edges[:-1], edges[1:]):
                while z - a >= rows_in_block or (a < z and (z < len(key) or end)):
                    m = min(rows_in_block, z - a)
                    out.append(t.slice(a, m))
                    a += m
                    last = a
            return out, t.slice(last)

        def packed(runs: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            nonlocal n
            for t in runs:
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([(part << 32) | n, *pack(t.combine_chunks())], kinds)], names)
                n += 1

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            runs, held = cut(t, False)
            yield from packed(runs)
        if held is not None and held.num_rows:
            yield from packed(cut(held, True)[0])

    order = ["pivot", "distance", "vec_id"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
