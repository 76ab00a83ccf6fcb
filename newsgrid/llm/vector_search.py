"""Exact top-k search (operator 8): a pivot-distance index whose annuli are expanded until bounds say stop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgrid.llm.common import saved, table
from newsgrid.llm.vectors import blocks, matrix, pivots, usable


def _raised_distance(x: np.ndarray, p: np.ndarray, norm2: float) -> np.ndarray:
    """Distances after one more component makes all squared norms norm2: near means a large inner product."""
    hx, hp = np.sqrt(np.maximum(0, norm2 - (x * x).sum(1))), np.sqrt(np.maximum(0, norm2 - (p * p).sum(1)))
    return np.sqrt(np.maximum(0, 2 * norm2 - 2 * (x @ p.T + np.outer(hx, hp))))


def _query_distance(q: np.ndarray, p: np.ndarray, norm2: float) -> np.ndarray:
    """Distances of queries, whose further component is 0, to raised pivots."""
    return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + norm2 - 2 * (q @ p.T)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, n_pivots: int = 64, rows_in_block: int = 1024, blocks_in_task: int = 64, queries_in_task: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k largest integer inner products with other vectors.

    vectors: (vec_id, embedding array<float>); is_query picks the queries. Components become floor(256 * x). Vectors that
    are null or empty or hold null or non-finite components, and null ids, take no part; shorter vectors count as padded
    with zeros; rows that repeat an id count once (the smallest vector). Ties go to the smaller vec_id; a query with
    fewer than k others has all of them; no vectors give no rows. Scores are exact while they stay below 2 ** 53.

    Index: vectors are raised by one component to equal norms, which turns the largest inner product into the smallest
    distance; each is keyed by its nearest pivot and its distance to it, sorted, and cut into annuli of at most
    rows_in_block. All vectors are indexed; only the pivots are a sample. Search: a task takes up to queries_in_task
    queries and blocks_in_task annuli, sorts the annuli by the triangle inequality's bound, and expands them until every
    query's bound falls below its k-th score so far, which starts at that among the pivots. So a task's memory is bounded,
    equal vectors are spread over annuli, and only k rows for each query and task are shuffled.
    """
    spark = vectors.sparkSession
    ints = F.transform("v", lambda x: F.floor(x * 256).cast("double"))
    rows = saved(usable(vectors).select("vec_id", ints.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")))
    stats = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.count(F.when(is_query, 1))).first()
    result = "query_id long, vec_id long, score long"
    if not stats[0] or not stats[3]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, norm2 = stats[1], stats[2]
    p = pivots(rows, n_pivots, dim)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _raised_distance(matrix(b.column("v"), dim), p, norm2)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), b.column("vec_id"), b.column("v")], ["pivot", "distance", "vec_id", "v"])

    def pack(t: pa.Table) -> list:
        d = t.column("distance").to_numpy()
        ids = t.column("vec_id").to_numpy().astype("<i8").tobytes()
        return [t.column("pivot")[0].as_py(), float(d.min()), float(d.max()), ids, matrix(t.column("v").chunk(0), dim).astype("<f8").tobytes()]

    placed = rows.mapInArrow(key, "pivot int, distance double, vec_id long, v array<double>")
    names = ["block", "pivot", "low", "high", "ids", "vecs"]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
    index = saved(blocks(placed, rows_in_block, pack, "block long, pivot int, low double, high double, ids binary, vecs binary", names, kinds))

    groups, salts = -(-stats[3] // queries_in_task), -(-index.count() // blocks_in_task)
    asked = rows.where(is_query).select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("g"))
    asked = asked.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    annuli = index.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(salts))).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def search(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if own.empty or found.empty:
            return empty
        q = np.zeros((len(own), dim))
        for i, v in enumerate(own.v):
            q[i, : len(v)] = v
        q_ids = own.vec_id.to_numpy()
        q2, to_pivot = (q * q).sum(1), _query_distance(q, p, norm2)
        # pivots are vectors of the table: leaving out the best, which may be the query itself, their k-th is a floor
        among = np.sort(q @ p.T, axis=1)[:, ::-1]
        floor = among[:, k] if among.shape[1] > k else np.full(len(q), -np.inf)
        best_score, best_id = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        d = to_pivot[:, found["pivot"].to_numpy()]
        gap = np.maximum(0, np.maximum(d - found["high"].to_numpy(), found["low"].to_numpy() - d))
        most = (q2[:, None] + norm2 - gap * gap) / 2
        most += 1e-9 * (q2[:, None] + norm2) + 0.5
        for b in np.argsort(-most.max(0), kind="stable"):
            open_ = np.flatnonzero(most[:, b] >= np.maximum(floor, best_score[:, -1]))
            if not len(open_):
                continue
            ids, x = np.frombuffer(found.ids.iat[b], "<i8"), np.frombuffer(found.vecs.iat[b], "<f8").reshape(-1, dim)
            score = q[open_] @ x.T
            score[q_ids[open_][:, None] == ids[None, :]] = -np.inf
            all_scores = np.concatenate([best_score[open_], score], 1)
            all_ids = np.concatenate([best_id[open_], np.broadcast_to(ids, score.shape)], 1)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best_score[open_] = np.take_along_axis(all_scores, order, 1)
            best_id[open_] = np.take_along_axis(all_ids, order, 1)
        real = best_score > -np.inf
        return pd.DataFrame({"query_id": np.repeat(q_ids, k)[real.ravel()], "vec_id": best_id[real], "score": best_score[real].astype(np.int64)})

    met = asked.groupBy("g", "s").cogroup(annuli.groupBy("g", "s")).applyInPandas(search, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
