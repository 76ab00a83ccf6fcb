"""Hard-negative mining (operator 12): segment summaries bound scores; only what the bounds leave open is scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgrid.llm.common import saved, table
from newsgrid.llm.vectors import blocks, matrix, pivots, usable

#: Segments a vector is cut into, level by level; each level cuts the segments of the one before.
LEVELS = (1, 4, 16)
_COLUMN = 11  # bits of a row's place in its block, below the score in one number
_NONE = np.iinfo(np.int64).min


def edges(dim: int) -> list[np.ndarray]:
    """First components of the segments of each level, and dim."""
    return [np.unique(np.arange(n + 1) * dim // n) for n in LEVELS]


def summaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the mean and the deviation of each segment of each row, both times the root of its length.

    The inner product of two segments is that of their means plus that of what deviates from them, which lies between
    minus and plus the product of the deviations.
    """
    out = []
    for at in edges(x.shape[1]):
        length = np.diff(at)
        mean = np.add.reduceat(x, at[:-1], axis=1) / length
        rest = x - np.repeat(mean, length, axis=1)
        out.append((mean * np.sqrt(length), np.sqrt(np.add.reduceat(rest * rest, at[:-1], axis=1))))
    return out


def _slack(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """More than rounding can add to a bound."""
    return 1e-9 * np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) + 0.5


def open_scores(x: np.ndarray, of_x: list, y: np.ndarray, of_y: list, is_open: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of y that may matter, and their exact inner products with all rows of x.

    is_open(lower, upper) tells which pairs bounds of the scores leave open; a row of y with no open pair goes, level by
    level.
    """
    left = np.arange(len(y))
    slack = _slack(x, y)
    for (mean_x, dev_x), (mean_y, dev_y) in zip(of_x, of_y):
        middle, reach = mean_x @ mean_y[left].T, dev_x @ dev_y[left].T + slack[:, left]
        left = left[is_open(middle - reach, middle + reach).any(0)]
        if not len(left):
            break
    return left, x @ y[left].T


def merged(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best (scores, ids), k a row by descending score and ascending id, with the allowed of scores merged in; ids ascend."""
    old, old_ids = best
    k, width = old.shape[1], scores.shape[1]
    mask = (1 << _COLUMN) - 1
    keys = np.where(allowed, (scores.astype(np.int64) << _COLUMN) | (mask - np.arange(width)), _NONE)
    if width > k:
        keys = np.partition(keys, width - k, axis=1)[:, width - k :]
    none = keys == _NONE
    new = np.where(none, _NONE, keys >> _COLUMN)
    new_ids = np.where(none, np.iinfo(np.int64).max, ids[np.where(none, 0, mask - (keys & mask))])
    all_scores, all_ids = np.concatenate([old, new], 1), np.concatenate([old_ids, new_ids], 1)
    # the negative of _NONE is itself
    order = np.lexsort((all_ids, -np.maximum(all_scores, _NONE + 1)), axis=1)[:, :k]
    return np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)


def _nothing(rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((rows, k), _NONE), np.full((rows, k), np.iinfo(np.int64).max)


def _box_bounds(one: pd.DataFrame, two: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all scores between a group of one and a group of two, by the ranges of their summaries."""
    a_low, a_high, a_dev = (np.stack(one[c].tolist())[:, None, :] for c in ("low", "high", "dev"))
    b_low, b_high, b_dev = (np.stack(two[c].tolist())[None, :, :] for c in ("low", "high", "dev"))
    corners = np.stack([a_low * b_low, a_low * b_high, a_high * b_low, a_high * b_high])
    reach = a_dev * b_dev
    slack = 1e-9 * np.outer(one.norm, two.norm) + 0.5
    return (corners.min(0) - reach).sum(2) - slack, (corners.max(0) + reach).sum(2) + slack


class _Index:
    """Blocks of rows of one label, near ones together, with the summaries of each row and the ranges of these."""

    KINDS = {"label": pa.int64(), "rows": pa.int64(), "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64()), "dev": pa.list_(pa.float64()), "norm": pa.float64(), "ids": pa.binary(), "vecs": pa.binary(), "sums": pa.binary()}
    SCHEMA = "block long, label long, rows long, low array<double>, high array<double>, dev array<double>, norm double, ids binary, vecs binary, sums binary"

    def __init__(self, dim: int):
        self.dim, self.sizes = dim, [len(e) - 1 for e in edges(dim)]

    def pack(self, t: pa.Table) -> list:
        t = t.sort_by("vec_id").combine_chunks()
        x = matrix(t.column("v").chunk(0), self.dim)
        sums = summaries(x)
        mean, dev = sums[-1]
        flat = np.concatenate([part for pair in sums for part in pair], axis=1)
        ids = t.column("vec_id").to_numpy().astype("<i8").tobytes()
        return [t.column("pivot")[0].as_py(), len(x), mean.min(0).tolist(), mean.max(0).tolist(), dev.max(0).tolist(), float(np.linalg.norm(x, axis=1).max()), ids, x.astype("<f8").tobytes(), flat.astype("<f8").tobytes()]

    def unpack(self, row) -> tuple[np.ndarray, np.ndarray, list]:
        """Ids, vectors and summaries of a block."""
        ids, x = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.vecs, "<f8").reshape(-1, self.dim)
        parts = np.split(np.frombuffer(row.sums, "<f8").reshape(len(ids), -1), np.cumsum(np.repeat(self.sizes, 2))[:-1], axis=1)
        return ids, x, list(zip(parts[::2], parts[1::2]))

    def build(self, placed: DataFrame, rows_in_block: int, more: dict | None = None, pack_more=lambda t: []) -> DataFrame:
        """more: kinds of further columns of the result, filled by pack_more from the rows sorted by vec_id."""
        kinds = {**self.KINDS, **{name: kind for name, (kind, _) in (more or {}).items()}}
        schema = ", ".join([self.SCHEMA, *(f"{name} {sql}" for name, (_, sql) in (more or {}).items())])
        pack = lambda t: [*self.pack(t), *pack_more(t.sort_by("vec_id").combine_chunks())]
        return saved(blocks(placed, rows_in_block, pack, schema, ["block", *kinds], [pa.int64(), *kinds.values()]))


_BOX = ["label", "rows", "low", "high", "dev", "norm"]


def _grouped(df: DataFrame, name: str, size: int) -> tuple[DataFrame, Column]:
    """df with its blocks dealt to groups: neighbouring blocks, about `size` of them, share one. And all groups."""
    groups = df.count() // size + 1
    near = F.shiftright("block", 32) * (1 << 32) + F.floor((F.col("block") % (1 << 32)) / size)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    return df.withColumn(name, F.pmod(F.xxhash64(near), F.lit(groups))), every


def _tasks(tiles: DataFrame, index: DataFrame, tiles_in_task: int, blocks_in_task: int, reach: Callable, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """tiles and index, each row as often as there are tasks (g, s) that it has to go to, tiles with a floor.

    First the ranges of summaries alone meet, all groups of tiles and all groups of blocks: reach takes the tiles of one g
    and the blocks of one s and returns, for each tile, a score that it is known to need (floor) and the highest bound of
    the scores there (most). A pair whose highest bound is below the floor found anywhere moves no vectors.
    """
    tiles, every_g = _grouped(tiles, "g", tiles_in_task)
    index, every_s = _grouped(index, "s", blocks_in_task)
    one = tiles.select("block", "g", *_BOX, *more).withColumn("s", every_s)
    two = index.select("block", "s", *_BOX).withColumn("g", every_g)
    reached = one.groupBy("g", "s").cogroup(two.groupBy("g", "s")).applyInPandas(reach, "block long, g long, s long, floor double, most double")
    floor = reached.groupBy("block").agg(F.max("floor").alias("floor"))
    met = saved(reached.drop("floor").join(floor, "block").where("most >= floor"))
    return tiles.join(met.select("block", "s", "floor"), "block"), index.join(met.select("g", "s").distinct(), "s")


def _reach(open_: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], np.ndarray], need: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For _tasks. open_ tells which pairs may meet at all; need: how many rows have to have a score for it to be a floor,
    or 0 for no floors."""

    def reach(tiles: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if tiles.empty or index.empty:
            return pd.DataFrame({"block": [], "g": [], "s": [], "floor": [], "most": []}).astype({"block": "int64", "g": "int64", "s": "int64", "floor": "float64", "most": "float64"})
        lower, upper = _box_bounds(tiles, index)
        may = open_(tiles, index, lower, upper)
        floor = np.full(len(tiles), -np.inf)
        if need:
            lower = np.where(may, lower, -np.inf)
            order = np.argsort(-lower, axis=1, kind="stable")
            held = np.cumsum(np.take_along_axis(np.where(may, index["rows"].to_numpy()[None, :], 0), order, 1), axis=1) >= need
            at = held.argmax(1)
            enough = held.any(1)
            floor[enough] = lower[np.arange(len(tiles)), np.take_along_axis(order, at[:, None], 1)[:, 0]][enough]
        out = pd.DataFrame({"block": tiles.block, "g": tiles.g, "s": tiles.s, "floor": floor, "most": np.where(may, upper, -np.inf).max(1)})
        return out[may.any(1)]

    return reach


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    n_pivots: int = 32,
    rows_in_block: int = 512,
    anchors_in_tile: int = 256,
    tiles_in_task: int = 16,
    blocks_in_task: int = 32,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    vectors: (vec_id, embedding array<float>, label int); is_anchor picks the anchors, label takes the place of the column.
    Components become floor(256 * x), a score is the integer inner product with the anchor. An anchor's positives are its
    first `positives` other rows of its label, by descending score and ascending vec_id; a positive's negatives are the
    first `negatives` rows of other labels whose score is at most its own and at least `percent` of it.

    Vectors that are null or empty or hold null or non-finite components, null ids and null labels take no part; shorter
    vectors count as padded with zeros; rows that repeat an id count once (the smallest vector and label). Anchors with no
    positive, and positives with no negative, have no rows; no vectors give no rows. Scores are exact below 2 ** 51.

    Index: rows sorted by label, nearest pivot and distance are cut into blocks of up to rows_in_block, each with the mean
    and deviation of every segment of every row, at three levels, and the ranges of these. Only the pivots are a sample,
    and they only set the order. Search, twice, for positives and for negatives: ranges of summaries decide which blocks
    go to which anchors; there, bounds by ever finer segments leave rows to score. A task holds about tiles_in_task tiles
    of anchors and blocks_in_task blocks, and returns only the first few rows of each anchor.
    """
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not 0 < rows_in_block <= 1 << _COLUMN:
        raise ValueError(f"a block has at most {1 << _COLUMN} rows")
    ints = F.transform("v", lambda x: F.floor(x * 256).cast("double"))
    kind = (F.col("label") if label is None else label).cast("long")
    rows = usable(vectors, kind.alias("label")).where("label IS NOT NULL").select("vec_id", F.struct(ints.alias("v"), "label").alias("row"))
    rows = saved(rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*"))
    number, dim, anchors = rows.agg(F.count("*"), F.max(F.size("v")), F.count(F.when(is_anchor, 1))).first()
    if not number or not anchors:
        return spark.createDataFrame([], result)
    p = pivots(rows, n_pivots, dim)
    shape = _Index(dim)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), dim)
            d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T)))
            near = d.argmin(1)
            at = d[np.arange(len(d)), near]
            # one number sorts by pivot, then by distance
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(near + at / (1 + at)), b.column("vec_id"), b.column("v"), b.column("anchor")], ["pivot", "distance", "vec_id", "v", "anchor"])

    keyed = rows.withColumn("anchor", is_anchor)
    placed = saved(keyed.select("label", "vec_id", "v", "anchor").mapInArrow(key, "pivot long, distance double, vec_id long, v array<double>, anchor boolean"))
    index = shape.build(placed.drop("anchor"), rows_in_block)
    asking = placed.where("anchor").drop("anchor")

    same = lambda one, two, lower, upper: one.label.to_numpy()[:, None] == two.label.to_numpy()[None, :]
    tiles, own = _tasks(shape.build(asking, anchors_in_tile), index, tiles_in_task, blocks_in_task, _reach(same, positives + 1), [])

    def find_positives(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []}, dtype="int64")]
        for tile in asked.itertuples() if len(held) else ():
            ids, x, of_x = shape.unpack(tile)
            best = _nothing(len(ids), positives)
            found = held[held.label == tile.label]
            most = _box_bounds(pd.DataFrame([tile]), found)[1][0] if len(found) else []
            for b in np.argsort(-np.asarray(most), kind="stable"):
                floor = np.maximum(best[0][:, -1].astype(float), tile.floor)
                if most[b] < floor.min():
                    break
                y_ids, y, of_y = shape.unpack(found.iloc[b])
                left, scores = open_scores(x, of_x, y, of_y, lambda lower, upper: upper >= floor[:, None])
                if len(left):
                    best = merged(best, scores, ids[:, None] != y_ids[left][None, :], y_ids[left])
            real = best[0] != _NONE
            out.append(pd.DataFrame({"anchor_id": np.repeat(ids, real.sum(1)), "positive_id": best[1][real], "positive_score": best[0][real]}))
        return pd.concat(out)

    near = tiles.groupBy("g", "s").cogroup(own.groupBy("g", "s")).applyInPandas(find_positives, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    # a positive below zero has no negatives: percent of it is above it
    pairs = F.struct("positive_score", "positive_id")
    near = near.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(pairs).alias("near"))
    asking = saved(asking.join(near, "vec_id"))

    def pack_more(t: pa.Table) -> list:
        pairs = [[(x["positive_score"], x["positive_id"]) for x in r] for r in t.column("near").to_pylist()]
        flat = np.full((len(pairs), positives, 2), _NONE)
        for i, r in enumerate(pairs):
            flat[i, : len(r)] = r
        found = [s for r in pairs for s, _ in r]
        return [-(-min(found) * percent // 100), max(found), flat.astype("<i8").tobytes()]

    more = {"least": (pa.int64(), "long"), "highest": (pa.int64(), "long"), "near": (pa.binary(), "binary")}
    other = lambda one, two, lower, upper: (one.label.to_numpy()[:, None] != two.label.to_numpy()[None, :]) & (upper >= one.least.to_numpy()[:, None]) & (lower <= one.highest.to_numpy()[:, None])
    tiles, own = _tasks(shape.build(asking, anchors_in_tile, more, pack_more), index, tiles_in_task, blocks_in_task, _reach(other, 0), ["least", "highest"])

    def find_negatives(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")}, dtype="int64")]
        for tile in asked.itertuples() if len(held) else ():
            ids, x, of_x = shape.unpack(tile)
            pairs = np.frombuffer(tile.near, "<i8").reshape(len(ids), positives, 2)
            top = np.where(pairs[..., 0] == _NONE, -np.inf, pairs[..., 0])
            least = np.where(pairs[..., 0] == _NONE, np.inf, -(-pairs[..., 0] * percent // 100))
            best = [_nothing(len(ids), negatives) for _ in range(positives)]
            found = held[held.label != tile.label]
            low, high = (z[0] for z in _box_bounds(pd.DataFrame([tile]), found)) if len(found) else ([], [])
            for b in np.argsort(-np.asarray(high), kind="stable"):
                if low[b] > tile.highest or high[b] < tile.least:
                    continue
                need = [np.maximum(least[:, j], best[j][0][:, -1]) for j in range(positives)]
                may = lambda lower, upper: np.logical_or.reduce([(upper >= need[j][:, None]) & (lower <= top[:, j, None]) for j in range(positives)])  # noqa: B023, E731
                y_ids, y, of_y = shape.unpack(found.iloc[b])
                left, scores = open_scores(x, of_x, y, of_y, may)
                for j in range(positives) if len(left) else ():
                    allowed = (scores <= top[:, j, None]) & (scores >= need[j][:, None])
                    if allowed.any():
                        best[j] = merged(best[j], scores, allowed, y_ids[left])
            for j, (scores, found_ids) in enumerate(best):
                real = scores != _NONE
                many = real.sum(1)
                out.append(pd.DataFrame({"anchor_id": np.repeat(ids, many), "positive_id": np.repeat(pairs[:, j, 1], many), "negative_id": found_ids[real], "positive_score": np.repeat(pairs[:, j, 0], many), "negative_score": scores[real]}))
        return pd.concat(out)

    far = tiles.groupBy("g", "s").cogroup(own.groupBy("g", "s")).applyInPandas(find_negatives, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE_SQL = """
WITH usable AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM usable a JOIN usable o ON a.vec_id <> o.vec_id
  WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negative AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positive p JOIN scored s USING (anchor_id)
  WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""
