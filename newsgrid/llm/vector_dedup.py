"""Embedding near-dedup (operator 9): int8 tile products with error bounds, full precision only where they leave doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrid.llm.common import connected_components, saved, table
from newsgrid.llm.vectors import blocks, matrix, pivots, usable


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows at norm 1: int8 components, their scales, and the norms of what is lost."""
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((unit - q * scale[:, None]) ** 2).sum(1))


def linked_pairs(a: tuple, b: tuple, same: bool, threshold: float, rows: int = 1024, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold between two tiles (q, scale, lost, v, norm); of one tile with itself, i < j.

    With u = û + r and w = ŵ + s, u·w - û·ŵ = r·w + û·s, so it is at most |r| + (1 + |r|) |s| for unit u and w. Pairs
    whose int8 product is below the threshold by more than that are done; the others are computed in doubles.
    """
    (qa, sa, ea, va, na), (qb, sb, eb, vb, nb) = a, b
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole products are exact in either
    right = qb.astype(kind).T
    for at in range(0, len(qa), rows):
        part = slice(at, at + rows)
        near = (qa[part].astype(kind) @ right) * (sa[part, None] * sb[None, :])
        near += ea[part, None] + (1 + ea[part, None]) * eb[None, :] + 1e-6
        i, j = np.nonzero(near >= threshold)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), most):
            x, y = i[k : k + most], j[k : k + most]
            cosine = np.einsum("ij,ij->i", va[x], vb[y]) / (na[x] * nb[y])
            good = cosine >= threshold
            yield x[good], y[good]


def roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each of n, over index pairs."""
    low = np.arange(n)
    while True:
        before = low.copy()
        for i, j in pairs:
            m = np.minimum(low[i], low[j])
            np.minimum.at(low, i, m)
            np.minimum.at(low, j, m)
        low = low[low]
        if (low == before).all():
            return low


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, n_pivots: int = 64, tile: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding array<float>).

    Two rows link when their cosine in doubles is at least threshold. Vectors that are null, empty, all zero or hold null
    or non-finite components, and rows without a vec_id, link with nothing. Shorter vectors count as padded with zeros.
    n_links: other rows linked directly; component_id: the smallest vec_id reachable; kept: vec_id = component_id. Rows
    that repeat a vector (or an id) all count and come out once each. An empty table gives no rows.

    Equal vectors are one class, whose pairs are never listed. Class representatives are sorted by nearest pivot and cut
    into tiles; tiles whose centres are too far apart for any link are not paired. A task multiplies two tiles as int8
    and sends back sums of links and, instead of all linked pairs, one edge from each linked vector to the smallest it
    reaches there: never more rows than the tiles hold.
    """
    spark = vectors.sparkSession
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    fit = usable(every).where(F.exists("v", lambda x: x != 0))
    classes = saved(fit.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")))
    stats = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not stats[0]:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = stats[1]
    p = pivots(classes, n_pivots, dim)
    p /= np.sqrt((p * p).sum(1))[:, None]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), dim)
            cosine = (v / np.sqrt((v * v).sum(1))[:, None]) @ p.T
            near = cosine.argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(-cosine[np.arange(len(v)), near]), b.column("vec_id"), b.column("n"), b.column("v")], ["pivot", "distance", "vec_id", "n", "v"])

    def pack(t: pa.Table) -> list:
        v = matrix(t.column("v").chunk(0), dim)
        unit = v / np.sqrt((v * v).sum(1))[:, None]
        centre = unit.sum(0)
        centre /= np.sqrt((centre * centre).sum()) or 1.0
        radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) if centre.any() else np.pi
        return [centre.tolist(), radius, t.column("vec_id").to_numpy().astype("<i8").tobytes(), t.column("n").to_numpy().astype("<i8").tobytes(), (v.astype("<f4") if (v.astype("<f4") == v).all() else v).tobytes()]

    placed = classes.mapInArrow(key, "pivot int, distance double, vec_id long, n long, v array<double>")
    names = ["block", "centre", "radius", "ids", "counts", "vecs"]
    kinds = [pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    # cells follow each other on one line, so that a tile is full even where cells are small
    line = placed.select(F.lit(0).alias("pivot"), (F.col("pivot") * 10 + F.col("distance")).alias("distance"), "vec_id", "n", "v")
    tiles = saved(blocks(line, tile, pack, "block long, centre array<double>, radius double, ids binary, counts binary, vecs binary", names, kinds))
    numbered = tiles.select("block", "centre", "radius")
    # few rows: one tile stands for up to `tile` vectors; each is told its possible partners by an equality join on a salt
    salts = 16
    left = numbered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = numbered.select(F.col("block").alias("other"), F.col("centre").alias("c2"), F.col("radius").alias("r2"), F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    dot = F.aggregate(F.zip_with("centre", "c2", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    reach = float(np.arccos(threshold)) + 1e-6
    close = (F.col("block") == F.col("other")) | (angle - F.col("radius") - F.col("r2") <= reach)
    pairs = saved(left.join(right, "salt").where(F.col("block") <= F.col("other")).where(close).select("block", "other"))
    cells = tiles.select("block", "ids", "counts", "vecs")
    two = pairs.join(cells, "block").join(cells.select(*(F.col(c).alias(f"{c}2") for c in cells.columns)), F.col("other") == F.col("block2"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(ids: bytes, counts: bytes, vecs: bytes) -> tuple:
            width = len(vecs) // (len(ids) // 8 * dim)
            v = np.frombuffer(vecs, f"<f{width}").reshape(-1, dim).astype(np.float64)
            return np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i8"), (*quantised(v), v, np.sqrt((v * v).sum(1)))

        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                same = row["block"] == row["other"]
                ids, counts, one = parts(row["ids"], row["counts"], row["vecs"])
                ids2, counts2, two_ = (ids, counts, one) if same else parts(row["ids2"], row["counts2"], row["vecs2"])
                shift = 0 if same else len(ids)
                all_ids = ids if same else np.concatenate([ids, ids2])
                links, pairs_ = np.zeros(len(all_ids), np.int64), []
                for i, j in linked_pairs(one, two_, same, threshold):
                    np.add.at(links, i, counts2[j])
                    np.add.at(links, j + shift, counts[i])
                    if len(i):
                        # of these pairs, edges to the smallest reached are all that later rounds need
                        low = roots(len(all_ids), [(i, j + shift)])
                        v = np.flatnonzero(low != np.arange(len(low)))
                        pairs_.append((v, low[v]))
                low = roots(len(all_ids), pairs_)
                touched = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(all_ids[touched]), pa.array(all_ids[low[touched]]), pa.array(links[touched])], ["a", "b", "n"])

    found = saved(two.mapInArrow(work, "a long, b long, n long"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    components = connected_components(found.select("a", "b")).withColumnRenamed("node", "rep")
    per_class = classes.select("v", F.col("vec_id").alias("rep"), "n").join(links, "rep", "left").join(components, "rep", "left")
    per_class = per_class.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    members = usable(every).join(per_class, "v").select("vec_id", "n_links", "component_id")
    rest = every.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    bad = ~F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    alone = rest.where(bad).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach(node, low) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node WHERE r.low < l.b
), lowest AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(w.component_id, e.vec_id) AS component_id,
       coalesce(e.vec_id = w.component_id, true) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN lowest w ON w.node = e.vec_id
"""
