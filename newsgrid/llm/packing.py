"""Packing (operator 3): non-negative least squares over length combinations that fill a window."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgrid.llm.common import maybe_among, saved, table
from newsgrid.llm.segments import WordEncoder, kept, vocabulary

PIECE = "doc_id long, text_hash long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def combinations(lengths: np.ndarray, weights: np.ndarray, window: int, depth: int, most: int) -> np.ndarray:
    """Rows of up to three lengths (0: unused) that sum to window.

    All pairs are tried; triples only among the `most` lengths with the largest weights, so that there are at most
    window / 2 + most ** 2 / 2 rows whatever the number of documents.
    """
    known = np.zeros(window + 1, bool)
    known[lengths] = True
    small = lengths[(lengths * 2 <= window)]
    pairs = small[known[window - small]]
    out = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1)]
    if depth >= 3:
        top = np.sort(lengths[np.argsort(-weights, kind="stable")[:most]])
        frequent = np.zeros(window + 1, bool)
        frequent[top] = True
        for i, a in enumerate(top):
            b = top[i:]
            c = window - a - b
            b = b[(c >= b) & frequent[np.clip(c, 0, window)]]
            if len(b):
                out.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(out)


def solve_counts(hist: np.ndarray, patterns: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Whole repeat counts x >= 0 with A x <= hist, near the least-squares solution of A x = hist.

    A has a column for each pattern. Accelerated projected gradient steps solve the relaxed problem; counts are rounded
    down, scaled back where they overdraw a length, then raised in the order of their fractions while lengths last.
    """
    if not len(patterns):
        return np.zeros(0, np.int64)
    size, weight = len(hist), hist.astype(float)
    weight[0] = 0
    used = patterns > 0

    def product(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for k in range(3):
            out += np.bincount(patterns[:, k], weights=x * used[:, k], minlength=size)
        return out

    def gradient(r: np.ndarray) -> np.ndarray:
        return sum(r[patterns[:, k]] * used[:, k] for k in range(3))

    x = y = np.zeros(len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):
        v = gradient(product(v))
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    step, t = 1 / (1.1 * norm), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * gradient(product(y) - weight))
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / u * (new - x), new, u
    over = product(x) / np.maximum(weight, 1e-9)
    share = np.ones(len(patterns))
    for k in range(3):
        share = np.where(used[:, k], np.minimum(share, 1 / np.maximum(over[patterns[:, k]], 1)), share)
    x = x * share
    counts = np.floor(x + 1e-9).astype(np.int64)
    left = hist - np.rint(product(counts)).astype(np.int64)
    left[0] = 0
    for p in np.argsort(-(x - counts), kind="stable"):
        parts = [int(a) for a in patterns[p] if a]
        more = min(left[a] // parts.count(a) for a in set(parts))
        if more > 0:
            counts[p] += more
            for a in parts:
                left[a] -= more
    return counts


def plan(hist: dict[int, int], window: int, depth: int = 3, most: int = 500) -> tuple[list[tuple], int, dict[int, int]]:
    """Slots (length, first, last, sequence, offset), the number of planned sequences, and pieces planned by length.

    hist: pieces by length, each length below window; so nothing here grows with the number of documents. The pieces
    first..last - 1 of a length go to the sequences sequence, sequence + 1, ..., each at offset.
    """
    counts = np.zeros(window + 1, np.int64)
    for a, n in hist.items():
        counts[a] = n
    lengths = np.flatnonzero(counts)
    patterns = combinations(lengths, counts[lengths] * lengths, window, depth, most) if len(lengths) else np.zeros((0, 3), np.int64)
    slots, sequence, taken = [], 0, {}
    for p, n in zip(patterns.tolist(), solve_counts(counts, patterns).tolist()):
        if n:
            offset = 0
            for a in p:
                if a:
                    at = taken.get(a, 0)
                    slots.append((a, at, at + n, sequence, offset))
                    taken[a] = at + n
                    offset += a
            sequence += n
    return slots, sequence, taken


def _encode(docs: DataFrame, vocab: str | None, end_id: int, window: int) -> DataFrame:
    """PIECE rows: each document cut at every window ids. part and nth number the pieces of a length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = kept(WordEncoder, vocab or vocabulary("word_bpe_49k.json")), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for b in batches:
            out: list[tuple] = []
            ids_of = encoder.encode([t or "" for t in b.column("text").to_pylist()])
            for doc, text_hash, ids in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), ids_of):
                ids = np.append(ids, end_id).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    out.append((doc, text_hash, at, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, int(seen[len(piece)])))
                    seen[len(piece)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 6 + [pa.int32(), pa.int64()])], [x.split()[0] for x in PIECE.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PIECE)


def _cut_again(docs: DataFrame, cuts: DataFrame, vocab: str | None, end_id: int, window: int) -> DataFrame:
    """(doc_id, text_hash, start, length, ids_crc32) of both halves of the pieces in cuts, by encoding those documents
    again. Equal rows may be cut at different places, so a piece is known by its start and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(WordEncoder, vocab or vocabulary("word_bpe_49k.json"))
        for b in batches:
            out = []
            keys = zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_hash", "start", "length", "first")))
            for (doc, text_hash, start, length, first), ids in zip(keys, encoder.encode([t or "" for t in b.column("text").to_pylist()])):
                ids = np.append(ids, end_id).astype("<u4")
                for a, z in ((start, start + first), (start + first, start + length)):
                    out.append((doc, text_hash, a, z - a, zlib.crc32(ids[a:z].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [x.split()[0] for x in half.split(", ")])

    half = "doc_id long, text_hash long, start long, length long, ids_crc32 long"
    wanted = saved(cuts.select(F.xxhash64("doc_id", "text_hash").alias("id"), "doc_id", "text_hash", "start", "length", "first").distinct())
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    # few documents are cut, so that few texts are shuffled
    rows = maybe_among(rows.withColumn("id", F.xxhash64("doc_id", "text_hash")), wanted)
    same = (rows["id"] == wanted["id"]) & rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["text_hash"] == wanted["text_hash"])
    met = rows.join(wanted, same).select(rows["doc_id"], rows["text_hash"], "text", "start", "length", "first")
    return met.mapInArrow(run, half).dropDuplicates(["doc_id", "text_hash", "start", "length"])


def pack(docs: DataFrame, window: int = 4096, vocab: str | None = None, end_id: int = 2) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) that fill sequences of window ids.

    Each document is its ids and end_id (a null or empty text: end_id alone). Full windows are sequences of their own.
    Of the rest, shorter than a window, only the histogram of lengths goes to the driver (below `window` rows). There,
    shallow combinations of lengths that fill a window are enumerated, and non-negative least squares gives how often to
    repeat each. Pieces left over are packed greedily: longest first, each fills the open sequence, and what does not
    fit is cut off and opens the next one, so that all sequences but the very last are full. Every id lies in one piece; offsets are gapless from 0 in each sequence.
    Repeated rows are packed as often as they come; an empty table gives no rows; other columns are ignored.

    No group of equal lengths meets in one task: a piece's number among those of its length is its number within its
    task, known from encoding, plus the counts of earlier tasks.
    """
    spark = docs.sparkSession
    pieces = saved(_encode(docs, vocab, end_id, window))
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    hist = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = hist.pop(window, 0)
    slots, planned, taken = plan(hist, window)
    base, at = {}, 0
    for a in sorted(hist, reverse=True):
        base[a] = at
        at += (hist[a] - taken.get(a, 0)) * a
    numbered = pieces.join(before, ["length", "part"]).withColumn("k", F.col("nth") + F.col("before"))

    # At most three slots a combination and one row a length: bounded by the window, not by the documents.
    slot_rows = spark.createDataFrame(slots or [(-1, 0, 0, 0, 0)], "length long, first_k long, last_k long, slot_sequence long, slot_offset long")
    length_rows = spark.createDataFrame([(a, taken.get(a, 0), base[a]) for a in hist] or [(-1, 0, 0)], "length long, taken long, base long")
    kind = F.when(F.col("length") == window, 0).when(F.col("k") < F.col("taken"), 1).otherwise(2)
    kinds = numbered.join(F.broadcast(length_rows), "length", "left").withColumn("kind", kind)
    keep = ["doc_id", "text_hash", "start", "length", "ids_crc32", "doc_tokens"]
    whole = kinds.where("kind = 0").select(*keep, F.col("k").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    in_slot = (F.col("k") >= F.col("first_k")) & (F.col("k") < F.col("last_k"))
    fitted = kinds.where("kind = 1").join(F.broadcast(slot_rows.withColumnRenamed("length", "slot_length")), (F.col("length") == F.col("slot_length")) & in_slot)
    fitted = fitted.select(*keep, (F.lit(full) + F.col("slot_sequence") + F.col("k") - F.col("first_k")).alias("sequence_id"), F.col("slot_offset").alias("offset"))

    place = F.col("base") + (F.col("k") - F.col("taken")) * F.col("length")
    rest = kinds.where("kind = 2").withColumn("place", place).withColumn("first", F.least("length", F.lit(window) - F.col("place") % window))
    rest = saved(rest.select(*keep, "place", "first"))
    row_of = lambda p: (F.lit(full + planned) + F.floor(p / window)).cast("long")
    uncut = rest.where("first = length").select(*keep, row_of(F.col("place")).alias("sequence_id"), (F.col("place") % window).alias("offset"))
    cuts = rest.where("first < length")
    halves = cuts.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "doc_id",
        "text_hash",
        F.when(F.col("half") == 0, F.col("start")).otherwise(F.col("start") + F.col("first")).alias("start"),
        F.when(F.col("half") == 0, F.col("first")).otherwise(F.col("length") - F.col("first")).alias("length"),
        "doc_tokens",
        row_of(F.when(F.col("half") == 0, F.col("place")).otherwise(F.col("place") + F.col("first"))).alias("sequence_id"),
        F.when(F.col("half") == 0, F.col("place") % window).otherwise(F.lit(0)).alias("offset"),
    )
    crc = _cut_again(docs, cuts, vocab, end_id, window).select(*(F.col(c).alias(f"crc_{c}") for c in ("doc_id", "text_hash", "start", "length")), "ids_crc32")
    same = halves["doc_id"].eqNullSafe(crc["crc_doc_id"]) & (halves["text_hash"] == crc["crc_text_hash"])
    same = same & (halves["start"] == crc["crc_start"]) & (halves["length"] == crc["crc_length"])
    halves = halves.join(crc, same).select(*keep, "sequence_id", "offset")
    return whole.unionByName(fitted).unionByName(uncut).unionByName(halves).drop("text_hash")


def sequences(docs: DataFrame, pieces: DataFrame, window: int = 4096, vocab: str | None = None, end_id: int = 2, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids padded to window) as training reads them: documents are encoded, cut as pieces say, and
    gathered by sequence. Rows that repeat a doc_id need the same text; each cut is then made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(WordEncoder, vocab or vocabulary("word_bpe_49k.json"))
        for b in batches:
            out = []
            for cuts, ids in zip(b.column("cuts").to_pylist(), encoder.encode([t or "" for t in b.column("text").to_pylist()])):
                ids = np.append(ids, end_id)
                out += [(c["sequence_id"], c["offset"], ids[c["start"] : c["start"] + c["length"]].tolist()) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int64(), pa.list_(pa.int32())])], ["sequence_id", "offset", "part_ids"])

    cuts = pieces.select(F.col("doc_id").alias("cut_doc"), F.struct("start", "length", "sequence_id", "offset").alias("cut"))
    cuts = cuts.groupBy("cut_doc").agg(F.collect_list("cut").alias("cuts"))
    texts = docs.select("doc_id", "text").dropDuplicates(["doc_id"])
    parts = texts.join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_doc"))).select("text", "cuts").mapInArrow(run, "sequence_id long, offset long, part_ids array<int>")
    rows = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part_ids"))), lambda x: x["part_ids"])).alias("ids"))
    padding = F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("ids"))
    return rows.select("sequence_id", F.size("ids").alias("n_ids"), F.concat("ids", padding).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
