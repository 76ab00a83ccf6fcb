"""Ranked lexical search (operator 13): documents become bags over the items' words; equal bags are scored once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgrid.llm.common import saved, table

#: Bytes to bytes: A-Z in lower case, digits, letters and all bytes from 128 on as they are, a blank for everything else.
_WORD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def words_of(text: bytes, size: int = 1 << 22) -> Counter:
    """How often each word occurs in UTF-8 text. A long text is cut into words a piece at a time."""
    flat, counts, at = text.translate(_WORD), Counter(), 0
    while len(flat) - at > size:
        end = flat.find(b" ", at + size)
        if end < 0:
            break
        counts.update(flat[at:end].split())
        at = end
    counts.update(flat[at:].split())
    return counts


def _lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array([x for r in rows for x in r], np.int32)))


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms array<int>, tfs array<int>) of each row of docs (doc_id, text): number of words, and which of the
    vocabulary occur how often, by ascending number. One pass over whole texts, no shuffle; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, terms, tfs = [], [], []
            for text in b.column("text").to_pylist():
                counts = words_of(text or b"")
                own = sorted((vocabulary[w], c) for w, c in counts.items() if w in vocabulary)
                sizes.append(counts.total())
                terms.append([t for t, _ in own])
                tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), _lists(terms), _lists(tfs)], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def first_members(rows: DataFrame, keys: list[str], order: list, k: int, salts: int = 64) -> DataFrame:
    """The first k rows of each group. Parts of a group, dealt by a hash of doc_id, are cut to k first, so that a group with
    a third of all rows brings k rows a part to one task."""
    ranked = lambda df, by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    part = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    return ranked(ranked(part, [*keys, "salt"]).drop("salt", "rank"), keys)


def best_of_classes(classes: DataFrame, items: list[tuple[int | None, dict[int, int]]], weights: np.ndarray, k: int, cells: int = 4_000_000) -> DataFrame:
    """(item, item_id, doc_id, score): for each item the best k of each task's classes (m, terms, tfs, members), at least.

    items: id and how often each term occurs; item is the place in that list. A class is scored once, all its members have
    that score; at most `cells` scores are held at a time.
    """
    uses = sorted((t, i, c) for i, (_, own) in enumerate(items) for t, c in own.items())
    of_term, of_item, times = (np.array(x, np.int64) for x in zip(*uses)) if uses else (np.zeros(0, np.int64),) * 3
    starts = np.searchsorted(of_term, np.arange(len(weights) + 1))
    ids, number = [i for i, _ in items], len(items)

    def scores(m: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(m)), np.diff(ends))
        each = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[row]))
        many = starts[terms + 1] - starts[terms]
        last = np.cumsum(many)
        at = np.repeat(starts[terms] - (last - many), many) + np.arange(last[-1] if len(last) else 0)
        out = np.zeros(len(m) * number, np.int64)
        np.add.at(out, np.repeat(row, many) * number + of_item[at], np.repeat(each, many) * times[at])
        return out.reshape(len(m), number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, score, doc = (np.zeros(0, np.int64) for _ in range(3))
        floor = np.ones(number, np.int64)
        step = max(1, cells // number)
        for b in batches:
            for a in range(0, len(b), step):
                part = b.slice(a, step)
                m, terms, tfs, members = (part.column(c) for c in ("m", "terms", "tfs", "members"))
                ends, seats = np.asarray(terms.offsets, np.int64), np.asarray(members.offsets, np.int64)
                own = slice(ends[0], ends[-1])
                s = scores(np.asarray(m), ends, np.asarray(terms.values, np.int64)[own], np.asarray(tfs.values, np.int64)[np.asarray(tfs.offsets)[0] : np.asarray(tfs.offsets)[-1]])
                bar = np.maximum(floor, np.partition(s, -k, axis=0)[-k]) if len(s) > k else floor
                c, i = np.nonzero(s >= bar)
                many = (seats[1:] - seats[:-1])[c]
                last = np.cumsum(many)
                at = np.repeat(seats[c] - (last - many), many) + np.arange(last[-1] if len(last) else 0)
                item, score = np.concatenate([item, np.repeat(i, many)]), np.concatenate([score, np.repeat(s[c, i], many)])
                doc = np.concatenate([doc, np.asarray(members.values)[at]])
                order = np.lexsort((doc, -score, item))
                item, score, doc = item[order], score[order], doc[order]
                place = np.arange(len(item)) - np.searchsorted(item, item)
                kept = place < k
                full = place == k - 1
                floor[item[full]] = np.maximum(floor[item[full]], score[full])
                item, score, doc = item[kept], score[kept], doc[kept]
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array([ids[i] for i in item], pa.int64()), pa.array(doc), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    return classes.select("m", "terms", "tfs", "members").mapInArrow(run, "item int, item_id long, doc_id long, score long")


def _slice(docs: DataFrame, wanted: list[tuple[int | None, str]], k: int) -> DataFrame | None:
    """Rows (item_id, rank, doc_id, score) of some items."""
    counted = [(i, words_of(text.encode())) for i, text in wanted]
    vocabulary = {w: n for n, w in enumerate(sorted({w for _, own in counted for w in own}))}
    if not vocabulary:
        return None
    found = saved(bags(docs, vocabulary))
    total = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    if not total.words:
        return None
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = held.select("term", F.floor(1000 * F.log(F.lit(2 * total.docs + 2) / (2 * F.col("df") + 1))).alias("w")).collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in weighed:
        weights[r.term] = r.w
    items = [(i, {vocabulary[w]: c for w, c in own.items()}) for i, own in counted]

    m = F.lit(75).cast("long") + F.expr(f"(25 * n * {total.docs}L) div {total.words}L")
    own = found.where((F.size("terms") > 0) & F.col("doc_id").isNotNull()).withColumn("m", m).withColumn("hash", F.xxhash64("m", "terms", "tfs"))
    # grouping by the hash alone would join different bags; with the bag itself among the keys, equal hashes are verified
    keys = ["hash", "m", "terms", "tfs"]
    firsts = first_members(own.select(*keys, "doc_id"), keys, ["doc_id"], k)
    classes = firsts.groupBy(*keys).agg(F.sort_array(F.collect_list("doc_id")).alias("members"))
    best = best_of_classes(classes, items, weights, k)
    return first_members(best, ["item", "item_id"], [F.desc("score"), "doc_id"], k).select("item_id", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20, slice_bytes: int = 1 << 22) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id, text) the k best rows of docs (doc_id, text) with a
    score above 0, equal scores by ascending doc_id.

    Words are maximal runs of ASCII letters and digits and of all characters from U+0080 on; only A-Z are lower-cased. The
    score is that of the contract of op13; sums are 64-bit integers. Texts that are null have no words. Rows that repeat
    an id are documents, or items, of their own; a document whose id is null counts in all statistics but is not ranked.
    Other columns are ignored; without words in items or docs there are no rows.

    Items go in slices of about slice_bytes of text, the bound on what the driver and each task hold of them; a slice is
    one pass over docs. In it, documents become bags over the slice's words; bags that are equal, and whose lengths weigh
    the same, are one class, found by hash and verified by content; of a class only the k smallest ids can be ranked.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = size // slice_bytes + 1
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    wanted = ([tuple(r) for r in items.where(dealt == i).collect()] for i in range(slices))
    rows = [r for part in wanted if (r := _slice(docs, part, k)) is not None]
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
tf AS MATERIALIZED (SELECT row, term, COUNT(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
sizes AS (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS words FROM sizes),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, COUNT(*) AS df FROM tf GROUP BY term), total
), asked AS (
  SELECT item, item_id, term, COUNT(*) AS times
  FROM (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL)
  GROUP BY item, item_id, term
), scored AS (
  SELECT item, item_id, s.doc_id, s.row, CAST(SUM(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN sizes s USING (row), total
  WHERE s.doc_id IS NOT NULL
  GROUP BY item, item_id, s.doc_id, s.row
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
