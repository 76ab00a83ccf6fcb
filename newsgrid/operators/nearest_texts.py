"""Nearest texts by words: sparse weighted vectors, inverted lists, and bounds of each word that keep frequent words' lists
out of the search."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrid.sources.stored import stored

#: A unit vector's length in whole numbers; products and sums are exact longs.
UNIT = 1_000_000

_WORD = re.compile("[a-z0-9]+")


def _counts(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return texts.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).where("id IS NOT NULL").groupBy("id", "term").agg(F.count("*").alias("tf"))


def _weighted(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, term, w): (1 + ln tf) * ln(1 + N / df), in thousandths, scaled to length UNIT. Words no text has do not count."""
    raw = F.round(1000 * (1 + F.log(F.col("tf").cast("double"))) * F.col("idf")).cast("long")
    rows = counts.join(stats.select("term", "idf"), "term").select("id", "term", raw.alias("raw"))
    norms = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw")).cast("double")).alias("norm"))
    return rows.join(norms, "id").select("id", "term", F.floor(UNIT * F.col("raw") / F.col("norm")).cast("long").alias("w")).where("w > 0")


def words(texts: DataFrame, text: str = "text") -> DataFrame:
    """(term): the distinct words of texts."""
    return _counts(texts.select(F.lit(0).alias("id"), text), "id", text).select("term")


def _whole(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, text), in lower case, one row an id: texts of rows that repeat an id follow each other, a blank apart."""
    rows = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text)).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    twice = stored(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if not twice.head(1):
        return rows
    joined = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    return rows.join(twice, "id", "left_anti").unionByName(joined)


def _holders(texts: DataFrame, most: int = 1 << 18) -> DataFrame:
    """(term, n): how many texts hold each word; the empty word counts the texts with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])
        for b in batches:
            for t in b.column("text").to_pylist():
                own = set(_WORD.findall(t))
                if own:
                    held.update(own)
                    held[""] += 1
                if len(held) > most:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


_BAG = pa.schema([("id", pa.int64()), ("part", pa.int64()), ("terms", pa.list_(pa.string())), ("raws", pa.list_(pa.int64())), ("others", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])


def _bags(texts: DataFrame, known: dict[str, tuple[float, bool]]) -> DataFrame:
    """Of each text the sum of squares of its known words' weights (part), those of them that are wanted with their weights,
    and its other words with their number. known: rarity and whether wanted."""
    absent = (math.nan, False)

    def lists_of(values: list, where: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
        at = np.flatnonzero(where)
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows[at], minlength=n))]).astype(np.int32)
        picked = values[at] if isinstance(values, np.ndarray) else [values[i] for i in at.tolist()]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(picked, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                b = whole.slice(begin, 500)
                bags = [Counter(_WORD.findall(t)) for t in b.column("text").to_pylist()]
                rows = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
                terms = list(chain.from_iterable(bags))
                tfs = np.array(list(chain.from_iterable(x.values() for x in bags)), np.int64)
                told = [known.get(t, absent) for t in terms]
                idf, wanted = np.array([x[0] for x in told], float), np.array([x[1] for x in told], bool)
                some, place = np.unique(tfs, return_inverse=True)
                raw = 1000 * (1 + np.array([math.log(x) for x in some.tolist()], float)[place]) * idf
                met = ~np.isnan(idf)
                raw = np.where(met, raw, 0)
                low = np.floor(raw)
                raw = low.astype(np.int64) + (raw - low >= 0.5)  # half up, as round does
                part = np.zeros(len(bags), np.int64)
                np.add.at(part, rows, raw * raw)
                n = len(bags)
                lists = [lists_of(terms, wanted, rows, n, pa.string()), lists_of(raw, wanted, rows, n, pa.int64()), lists_of(terms, ~met, rows, n, pa.string()), lists_of(tfs, ~met, rows, n, pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array(part), *lists], schema=_BAG)

    return texts.mapInArrow(run, "id long, part long, terms array<string>, raws array<long>, others array<string>, tfs array<long>")


def lists(texts: DataFrame, id_col: str = "id", text: str = "text", wanted: DataFrame | None = None, frequent: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(id, term, w) of texts, and (term, idf, n, most): how rare each word is, how many texts hold it, and its largest weight
    in any text.

    Texts that are null or have no word are in no list; rows that repeat an id (a whole number) are one text, words of all of
    them. Where wanted (term) is given, only its words have lists; lengths are of all words all the same.

    Texts are split into words in the tasks, twice: once to count the texts that hold each word, once to weigh them. The
    `frequent` most frequent words are weighed at once, by a table that goes to all tasks; only the others meet their
    counts by a join, and only their rows and one row a text are shuffled.
    """
    rows = _whole(texts, id_col, text)
    held = stored(_holders(rows))
    number = held.where("term = ''").agg(F.sum("n")).first()[0] or 0
    stats = held.where("term <> ''").select("term", "n", F.log(1 + F.lit(number) / F.col("n")).alias("idf"))
    if wanted is None:
        stats = stats.withColumn("wanted", F.lit(True))
    else:
        stats = stats.join(wanted.select("term").distinct().withColumn("wanted", F.lit(True)), "term", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    stats = stored(stats)
    top = stats.orderBy(F.desc("n"), "term").limit(frequent).select("term", "idf", "wanted").toPandas()
    bags = stored(_bags(rows, dict(zip(top.term, zip(top.idf.tolist(), top.wanted.tolist())))))
    raw = F.round(1000 * (1 + F.log(F.col("x.tfs").cast("double"))) * F.col("idf")).cast("long").alias("raw")
    rare = bags.select("id", F.explode(F.arrays_zip("others", "tfs")).alias("x")).select("id", F.col("x.others").alias("term"), "x")
    rare = rare.join(stats, "term").select("id", "term", raw, "wanted")
    asked = F.collect_list(F.when(F.col("wanted"), F.struct("term", "raw"))).alias("asked")
    rare = rare.groupBy("id").agg(F.sum(F.col("raw") * F.col("raw")).alias("more"), asked)
    each = F.concat(F.zip_with("terms", "raws", lambda t, r: F.struct(t.alias("term"), r.alias("raw"))), F.coalesce("asked", F.array().cast("array<struct<term:string,raw:bigint>>")))
    norm = F.sqrt((F.col("part") + F.coalesce("more", F.lit(0))).cast("double"))
    weights = bags.join(rare, "id", "left").select("id", norm.alias("norm"), F.explode(each).alias("x"))
    weights = stored(weights.select("id", "x.term", F.floor(UNIT * F.col("x.raw") / F.col("norm")).cast("long").alias("w")).where("w > 0"))
    return weights, stored(stats.where("wanted").select("term", "idf", "n").join(weights.groupBy("term").agg(F.max("w").alias("most")), "term"))


def _first(rows: DataFrame, by: str, order: list[Column | str], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def nearest_texts(queries: DataFrame, weights: DataFrame, stats: DataFrame, k: int, id_col: str = "query_id", text: str = "text", rarest: int = 8) -> DataFrame:
    """(query_id, rank, id, score): the k texts most like each query by cosine, of equal ones the smaller ids; only texts that
    share a word. weights and stats: of lists. Scores are whole, UNIT ** 2 for equal directions.

    First, queries meet the k heaviest texts of each of their words, and all texts of those of their `rarest` rarest words that
    fewer than one text in a thousand holds. The texts that share most of these with a query are scored in full, and the k-th
    of their scores is a floor. A word's own bound is its weight in the query times its largest weight in a text. The words
    with the smallest bounds, as long as their sum stays below half the floor, cannot lift a text above it alone: their lists,
    those of frequent words, bring no candidates. The lists of the others give partial sums; where these and the small
    bounds together reach the floor, the small words' weights are looked up: so only for texts whose partial sum is over
    half the floor. No text that belongs among the k is lost.
    """
    asked = _weighted(_counts(queries, id_col, text), stats).select(F.col("id").alias("query_id"), "term", F.col("w").alias("q"))
    # a word in no list is in no text at all
    asked = stored(asked.join(stats.select("term", "most", "n"), "term").withColumn("bound", F.col("q") * F.col("most")))
    heavy = _first(weights, "term", [F.desc("w"), "id"], k).select("id", "term", "w")
    product = F.sum(F.col("q") * F.col("w"))
    least = stats.agg((F.coalesce(F.max("n"), F.lit(0)) / 1000 + 100).alias("few"))
    rare = _first(asked, "query_id", ["n", "term"], rarest).crossJoin(least).where("n <= few").select("query_id", "term", "q")
    likely = lambda lists_, asks: _first(asks.join(lists_, "term").groupBy("query_id", "id").agg(product.alias("low")), "query_id", [F.desc("low"), "id"], 2 * k).select("query_id", "id")
    tried = stored(likely(heavy, asked).unionByName(likely(weights, rare)).distinct())
    known = weights.join(tried.select("id").distinct(), "id", "left_semi")
    low = tried.join(asked.select("query_id", "term", "q"), "query_id").join(known, ["id", "term"]).groupBy("query_id", "id").agg(product.alias("low"))
    floors = _first(low, "query_id", [F.desc("low")], k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).otherwise(0).alias("floor"))

    upward = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # floors have every query that can have an answer
    asked = asked.join(floors, "query_id").withColumn("below", F.sum("bound").over(upward))
    asked = stored(asked.withColumn("small", 2 * F.col("below") < F.col("floor")))
    rest = asked.groupBy("query_id", "floor").agg(F.coalesce(F.max(F.when(F.col("small"), F.col("below"))), F.lit(0)).alias("rest"))

    part = asked.where("NOT small").join(weights, "term").groupBy("query_id", "id").agg(product.alias("part"))
    open_ = part.join(rest, "query_id").where(F.col("part") + F.col("rest") >= F.col("floor")).select("query_id", "id", "part")
    more = open_.select("query_id", "id").join(asked.where("small").select("query_id", "term", "q"), "query_id").join(weights, ["id", "term"])
    more = more.groupBy("query_id", "id").agg(product.alias("more"))
    scored = open_.join(more, ["query_id", "id"], "left").withColumn("score", F.col("part") + F.coalesce("more", F.lit(0)))
    return _first(scored, "query_id", [F.desc("score"), "id"], k).select("query_id", "rank", "id", "score")
