"""Keyword search over an inverted index: bucketed postings, written once, appended to, and read by bucket."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of one posting share all bits but these.
BLOCK_BITS = 16


def words(*texts: str) -> Column:
    """Distinct runs of ASCII letters and digits of these columns, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit("[a-z0-9]+"), 0))


def postings(rows: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(token, block, n, places): which ids of a block of 2 ** 16 hold the token. A token of all rows is one row a block."""
    each = rows.select(F.col(id_col).cast("long").alias("id"), F.explode(tokens).alias("token")).where("id IS NOT NULL")
    block, place = F.shiftright("id", BLOCK_BITS), F.col("id").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    lists = each.groupBy("token", block.alias("block")).agg(F.array_sort(F.collect_set(place)).alias("places"))
    return lists.select("token", "block", F.size("places").alias("n"), "places")


def append(rows: DataFrame, index: str, id_col: str, tokens: Column, buckets: int = 64, parts: int = 4) -> None:
    """Add rows to the index, a table of the catalog, and make it if there is none. Rows added twice are found once.

    Postings go to `buckets` buckets by token; those of a frequent token are written by up to `parts` tasks.
    """
    dealt = postings(rows, id_col, tokens).repartition(buckets * parts, F.pmod(F.hash("token"), F.lit(buckets)), F.pmod("block", F.lit(parts)))
    dealt.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "token").sortBy("token", "block").mode("append").saveAsTable(index)


def frequencies(spark: SparkSession, index: str, wanted: list[str]) -> dict[str, int]:
    """How many ids hold each of a few words, from the counts alone of their buckets."""
    found = spark.table(index).where(F.col("token").isin(wanted)).groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in wanted} | {r.token: r.n for r in found}


def matching(spark: SparkSession, index: str, wanted: list[str]) -> DataFrame:
    """(id) of the rows that hold every wanted word (lower case); no words, no rows.

    The rarest word comes first: its postings say which blocks of the others are needed at all, and each further word
    only narrows them. Only the buckets of the words are read; lists of one block meet, never all ids of a word.
    """
    count = frequencies(spark, index, list(dict.fromkeys(wanted)))
    ordered = sorted(count, key=lambda w: (count[w], w))
    none = spark.createDataFrame([], "id long")
    if not ordered or not count[ordered[0]]:
        return none

    def of(word: str, name: str) -> DataFrame:
        rows = spark.table(index).where(F.col("token") == word)
        # several appends may have given a block several lists
        return rows.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias(name))

    def narrowed(left: DataFrame, word: str) -> DataFrame:
        both = left.join(of(word, "more"), "block").select("block", F.array_intersect("places", "more").alias("places"))
        return both.where(F.size("places") > 0)

    found = reduce(narrowed, ordered[1:], of(ordered[0], "places"))
    return found.select(F.explode(F.transform("places", lambda x: F.shiftleft("block", BLOCK_BITS) + x)).alias("id"))


def search(rows: DataFrame, index: str, wanted: list[str], id_col: str) -> DataFrame:
    """The rows that hold every wanted word, by the index over them."""
    found = matching(rows.sparkSession, index, wanted).withColumnRenamed("id", id_col)
    return rows.join(found, id_col, "left_semi")
