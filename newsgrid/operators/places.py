"""Places in texts: all names of a dictionary of any size, met on their first words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrid.sources.stored import stored

#: A word, or what stands between two words.
_PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
_WORD = r"^[\p{L}\p{N}_]"
#: Up to this many first words go to the tasks as a set.
_FEW = 4096


def pieces(text: Column) -> Column:
    """Words and what stands between them, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(_PIECE), 0)


def name_index(names: DataFrame, column: str = "name") -> DataFrame:
    """(first, key, name, n): each name under its first word, with the number of its pieces; all but name in lower case.

    Names are trimmed; those that do not begin and end with a word cannot be told from their neighbours and are left out.
    Of names that differ in case only, the smallest is kept.
    """
    trimmed = names.select(F.trim(column).alias("name")).where(F.col("name").rlike(_WORD) & F.reverse("name").rlike(_WORD))
    one = trimmed.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"))
    return one.select(pieces(F.col("key"))[0].alias("first"), "key", "name", F.size(pieces(F.col("key"))).alias("n"))


def mentions(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, at, name): all names of the index at all places of the texts; at is the number of the piece it begins with.

    Case does not count, words are whole, and what stands between the words of a name has to be the same. Texts become
    their words, each with as many pieces after it as the longest name has; they meet names by equality of the first word.
    Where names begin with few different words, no other words are taken from the texts. Catalyst broadcasts a small index,
    and shuffles by first word where it is large.
    """
    index = stored(index)
    longest = index.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if not longest:
        return docs.select(F.col(id_col).alias("id"), F.lit(0).alias("at"), F.lit("").alias("name")).limit(0)
    firsts = [r["first"] for r in index.select("first").distinct().limit(_FEW + 1).collect()]
    begins = lambda x: x.isin(firsts) if len(firsts) <= _FEW else x.rlike(_WORD)
    rows = docs.select(F.col(id_col).alias("id"), pieces(F.lower(text)).alias("pieces"))
    places = F.filter(F.transform("pieces", lambda x, i: F.struct(i.alias("at"), x.alias("first"))), lambda x: begins(x["first"]))
    near = F.transform(places, lambda x: F.struct(x["at"].alias("at"), x["first"].alias("first"), F.slice("pieces", x["at"] + 1, longest).alias("near")))
    # outer: else the whole of near is computed once more in a filter on its size
    words = rows.select("id", F.inline_outer(near)).where("first IS NOT NULL")
    met = words.join(index, "first").where(F.array_join(F.slice("near", F.lit(1), F.col("n")), "") == F.col("key"))
    return met.select("id", "at", "name")


def first_place(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, place) of each row of docs: the name that comes first in its text, the longest where several begin there, null
    if there is none. Texts that are null or empty have none; rows that repeat an id have the first of all their names."""
    found = mentions(docs, name_index(names), id_col, text)
    best = found.groupBy("id").agg(F.min(F.struct("at", (-F.length("name")).alias("length"), "name"))["name"].alias("place"))
    return docs.select(F.col(id_col).alias("id")).join(best, "id", "left")
