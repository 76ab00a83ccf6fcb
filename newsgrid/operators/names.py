"""Place names under a collation: spellings that differ by case, accents or known damage mean one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrid.functions import constants as K
from newsgrid.functions import scalars as S

#: Letters compare without case and accents.
COLLATION = "UNICODE_CI_AI"


def alike(name: Column) -> Column:
    """name without outer blanks as a text that compares without case and accents; null stays null."""
    return F.collate(F.trim(name), COLLATION)


def raw_division(place: Column) -> Column:
    """The last part but one of a full place name, as it is stored; null without a comma."""
    return F.when(F.instr(place, ",") > 0, F.trim(F.substring_index(F.substring_index(place, ",", -2), ",", 1)))


def _names(spelling: Column) -> Column:
    """What people call a stored division: its spelling, the right name of a damaged one, and that name's part before " de "
    (not the bare word Estado)."""
    right = S.lookup(spelling, K.DAMAGED_DIVISIONS)
    short = F.substring_index(right, " de ", 1)
    return F.array_compact(F.array(spelling, right, F.when(short != "Estado", short)))


def stored_spellings(terms: DataFrame, places: DataFrame) -> DataFrame:
    """(term, spelling): the division spellings of places (ActionGeo_FullName) that each of terms (term) means.

    Spellings are reduced to distinct ones before any collation key is made, so the join is one of dictionaries. Terms that
    are null, empty or name nothing give no row, repeated ones one.
    """
    spellings = places.select(raw_division(F.col("ActionGeo_FullName")).alias("spelling")).where("spelling <> ''").distinct()
    named = spellings.select("spelling", F.explode(_names(F.col("spelling"))).alias("name"))
    asked = terms.select("term").where("trim(term) <> ''").distinct()
    met = asked.select("term", alike(F.col("term")).alias("key")).join(named.select("spelling", alike(F.col("name")).alias("key")), "key")
    return met.select("term", "spelling").distinct()


def events_named(terms: DataFrame, events: DataFrame) -> DataFrame:
    """events of the divisions that each term means, with the term: events meet resolved spellings by plain equality, so no
    event's name is collated."""
    found = stored_spellings(terms, events)
    rows = events.withColumn("spelling", raw_division(F.col("ActionGeo_FullName")))
    return rows.join(found, "spelling").drop("spelling")


def merged_divisions(events: DataFrame) -> DataFrame:
    """One row a division, however it is spelled: name (its most frequent right spelling, the smallest of equally frequent
    ones), spellings and events. Events are counted by spelling first."""
    spelled = events.select(raw_division(F.col("ActionGeo_FullName")).alias("spelling")).where("spelling <> ''").groupBy("spelling").agg(F.count("*").alias("n"))
    right = spelled.withColumn("right", S.lookup(F.col("spelling"), K.DAMAGED_DIVISIONS, F.col("spelling"))).groupBy("right").agg(F.sum("n").alias("n"), F.count("*").alias("spellings"))
    by_name = right.groupBy(alike(F.col("right")).alias("key"))
    first = F.array_min(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("right").alias("name"))))["name"]
    return by_name.agg(first.alias("name"), F.sum("spellings").alias("spellings"), F.sum("n").alias("events")).drop("key")
