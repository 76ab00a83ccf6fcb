"""Similar sets of names: a prefix-filtered join of distinct sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_sets(rows: DataFrame, id_col: str, items: Column, is_query: Column) -> DataFrame:
    """(set_id, items, members, queries): one row for each distinct non-empty set, under its smallest id, with the number of
    its rows and of those that ask. Nulls in a set count as absent; rows without an id are left out."""
    own = F.array_sort(F.array_distinct(F.array_compact(items)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), own.alias("items"), is_query.alias("asks")).where("id IS NOT NULL AND size(items) > 0")
    return rows.groupBy("items").agg(F.min("id").alias("set_id"), F.count("*").alias("members"), F.count_if("asks").alias("queries"))


def frequent_items(sets: DataFrame, n: int) -> list[str]:
    """The n most frequent items, the most frequent first; only these reach the driver."""
    counts = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    return [r.item for r in counts.orderBy(F.desc("n"), "item").limit(n).collect()]


def rare_first(sets: DataFrame, frequent: list[str] | None = None) -> DataFrame:
    """sets with items in one order for all: the frequent items (64 unless given) last, the most frequent of all at the end.

    Any order gives right results; this one keeps frequent items out of the prefixes.
    """
    frequent = frequent_items(sets, 64) if frequent is None else frequent
    if not frequent:
        return sets
    place = F.create_map(*(x for i, c in enumerate(frequent[::-1]) for x in (F.lit(c), F.lit(i + 1))))
    keyed = F.array_sort(F.transform("items", lambda x: F.struct(F.coalesce(place[x], F.lit(0)).alias("place"), x.alias("item"))))
    return sets.withColumn("items", F.transform(keyed, lambda x: x["item"]))


def _masked(rows: DataFrame, common: list[str], every: str, before: str) -> DataFrame:
    """rows with the items of two arrays as bits: a long for each 63 of the common items, and an array of hashes for the rest."""
    parts = [common[i : i + 63] for i in range(0, len(common), 63)]
    # name -> (number of the long, bit): one map for all rows
    bit = F.create_map(*(x for p in parts for i, c in enumerate(p) for x in (F.lit(c), F.lit(1 << i)))) if common else None
    part = F.create_map(*(x for n, p in enumerate(parts) for c in p for x in (F.lit(c), F.lit(n)))) if common else None

    def bits(col: str, n: int) -> Column:
        own = F.transform(F.filter(col, lambda x: F.coalesce(part[x] == n, F.lit(False))), lambda x: bit[x].cast("long"))
        return F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    for col, to in ((every, "every"), (before, "before")):
        for n in range(len(parts)):
            rows = rows.withColumn(f"{to}{n}", bits(col, n))
        rest = F.filter(col, lambda x: part[x].isNull()) if common else F.col(col)
        rows = rows.withColumn(f"{to}_rest", rest)
    return rows


def similar_sets(sets: DataFrame, least: float, salts: int = 8) -> DataFrame:
    """(query_set, other_set, overlap, jaccard) of distinct sets (set_id, items, members, queries), one of which asks.

    Two sets whose Jaccard similarity is at least `least` (above 0) share an item among the first few of both, when items
    are ordered alike; only these prefixes meet. A pair goes on from its first common item alone, and only if the items
    after it can still make up the overlap that its sizes ask for; then the sets themselves are compared. A set pairs with
    itself where it has several rows. Prefixes that hold a frequent item are dealt over `salts` parts.

    Sets carry their 252 most frequent items as bits of four longs, so that a pair costs a few bit operations; only the
    other items, if both have any, are compared as arrays.
    """
    if not 0 < least <= 1:
        raise ValueError("least has to be above 0 and at most 1")
    size = F.size("items")
    up = lambda x: F.ceil(x - F.lit(1e-9)).cast("int")
    common = frequent_items(sets, 252)
    ordered = rare_first(sets, common).withColumn("size", size)
    first = F.slice("items", 1, F.col("size") - up(F.col("size") * least) + 1)
    each = ordered.select("set_id", "items", "size", "members", "queries", F.posexplode(first).alias("at", "item"))
    each = _masked(each.withColumn("earlier", F.slice("items", 1, F.col("at"))), common, "items", "earlier").drop("items", "earlier")
    longs = range((len(common) + 62) // 63)
    names = {c: f"q_{c}" for c in ("size", "at", "every_rest", "before_rest", *(f"{x}{n}" for x in ("every", "before") for n in longs))}
    asks = each.where("queries > 0").select(F.col("set_id").alias("query_set"), "item", *(F.col(c).alias(n) for c, n in names.items()), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = each.withColumn("salt", F.pmod(F.xxhash64("set_id"), F.lit(salts)).cast("int")).join(asks, ["item", "salt"])
    met = met.where((F.col("query_set") != F.col("set_id")) | (F.col("members") > 1))
    met = met.where((F.col("size") >= F.col("q_size") * least - 1e-9) & (F.col("q_size") >= F.col("size") * least - 1e-9))
    needed = up((F.col("size") + F.col("q_size")) * (least / (1 + least)))
    met = met.where(F.least(F.col("size") - F.col("at"), F.col("q_size") - F.col("q_at")) >= needed)
    both = lambda x, n: F.col(f"{x}{n}").bitwiseAND(F.col(f"q_{x}{n}"))
    rests = lambda x: (F.size(f"{x}_rest") > 0) & (F.size(f"q_{x}_rest") > 0)
    for n in longs:
        met = met.where(both("before", n) == 0)
    met = met.where(~(rests("before") & F.arrays_overlap("before_rest", "q_before_rest")))
    overlap = F.when(rests("every"), F.size(F.array_intersect("every_rest", "q_every_rest"))).otherwise(0)
    for n in longs:
        overlap = overlap + F.bit_count(both("every", n))
    met = met.select("query_set", F.col("set_id").alias("other_set"), overlap.alias("overlap"), (F.col("size") + F.col("q_size")).alias("sizes"))
    met = met.withColumn("every", F.col("sizes") - F.col("overlap"))
    return met.where(F.col("overlap") >= F.col("every") * least - 1e-9).select("query_set", "other_set", "overlap", (F.col("overlap") / F.col("every")).alias("jaccard"))
