"""Daily, regional and grid rollups, and queries that are answered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrid.functions import constants as K
from newsgrid.functions import scalars as S


def ranked_list(rows: DataFrame, keys: list[str], name: str, n: int, out: str) -> DataFrame:
    """For each key the n most frequent values of name, as an array of (name, count), ties by name."""
    counts = rows.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(*keys, F.col(name).alias("name")).agg(F.count("*").alias("count"))
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "name")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    entries = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "count"))), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count")))
    return best.groupBy(*keys).agg(entries.alias(out))


def daily_summary(events: DataFrame, top: int = 10, hot: int = 20) -> DataFrame:
    """One row a day: totals, most frequent actors and places, histogram of types, hottest events by rank."""
    day = events.withColumn("date", F.col("SQLDATE"))
    totals = day.groupBy("date").agg(
        F.count("*").alias("total_events"),
        S.share(S.conflict()).alias("conflict_events"),
        S.share(S.cooperation()).alias("cooperation_events"),
        S.mean(F.col("GoldsteinScale")).alias("avg_goldstein"),
        S.mean(F.col("AvgTone")).alias("avg_tone"),
        F.sum("NumArticles").alias("total_articles"),
    )
    actors = day.select("date", F.explode(F.array("Actor1Name", "Actor2Name")).alias("actor"))
    types = day.groupBy("date", S.daily_type().alias("type")).agg(F.count("*").alias("n"))
    types = types.groupBy("date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("event_type_distribution"))
    heat = F.coalesce("NumArticles", F.lit(0)) * F.abs(F.coalesce("GoldsteinScale", F.lit(0.0)))
    order = Window.partitionBy("date").orderBy(heat.desc(), "GlobalEventID")
    hottest = day.select("date", "GlobalEventID", F.row_number().over(order).alias("rank")).where(F.col("rank") <= hot)
    hottest = hottest.groupBy("date").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "GlobalEventID"))), lambda x: x["GlobalEventID"]).alias("hot_event_ids"))
    out = totals
    for part in (ranked_list(actors, ["date"], "actor", top, "top_actors"), ranked_list(day, ["date"], "ActionGeo_FullName", top, "top_locations"), types, hottest):
        out = out.join(part, "date", "left")
    return out


def region_keys(events: DataFrame) -> DataFrame:
    """A row for the country and one for the first-level division, where known, of each event."""
    country = F.struct(F.lit("country").alias("region_type"), S.filled(F.col("ActionGeo_CountryCode")).alias("region_code"))
    in_division = F.col("ActionGeo_Type").between(2, 5) & F.col("ActionGeo_FullName").contains(",")
    division = F.struct(F.lit("state").alias("region_type"), F.when(in_division, F.upper(S.division(F.col("ActionGeo_FullName")))).alias("region_code"))
    return events.select("*", F.inline(F.array(country, division))).where(F.col("region_code").isNotNull())


def region_days(events: DataFrame, actors: int = 3, ids: int = 5) -> DataFrame:
    """One row for each region and day, both levels from one scan: counts, averages, intensities, top actors and events."""
    rows = region_keys(events).withColumn("date", F.col("SQLDATE"))
    keys = ["region_type", "region_code", "date"]
    g = F.coalesce("GoldsteinScale", F.lit(0.0))
    name = F.max(F.when(F.col("ActionGeo_Type") == 1, F.col("ActionGeo_FullName")))
    stats = rows.groupBy(*keys).agg(
        F.coalesce(name, F.first("region_code")).alias("region_name"),
        F.count("*").alias("event_count"),
        S.share(S.conflict()).alias("conflict_events"),
        S.share(S.cooperation()).alias("cooperation_events"),
        S.mean(F.col("GoldsteinScale")).alias("avg_goldstein"),
        S.mean(F.greatest(-g, F.lit(0.0))).alias("conflict_intensity"),
        S.mean(F.greatest(g, F.lit(0.0))).alias("cooperation_intensity"),
        S.mean(F.col("AvgTone")).alias("avg_tone"),
    )
    names = rows.select(*keys, F.explode(F.array("Actor1Name", "Actor2Name")).alias("actor"))
    order = Window.partitionBy(*keys).orderBy(F.col("NumArticles").desc_nulls_last(), "GlobalEventID")
    best = rows.select(*keys, "GlobalEventID", F.row_number().over(order).alias("rank")).where(F.col("rank") <= ids)
    best = best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "GlobalEventID"))), lambda x: x["GlobalEventID"]).alias("top_event_ids"))
    return stats.join(ranked_list(names, keys, "actor", actors, "primary_actors"), keys, "left").join(best, keys, "left")


def grid_days(events: DataFrame, cell: float = 0.5, more_than: int = 5) -> DataFrame:
    """One row for each cell of `cell` degrees and day with more than more_than events."""
    known = (F.col("ActionGeo_Lat") != 0) & (F.col("ActionGeo_Long") != 0)
    lat, long = (F.floor(F.col(c) / cell) * cell for c in ("ActionGeo_Lat", "ActionGeo_Long"))
    rows = events.where(known).select(lat.alias("lat_grid"), long.alias("lng_grid"), F.col("SQLDATE").alias("date"), "GoldsteinScale", "AvgTone")
    out = rows.groupBy("lat_grid", "lng_grid", "date").agg(
        F.count("*").alias("event_count"),
        S.share(S.conflict()).alias("conflict_sum"),
        S.mean(F.col("GoldsteinScale")).alias("avg_goldstein"),
        S.mean(F.col("AvgTone")).alias("avg_tone"),
    )
    return out.where(F.col("event_count") > more_than).withColumn("grid_id", F.format_string("%.1f_%.1f", "lat_grid", "lng_grid"))


def cell_labels(events: DataFrame, cell: float = 0.5) -> DataFrame:
    """The most frequent place name of each cell, ties by name."""
    known = (F.col("ActionGeo_Lat") != 0) & (F.col("ActionGeo_Long") != 0) & F.col("ActionGeo_FullName").isNotNull()
    lat, long = (F.floor(F.col(c) / cell) * cell for c in ("ActionGeo_Lat", "ActionGeo_Long"))
    counts = events.where(known).groupBy(lat.alias("lat_grid"), long.alias("lng_grid"), F.col("ActionGeo_FullName").alias("label")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("lat_grid", "lng_grid").orderBy(F.desc("n"), "label")
    return counts.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def representatives(events: DataFrame, n: int = 25) -> DataFrame:
    """The n hottest events of each day; nulls count as 0; of equal ones the larger id first."""
    heat = F.coalesce("NumArticles", F.lit(0)) * F.abs(F.coalesce("GoldsteinScale", F.lit(0.0)))
    order = Window.partitionBy("SQLDATE").orderBy(heat.desc(), F.desc("GlobalEventID"))
    return events.select("SQLDATE", "GlobalEventID", F.row_number().over(order).alias("rank")).where(F.col("rank") <= n)


def merged_top(summaries: DataFrame, column: str, n: int) -> DataFrame:
    """The n largest sums over days of an array of (name, count): a lower bound of the true counts."""
    rows = summaries.select(F.inline(column))
    return rows.groupBy("name").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "name").limit(n)


def merged_types(summaries: DataFrame) -> DataFrame:
    return summaries.select(F.explode("event_type_distribution").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("n"))


def weighted(value: Column, weight: Column, digits: int = 4) -> Column:
    """Weighted mean; products are summed as whole millionths, so that it does not depend on the order of rows."""
    whole = F.round(value * weight * 1e6).cast("long")
    return F.round(F.try_divide(F.sum(whole), F.sum(F.when(value.isNotNull(), weight)) * F.lit(1e6)), digits)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of `rows` in place of those with the same keys. Running it twice changes nothing more."""
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def keep_first(target: DataFrame, rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows to append: none whose key is in target, and one for each key, the first by order."""
    one = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rank = 1").drop("__rank")
    return one.join(target.select(key), key, "left_anti")


def time_series(events: DataFrame, granularity: str = "day") -> DataFrame:
    """Counts, percentages, averages and population deviations by day, week (from Sunday) or month."""
    d = F.col("SQLDATE")
    period = {"day": d, "week": F.date_sub(d, F.dayofweek(d) - 1), "month": F.trunc(d, "month")}[granularity]
    percent = lambda c: F.round(F.lit(100.0) * S.share(c) / F.count("*"), 2)
    return events.groupBy(period.alias("period")).agg(
        F.count("*").alias("event_count"),
        percent(S.conflict()).alias("conflict_pct"),
        percent(S.cooperation()).alias("cooperation_pct"),
        S.mean(F.col("GoldsteinScale")).alias("avg_goldstein"),
        F.round(F.stddev_pop("GoldsteinScale"), 2).alias("std_goldstein"),
        S.mean(F.col("AvgTone")).alias("avg_tone"),
        F.round(F.stddev_pop("AvgTone"), 2).alias("std_tone"),
    )


def heatmap(events: DataFrame, precision: int = 1, least: int = 5, n: int = 1000) -> DataFrame:
    """Points by coordinates rounded to 1 to 4 decimals; the n largest of at least `least` events."""
    p = min(4, max(1, precision))
    known = (F.col("ActionGeo_Lat") != 0) & (F.col("ActionGeo_Long") != 0)
    out = events.where(known).groupBy(F.round("ActionGeo_Lat", p).alias("lat"), F.round("ActionGeo_Long", p).alias("lng"))
    out = out.agg(F.count("*").alias("intensity"), S.mean(F.col("GoldsteinScale")).alias("avg_conflict"), F.min("ActionGeo_FullName").alias("sample_location"))
    return out.where(F.col("intensity") >= least).orderBy(F.desc("intensity"), "lat", "lng").limit(n)
