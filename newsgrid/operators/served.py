"""Served forecasts with intervals and summaries, series from stored lists, checks of stored against rebuilt rows, decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrid.operators import nearest_texts as nearest
from newsgrid.operators import scores as C
from newsgrid.operators import series as T
from newsgrid.sources.stored import stored

BY = ["series_id", "measure"]


def confidence(days: Column, active: Column) -> Column:
    """How far a history of so many days, of which so many have events, can be trusted."""
    return F.when((days >= 90) & (active / days >= 0.5), "medium-high").when((days >= 30) & (active >= 10), "medium").otherwise("low")


def history_stats(long: DataFrame) -> DataFrame:
    """By series and measure: days, days with events, mean, mean of the last 7 days, population deviation of the last 30."""
    latest = Window.partitionBy(*BY).orderBy(F.desc("event_date"))
    rows = long.withColumn("age", F.row_number().over(latest))
    recent = F.when(F.col("age") <= 30, F.col("y"))
    return rows.groupBy(*BY).agg(
        F.count("*").alias("days"),
        F.sum((F.col("y") > 0).cast("int")).alias("active"),
        F.avg("y").alias("mean"),
        F.avg(F.when(F.col("age") <= 7, F.col("y"))).alias("recent_mean"),
        F.stddev_pop(recent).alias("deviation"),
    )


def with_empirical_interval(forecast: DataFrame, stats: DataFrame) -> DataFrame:
    """forecast (series_id, measure, h, p) with low and high: p less and plus the larger of the deviation of the last 30 days
    and 15 % of p, times sqrt(h / 7); for histories under 7 days a quarter of p, 1 at least."""
    known = F.greatest("deviation", F.col("p") * 0.15) * F.sqrt(F.col("h") / 7)
    spread = F.when(F.col("days") < 7, F.greatest(F.lit(1.0), F.col("p") * 0.25)).otherwise(known)
    rows = forecast.join(stats.select(*BY, "days", "deviation"), BY)
    return rows.withColumns({"low": F.greatest(F.lit(0.0), F.col("p") - spread), "high": F.col("p") + spread}).drop("days", "deviation")


def with_context(long: DataFrame, context: DataFrame, horizon: int = 7) -> DataFrame:
    """The excitation forecast of series.excitation_forecast, its excitation taken from the attention context
    (series_id, context) in place of the mean of the last 7 days."""
    if not 1 <= horizon <= 60:
        raise ValueError("horizons are 1 to 60 days")
    return T.excitation_forecast(long, horizon, context)


def forecast_summary(forecast: DataFrame, history: DataFrame, stats: DataFrame) -> DataFrame:
    """One row a series and measure: day and size of the highest risk (the first of equal ones), its level, recent against
    whole history in percent, and the confidence."""
    risk = C.risk(history, forecast.select(*BY, "h", "p"))
    rows = forecast.join(risk.drop("p"), [*BY, "h"])
    peak = F.max_by(F.struct("h", "p", "risk_score", "risk_level", "event_date"), F.struct("risk_score", -F.col("h")))
    peaks = rows.groupBy(*BY).agg(peak.alias("peak")).join(stats, BY)
    change = F.when(F.col("mean") == 0, 0.0).otherwise((F.col("recent_mean") - F.col("mean")) / F.col("mean") * 100)
    return peaks.select(
        *BY,
        F.date_add("peak.event_date", F.col("peak.h")).alias("peak_date"),
        F.col("peak.p").alias("expected_events_peak"),
        F.col("peak.risk_score").alias("peak_risk_score"),
        F.col("peak.risk_level").alias("risk_level"),
        F.round(change, 2).alias("recent_vs_history_pct"),
        confidence(F.col("days"), F.col("active")).alias("confidence"),
    )


def list_to_json(summaries: DataFrame, column: str) -> DataFrame:
    """summaries with an array of (name, count) as JSON text, as a row store keeps it."""
    return summaries.withColumn(column, F.to_json(column))


def json_rows(rows: DataFrame, column: str, schema: str = "array<struct<name string, count long>>") -> DataFrame:
    """One row for each entry of a JSON list, its fields as columns; rows with null, empty or damaged lists give none."""
    return rows.select(*(c for c in rows.columns if c != column), F.inline(F.from_json(column, schema)))


def series_from_lists(stored: DataFrame, column: str, prefix: str) -> DataFrame:
    """Daily series from a stored list (date, total_events, conflict_events, cooperation_events, column: JSON): an entry's
    count, and of the day's conflict and cooperation events the entry's share of all events."""
    return _shares(json_rows(stored, column), prefix)


def series_from_counts(stored: DataFrame, column: str, prefix: str) -> DataFrame:
    """As series_from_lists, from a stored object of counts by name; damaged or empty objects give none."""
    counts = F.explode(F.from_json(column, "map<string, long>")).alias("name", "count")
    return _shares(stored.select("date", "total_events", "conflict_events", "cooperation_events", counts), prefix)


def _shares(rows: DataFrame, prefix: str) -> DataFrame:
    part = lambda c: F.round(F.sum(F.col("count") * F.col(c) / F.greatest("total_events", F.lit(1))), 6)
    return rows.groupBy(F.concat(F.lit(prefix), F.col("name")).alias("series_id"), F.col("date").alias("event_date")).agg(F.sum("count").alias("events"), part("conflict_events").alias("conflict"), part("cooperation_events").alias("cooperation"))


def all_list_series(stored: DataFrame) -> DataFrame:
    """Series of actors, places and categories from the lists that a day's stored row keeps of each."""
    actors, places = (series_from_lists(stored, c, k) for c, k in (("top_actors", "actor:"), ("top_locations", "country:")))
    return actors.unionByName(places).unionByName(series_from_counts(stored, "event_type_distribution", "event_category:"))


def stored_and_rebuilt(stored: DataFrame, rebuilt: DataFrame, keys: list[str], counts: list[str], averages: list[str], tolerance: float = 1e-3) -> DataFrame:
    """By kind of series (the part before the colon): rows of both, rows missing on a side, rows with other counts, and rows
    whose averages differ by more than tolerance."""
    side = lambda df, p: df.select(*keys, *(F.col(c).alias(p + c) for c in counts + averages), F.lit(True).alias(p + "in"))
    met = side(stored, "s_").join(side(rebuilt, "r_"), keys, "full_outer").withColumn("kind", F.split_part("series_id", F.lit(":"), F.lit(1)))
    both = F.col("s_in").isNotNull() & F.col("r_in").isNotNull()
    other, off = F.lit(False), F.lit(False)
    for c in counts:
        other = other | ~F.col("s_" + c).eqNullSafe(F.col("r_" + c))
    for c in averages:
        off = off | F.coalesce(F.abs(F.col("s_" + c) - F.col("r_" + c)) > tolerance, ~F.col("s_" + c).eqNullSafe(F.col("r_" + c)))
    n = lambda c: F.sum(c.cast("long"))
    return met.groupBy("kind").agg(n(both).alias("matched"), n(F.col("r_in").isNull()).alias("only_stored"), n(F.col("s_in").isNull()).alias("only_rebuilt"), n(both & other).alias("counts_differ"), n(both & off).alias("averages_differ"))


def recomputed(events: DataFrame, stored: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str, columns: list[str], modulus: int = 997) -> DataFrame:
    """One row: how many events of a sample (id divisible by modulus: the operator's parameter) have no stored row, and how
    many stored values differ from those computed again, by column."""
    again = compute(events.where(F.col("GlobalEventID") % modulus == 0)).select(F.col(key).alias("k"), *(F.col(c).alias("again_" + c) for c in columns))
    met = again.join(stored.select(F.col(key).alias("k"), *columns, F.lit(True).alias("there")), "k", "left")
    differs = [F.sum((F.col("there").isNotNull() & ~F.col(c).eqNullSafe(F.col("again_" + c))).cast("long")).alias("differs_" + c) for c in columns]
    return met.agg(F.count("*").alias("checked"), F.sum(F.col("there").isNull().cast("long")).alias("missing"), *differs)


def window_arrays(windows: DataFrame, path: str) -> DataFrame:
    """Windows written as Parquet with one fixed-length array column each for input and target, and read back."""
    windows.select(*BY, "event_date", F.col("x").cast("array<float>").alias("x"), F.col("target").cast("array<float>").alias("target")).write.mode("overwrite").parquet(path)
    return windows.sparkSession.read.parquet(path)


def chunks(rows: DataFrame, size: int, limit: int | None = None, transform: Callable[[dict], dict] | None = None) -> Iterator[list[dict]]:
    """Lists of up to `size` rows for one consumer, a partition in memory at a time; limit is the consumer's own."""
    held: list[dict] = []
    for row in (rows if limit is None else rows.limit(limit)).toLocalIterator(prefetchPartitions=True):
        held.append(transform(row.asDict()) if transform else row.asDict())
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def prepared_texts(docs: DataFrame, least: int = 150, most: int = 8000) -> DataFrame:
    """(doc_id, text) for vectors: texts of over `least` characters, their first `most` characters, one row an id."""
    rows = docs.where(F.length("text") > least).select("doc_id", F.left("text", F.lit(most)).alias("text"))
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"))


def with_coverage(events: DataFrame, pages: DataFrame, k: int = 3) -> DataFrame:
    """events (GlobalEventID, SOURCEURL, headline) with their article: source, page_id, text and near.

    source is page where the event's own page (page_id, url, text) has text, else nearest with the text of the page most
    like the headline by words, else none. near: page ids and scores of up to k such pages, best first. Events with equal
    headlines ask once. Of several pages with one URL the smallest page_id that has text counts.
    """
    pages = stored(pages.select("page_id", "url", "text").where("text <> ''"))
    own = pages.groupBy("url").agg(F.min_by(F.struct("page_id", "text"), "page_id").alias("own"))
    rows = events.select("GlobalEventID", "SOURCEURL", "headline").join(own, F.col("SOURCEURL") == F.col("url"), "left").drop("url")
    rows = stored(rows.withColumn("asks", F.when(F.col("own").isNull(), F.col("headline"))))
    asked = stored(rows.where("asks IS NOT NULL").groupBy("asks").agg(F.min("GlobalEventID").alias("query_id")))
    weights, stats = nearest.lists(pages, "page_id", wanted=nearest.words(asked, "asks"))
    found = nearest.nearest_texts(asked, weights, stats, k, text="asks").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("page_id"), "score"))).alias("near"))
    by_headline = asked.join(found, "query_id").select("asks", F.transform("near", lambda x: F.struct(x["page_id"].alias("page_id"), x["score"].alias("score"))).alias("near"))
    rows = rows.join(by_headline, "asks", "left").withColumn("page_id", F.coalesce("own.page_id", F.col("near")[0]["page_id"]))
    source = F.when(F.col("own").isNotNull(), "page").when(F.col("near").isNotNull(), "nearest").otherwise("none")
    texts = pages.select("page_id", F.col("text").alias("page_text"))
    rows = rows.withColumn("source", source).join(texts, "page_id", "left")
    return rows.select("GlobalEventID", "source", "page_id", F.coalesce("own.text", "page_text").alias("text"), "near")


def chosen_config(trials: DataFrame) -> DataFrame:
    """The trial (config, validation_mae) with the smallest error, by name of equal ones."""
    return trials.orderBy("validation_mae", "config").limit(1)


def decision(candidates: DataFrame, floor: float = 0.75) -> DataFrame:
    """One row (decision) from candidates (a_mae, a_coverage, b_mae, b_coverage, lo, hi): those under the coverage floor are
    out; of two, the lower error, but b where the interval of a's error less b's includes 0."""
    a, b = F.col("a_coverage") >= floor, F.col("b_coverage") >= floor
    lower = F.when(F.col("a_mae") <= F.col("b_mae"), "a").otherwise("b")
    both = F.when((F.col("lo") <= 0) & (F.col("hi") >= 0), "b").otherwise(lower)
    return candidates.withColumn("decision", F.when(a & b, both).when(a, "a").when(b, "b").otherwise("none"))


def largest_difference(one: DataFrame, two: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row: cells of both feature tables, rows on one side only, and the largest absolute difference of any column."""
    side = lambda df, p: df.select(*keys, *(F.col(c).cast("double").alias(p + c) for c in columns), F.lit(True).alias(p + "in"))
    met = side(one, "a_").join(side(two, "b_"), keys, "full_outer")
    both = F.col("a_in").isNotNull() & F.col("b_in").isNotNull()
    gap = F.greatest(*(F.abs(F.col("a_" + c) - F.col("b_" + c)) for c in columns), F.lit(0.0))
    return met.agg(F.sum(both.cast("long")).alias("rows"), F.sum((~both).cast("long")).alias("one_side"), F.max(F.when(both, gap)).alias("largest"))


def seed_summary(runs: DataFrame) -> DataFrame:
    """From errors (seed, model, mae): their mean, least and largest by model, and the number of seeds."""
    return runs.groupBy("model").agg(F.count("*").alias("seeds"), F.round(F.avg("mae"), 6).alias("mean_mae"), F.round(F.min("mae"), 6).alias("least_mae"), F.round(F.max("mae"), 6).alias("largest_mae"))
