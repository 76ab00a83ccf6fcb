"""Further operators on events, rollups and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgrid.functions import scalars as S
from newsgrid.operators.quantiles import quantiles


def candidate_top(region_days: DataFrame, events: DataFrame, n: int = 5) -> DataFrame:
    """The n events of each region with the most articles, from the days' own top lists: they bound those of the range."""
    ids = region_days.select("region_type", "region_code", F.explode("top_event_ids").alias("GlobalEventID"))
    rows = ids.join(events.select("GlobalEventID", "SQLDATE", "NumArticles"), "GlobalEventID")
    order = Window.partitionBy("region_type", "region_code").orderBy(F.desc("NumArticles"), "GlobalEventID")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def suggest_places(events: DataFrame, prefix: str, divisions: list[str], n: int) -> DataFrame:
    """Names that begin with prefix: the given divisions first, then places of the events by name. divisions: a short list."""
    hits = [d for d in divisions if d.startswith(prefix)]
    names = events.where(F.col("ActionGeo_FullName").startswith(prefix)).select(F.col("ActionGeo_FullName").alias("name"), F.lit(2).alias("kind")).distinct()
    if hits:
        listed = events.sparkSession.createDataFrame([(d, 1) for d in hits], "name string, kind int")
        names = listed.unionByName(names.where(~F.col("name").isin(hits)))
    return names.orderBy("kind", "name").limit(n)


def place_evolution(events: DataFrame, n: int = 15) -> DataFrame:
    """By place: events, first and last day, actors and types; the n busiest."""
    rows = events.where("ActionGeo_FullName IS NOT NULL").groupBy(F.col("ActionGeo_FullName").alias("place"))
    out = rows.agg(F.count("*").alias("events"), F.min("SQLDATE").alias("first_seen"), F.max("SQLDATE").alias("last_seen"), F.count_distinct("Actor1Name").alias("actors"), F.array_join(F.array_sort(F.collect_set(S.daily_type())), ";").alias("types"))
    return out.orderBy(F.desc("events"), "place").limit(n)


def timeline(events: DataFrame, milestones: int = 3) -> DataFrame:
    """By seed (first actor): span, duration, and the first `milestones` events by articles x |score| with their reasons."""
    heat = F.coalesce("NumArticles", F.lit(0)) * F.abs(F.coalesce("GoldsteinScale", F.lit(0.0)))
    reason = F.concat_ws(", ", F.when(F.col("NumArticles") > 80, "wide coverage"), F.when(F.abs("GoldsteinScale") > 7, "extreme score"))
    own = events.where("Actor1Name IS NOT NULL")
    spans = own.groupBy("Actor1Name").agg(F.min("SQLDATE").alias("start"), F.max("SQLDATE").alias("end"), F.count("*").alias("events"))
    # the rank is filtered where it is made, so that tasks keep an actor's first events only before the shuffle
    order = Window.partitionBy("Actor1Name").orderBy(F.desc("heat"), "GlobalEventID")
    first = own.select("Actor1Name", "GlobalEventID", heat.alias("heat"), reason.alias("reason")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= milestones)
    text = F.concat(F.col("GlobalEventID").cast("string"), F.lit(":"), F.col("reason"))
    marks = F.transform(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))), lambda x: x["t"])
    marked = first.groupBy("Actor1Name").agg(F.array_join(marks, "; ").alias("milestones"))
    return spans.join(marked, "Actor1Name", "left").select("Actor1Name", "start", "end", "events", F.coalesce("milestones", F.lit("")).alias("milestones"), (F.datediff("end", "start") + 1).alias("days"))


def origin_buckets(rows: DataFrame, buckets: int = 3, day: str = "event_date") -> DataFrame:
    """rows with bucket: equal widths between the first and the last origin, numbered from 1."""
    span = rows.agg(F.min(day).alias("a"), F.max(day).alias("z"))
    width = (F.datediff("z", "a") + 1) / buckets
    return rows.crossJoin(F.broadcast(span)).withColumn("bucket", (F.floor(F.datediff(day, "a") / width) + 1).cast("int")).drop("a", "z")


def residual_quantiles(rows: DataFrame) -> DataFrame:
    """By horizon the 10th and 90th percentiles of y - p."""
    out = quantiles(rows.select("h", (F.col("y") - F.col("p")).alias("r")), ["h"], "r", [0.1, 0.9])
    return out.select("h", "n", F.col("q")[0].alias("low_q"), F.col("q")[1].alias("high_q"))


def attention_context(features: DataFrame, series: DataFrame, days: int = 30) -> DataFrame:
    """For each series the count its last day attends to: softmax over its last `days` days of the features' dot product
    with the last day's, over 4, less a seventh of the age in days."""
    names = [c for c in features.columns if c.startswith("x")]
    rows = features.select("series_id", "event_date", F.array(*names).alias("k")).join(series.select("series_id", "event_date", "total_events"), ["series_id", "event_date"])
    order = Window.partitionBy("series_id").orderBy(F.desc("event_date"))
    recent = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= days)
    last = recent.where("r = 1").select("series_id", F.col("k").alias("q"), F.col("event_date").alias("day"))
    dot = F.aggregate(F.zip_with("k", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    score = dot / 4 - F.datediff("day", "event_date") / 7
    weights = recent.join(last, "series_id").select("series_id", "total_events", F.exp(score).alias("w"))
    return weights.groupBy("series_id").agg((F.sum(F.col("w") * F.col("total_events")) / F.sum("w")).alias("context"))


def interval_gaps(quality: DataFrame, target: float = 0.8) -> DataFrame:
    """(model, worst_gap, mean_width) of quality (model, coverage, width; one row a group): how far the coverage of the
    worst group is from the target, and the mean width over groups."""
    return quality.groupBy("model").agg(F.round(F.max(F.abs(F.col("coverage") - target)), 6).alias("worst_gap"), F.round(F.avg("width"), 4).alias("mean_width"))


def choose_method(quality: DataFrame, target: float = 0.8) -> DataFrame:
    """The method with the smallest worst gap to the target coverage over its groups, then the smallest width."""
    return interval_gaps(quality, target).orderBy("worst_gap", "mean_width", "model").limit(1)


def matched_cells(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells of both tables, and the largest difference between them."""
    met = a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), keys)
    return met.agg(F.count("*").alias("cells"), F.max(F.abs(F.col("va") - F.col("vb"))).alias("largest_difference"))
