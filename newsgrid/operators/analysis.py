"""Dashboards, period comparison, activity, packed fields, evolution of actors and themes, and table checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrid.functions import constants as K
from newsgrid.functions import scalars as S


def daily_trend(events: DataFrame) -> DataFrame:
    return events.groupBy("SQLDATE").agg(F.count("*").alias("cnt"), S.mean(F.col("GoldsteinScale")).alias("goldstein"), S.share(S.conflict()).alias("conflict"))


def top_values(events: DataFrame, column: str, n: int, out: str) -> DataFrame:
    named = events.where(F.col(column).isNotNull() & (F.col(column) != ""))
    return named.groupBy(F.col(column).alias(out)).agg(F.count("*").alias("event_count")).orderBy(F.desc("event_count"), out).limit(n)


def live_type_buckets(events: DataFrame) -> DataFrame:
    """Root codes in ranges of about ten, under the labels the live dashboard gives them."""
    root = F.col("EventRootCode").try_cast("int") if hasattr(F.col("EventRootCode"), "try_cast") else F.col("EventRootCode").cast("int")
    label = F.when(root.between(1, 9), "Public Statement").when(root.between(10, 19), "Yield").when(root.between(20, 29), "Investigate").otherwise("Other")
    return events.groupBy(label.alias("event_type")).agg(F.count("*").alias("event_count"))


def summary_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total_events"), F.count_distinct("Actor1Name").alias("unique_actors"), S.mean(F.col("GoldsteinScale")).alias("avg_goldstein"), S.mean(F.col("AvgTone")).alias("avg_tone"), F.sum("NumArticles").alias("total_articles"))


def period_counts(events: DataFrame, periods: DataFrame) -> DataFrame:
    """Events and articles of each period (label, start, end; a handful of rows), zeros kept. Periods may overlap."""
    days = events.groupBy("SQLDATE").agg(F.count("*").alias("n"), F.sum("NumArticles").alias("articles"))
    met = periods.join(days, F.col("SQLDATE").between(F.col("start"), F.col("end")), "left")
    return met.groupBy("label", "start", "end").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("event_count"), F.coalesce(F.sum("articles"), F.lit(0)).alias("article_count"))


def compare_periods(pairs: DataFrame) -> DataFrame:
    """Direction and percent change of daily rates for rows (n1, days1, n2, days2), earlier and later."""
    rate1, rate2 = F.col("n1") / F.col("days1"), F.col("n2") / F.col("days2")
    pct = F.when(F.col("n1") > 0, F.try_divide(rate2 - rate1, rate1) * 100.0)
    direction = (
        F.when((F.col("n1") == 0) & (F.col("n2") == 0), "no_data")
        .when(F.col("n1") == 0, "new_activity")
        .when(F.least("n1", "n2") < K.LOW_VOLUME, "inconclusive_low_volume")
        .when(F.abs(pct) < K.FLAT_PERCENT, "flat")
        .when(pct > 0, "increase")
        .otherwise("decrease")
    )
    lengths = F.when(F.col("days1") != F.col("days2"), "different_lengths")
    return pairs.withColumns({"absolute_change": F.col("n2") - F.col("n1"), "per_day_change": F.round(rate2 - rate1, 2), "percent_change_per_day": F.round(pct, 1), "direction": direction, "caveat": lengths})


def event_sequence(events: DataFrame, bar: float = K.DAILY_BAR) -> DataFrame:
    return events.groupBy(F.col("SQLDATE").alias("date")).agg(
        F.count("*").alias("event_count"),
        S.share(S.conflict(bar)).alias("conflict_events"),
        S.share(S.cooperation(bar)).alias("cooperation_events"),
        S.mean(F.col("GoldsteinScale")).alias("avg_goldstein"),
        S.mean(F.col("AvgTone")).alias("avg_tone"),
        F.sum("NumArticles").alias("total_articles"),
    )


def actor_activity(events: DataFrame, actor: str) -> DataFrame:
    """By day: counts, averages, severe events, and the code with the most articles in one event."""
    own = events.where(F.coalesce(F.col("Actor1Name") == actor, F.lit(False)) | F.coalesce(F.col("Actor2Name") == actor, F.lit(False)))
    return own.groupBy(F.col("SQLDATE").alias("date")).agg(
        F.count("*").alias("total_events"),
        F.sum("NumArticles").alias("total_articles"),
        S.mean(F.col("GoldsteinScale")).alias("avg_goldstein"),
        S.mean(F.col("AvgTone")).alias("avg_tone"),
        S.share(S.conflict()).alias("severe_conflict"),
        S.share(S.cooperation()).alias("severe_cooperation"),
        F.max_by("EventCode", F.struct("NumArticles", -F.col("GlobalEventID"))).alias("top_event_code"),
    )


def distribution(events: DataFrame, column: str) -> DataFrame:
    """Rows by value, and their share of all rows in percent."""
    counts = events.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 2).alias("pct"))


def theme_counts(packed: DataFrame, n: int | None = 20) -> DataFrame:
    """Themes of packed strings NAME,offset;NAME,offset;..., the n most frequent."""
    names = packed.select(F.explode(F.split("V2Themes", ";")).alias("entry")).select(F.split_part("entry", F.lit(","), F.lit(1)).alias("theme"))
    counts = names.where("theme <> ''").groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme")
    return counts if n is None else counts.limit(n)


def theme_counts_by_day(packed: DataFrame, n: int = 5) -> DataFrame:
    names = packed.select("event_day", F.explode(F.split("V2Themes", ";")).alias("entry")).select("event_day", F.split_part("entry", F.lit(","), F.lit(1)).alias("theme"))
    counts = names.where("theme <> ''").groupBy("event_day", "theme").agg(F.count("*").alias("n"))
    order = Window.partitionBy("event_day").orderBy(F.desc("n"), "theme")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def theme_trend(packed: DataFrame, n: int = 10) -> DataFrame:
    """Themes that more than doubled, or fell below half, between the first and the last day (three at the larger end)."""
    counts = theme_counts_by_day(packed, 1 << 30).drop("rank")
    ends = counts.agg(F.min("event_day").alias("first"), F.max("event_day").alias("last"))
    pivot = counts.crossJoin(F.broadcast(ends)).groupBy("theme").agg(F.sum(F.when(F.col("event_day") == F.col("first"), F.col("n")).otherwise(0)).alias("first_n"), F.sum(F.when(F.col("event_day") == F.col("last"), F.col("n")).otherwise(0)).alias("last_n"))
    up = (F.col("last_n") > 2 * F.col("first_n")) & (F.col("last_n") >= 3)
    down = (F.col("first_n") > 2 * F.col("last_n")) & (F.col("first_n") >= 3)
    ratio = F.round(F.greatest("first_n", "last_n") / F.greatest(F.least("first_n", "last_n"), F.lit(1)), 1)
    rows = pivot.withColumn("trend", F.when(up, "emerging").when(down, "declining")).where("trend IS NOT NULL").withColumn("ratio", ratio)
    order = Window.partitionBy("trend").orderBy(F.desc("ratio"), "theme")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def cooccurring(packed: DataFrame, target: str, n: int = 15) -> DataFrame:
    """Persons, organisations and themes of rows that name the target, without the target's own variants: n of each kind."""
    own = packed.where(F.col("V2Persons").contains(target))
    kinds = F.array(F.struct(F.lit("person").alias("kind"), F.col("V2Persons").alias("text")), F.struct(F.lit("organisation").alias("kind"), F.col("V2Organizations").alias("text")), F.struct(F.lit("theme").alias("kind"), F.col("V2Themes").alias("text")))
    names = own.select(F.inline(kinds)).select("kind", F.explode(F.split("text", ";")).alias("entry")).select("kind", F.split_part("entry", F.lit(","), F.lit(1)).alias("name"))
    counts = names.where((F.col("name") != "") & ~F.col("name").contains(target)).groupBy("kind", "name").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "name")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def tone_timeline(packed: DataFrame) -> DataFrame:
    tone = F.expr("try_cast(split_part(V2Tone, ',', 1) AS double)")
    return packed.groupBy("event_day").agg(S.mean(tone).alias("avg_tone"), F.count(tone).alias("mentions"))


def actor_evolution(events: DataFrame, n: int = 20) -> DataFrame:
    """By actor: first and last day, events, places, first ten co-actors by name, average score and role; the n busiest."""
    sides = F.array(F.struct(F.col("Actor1Name").alias("actor"), F.col("Actor2Name").alias("other")), F.struct(F.col("Actor2Name").alias("actor"), F.col("Actor1Name").alias("other")))
    rows = events.select("SQLDATE", "GoldsteinScale", "ActionGeo_FullName", F.inline(sides)).where("actor IS NOT NULL")
    average = S.mean(F.col("GoldsteinScale"))
    out = rows.groupBy("actor").agg(
        F.min("SQLDATE").alias("first_seen"),
        F.max("SQLDATE").alias("last_seen"),
        F.count("*").alias("events"),
        F.count_distinct("ActionGeo_FullName").alias("places"),
        F.array_join(F.slice(F.array_sort(F.collect_set("other")), 1, 10), ";").alias("co_actors"),
        average.alias("avg_goldstein"),
    )
    role = F.when(F.col("avg_goldstein").isNull(), "unknown").when(F.col("avg_goldstein") < -3, "antagonist").when(F.col("avg_goldstein") > 3, "cooperator").otherwise("neutral")
    return out.withColumn("role", role).orderBy(F.desc("events"), "actor").limit(n)


def headline_figures(events: DataFrame) -> DataFrame:
    """One row: busiest day, leading actor and place, dominant type with its share, conflict rate."""
    day = events.groupBy(F.col("SQLDATE").alias("v")).agg(F.count("*").alias("n")).agg(F.max_by("v", F.struct("n", -F.unix_date("v"))).alias("busiest_day"))
    actor = top_values(events, "Actor1Name", 1, "leading_actor").select("leading_actor")
    place = top_values(events, "ActionGeo_FullName", 1, "leading_place").select("leading_place")
    kind = events.groupBy(S.daily_type().alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(1).select(F.col("v").alias("dominant_type"), F.col("n").alias("dominant_count"))
    rate = events.agg(F.count("*").alias("total"), F.round(F.lit(100.0) * S.share(S.conflict()) / F.count("*"), 2).alias("conflict_pct"))
    return day.crossJoin(actor).crossJoin(place).crossJoin(kind).crossJoin(rate)


def half_trend(daily: DataFrame, value: str = "event_count") -> DataFrame:
    """Average of the second half of the days less that of the first, in percent of the first; and of last and first week."""
    w = Window.orderBy("date")  # one row a day
    rows = daily.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    first, second = F.avg(F.when(F.col("i") * 2 <= F.col("n"), F.col(value))), F.avg(F.when(F.col("i") * 2 > F.col("n"), F.col(value)))
    early, late = F.avg(F.when(F.col("i") <= 7, F.col(value))), F.avg(F.when(F.col("i") > F.col("n") - 7, F.col(value)))
    return rows.agg(F.round(F.try_divide(second - first, first) * 100, 2).alias("half_change_pct"), F.round(F.try_divide(late - early, early) * 100, 2).alias("week_change_pct"))


def compare_sides(events: DataFrame, column: str, left: str, right: str) -> DataFrame:
    """Events of two values of a column, by daily type."""
    rows = events.where(F.col(column).isin(left, right)).groupBy(S.daily_type().alias("type"))
    return rows.agg(S.share(F.col(column) == left).alias("left_events"), S.share(F.col(column) == right).alias("right_events"))


def place_dictionary(events: DataFrame, least_division: int, least_city: int) -> DataFrame:
    """Divisions and cities with enough events, without names that are no places. Full names are counted first, then split."""
    named = events.groupBy("ActionGeo_FullName", F.col("ActionGeo_Type").between(2, 5).alias("divided")).agg(F.count("*").alias("n"))
    parts = F.split("ActionGeo_FullName", ", ")
    of = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    division = F.when(F.col("divided") & (F.size(parts) >= 2), of("division", F.try_element_at(parts, F.lit(-2))))
    city = F.when(F.size(parts) >= 3, of("city", F.try_element_at(parts, F.lit(1))))
    rows = named.select(F.inline(F.array_compact(F.array(division, city))), "n")
    counts = rows.groupBy("kind", "name").agg(F.sum("n").alias("n"))
    enough = ((F.col("kind") == "division") & (F.col("n") >= least_division)) | ((F.col("kind") == "city") & (F.col("n") >= least_city))
    word = r"\b(" + "|".join(K.NOT_PLACE_WORDS) + r")\b"
    return counts.where(enough & ~F.col("name").isin(K.NOT_PLACES) & ~F.col("name").rlike(word))


def theme_overlap(packed: DataFrame, seed_day: str, least: float = 0.0, n: int = 20) -> DataFrame:
    """Jaccard of each day's themes with the seed day's n most frequent ones, and up to five shared themes."""
    seed = theme_counts(packed.where(F.col("event_day") == F.lit(seed_day).cast("date")), n).agg(F.array_sort(F.collect_set("theme")).alias("seed"))
    names = packed.select("event_day", F.explode(F.split("V2Themes", ";")).alias("entry")).select("event_day", F.split_part("entry", F.lit(","), F.lit(1)).alias("theme"))
    days = names.where("theme <> ''").groupBy("event_day").agg(F.collect_set("theme").alias("themes")).crossJoin(F.broadcast(seed))
    shared, every = F.array_intersect("themes", "seed"), F.array_union("themes", "seed")
    score = F.round(F.size(shared) / F.size(every), 3)
    return days.select("event_day", score.alias("jaccard"), F.array_join(F.slice(F.array_sort(shared), 1, 5), ";").alias("shared")).where(F.col("jaccard") >= least)


def profile(events: DataFrame) -> DataFrame:
    placed = F.col("ActionGeo_Lat").isNotNull() & F.col("ActionGeo_Long").isNotNull()
    return events.agg(F.count("*").alias("n_rows"), F.min("SQLDATE").alias("first_day"), F.max("SQLDATE").alias("last_day"), F.count_distinct("SQLDATE").alias("days"), F.round(F.lit(100.0) * S.share(placed) / F.count("*"), 2).alias("placed_pct"))


def coverage(events: DataFrame, derived_ids: DataFrame, below: float = 0.9) -> DataFrame:
    """Days of which less than `below` of the events have derived rows (derived_ids: global_event_id)."""
    ids = derived_ids.select("global_event_id").distinct()
    days = events.join(ids, events["GlobalEventID"] == ids["global_event_id"], "left").groupBy("SQLDATE").agg(F.count("*").alias("events"), F.count("global_event_id").alias("derived"))
    return days.where(F.col("derived") < below * F.col("events"))


def reconcile(source: DataFrame, target: DataFrame, key: str, columns: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Rows only in source or target, and unequal values by column: (check, n). Numbers may differ by tolerance; nulls are equal."""
    s, t = source.select(F.col(key), *(F.col(c).alias(f"s_{c}") for c in columns), F.lit(1).alias("in_s")), target.select(F.col(key), *(F.col(c).alias(f"t_{c}") for c in columns), F.lit(1).alias("in_t"))
    both = s.join(t, key, "full_outer")

    def differs(c: str) -> Column:
        a, b = F.col(f"s_{c}"), F.col(f"t_{c}")
        numeric = dict(source.dtypes)[c] in ("double", "float")
        same = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) < tolerance, F.lit(False)) if numeric else a.eqNullSafe(b)
        return F.col("in_s").isNotNull() & F.col("in_t").isNotNull() & ~same

    checks = [("only_source", F.col("in_t").isNull()), ("only_target", F.col("in_s").isNull()), *((f"differs_{c}", differs(c)) for c in columns)]
    wide = both.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in checks))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n, _ in checks))))
