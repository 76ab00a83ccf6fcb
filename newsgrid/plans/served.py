"""Served forecasts, series from stored lists, checks of stored rows, decisions between models."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.operators import events as E
from newsgrid.operators import rollups as R
from newsgrid.operators import served as V
from newsgrid.operators import series as T
from newsgrid.operators import texts as X
from newsgrid.plans.events import PRINTS_SQL
from newsgrid.plans.extra import CONTEXT
from newsgrid.plans.forecasting import LONG, SERIES_IDS, WINDOWS, _forecasts
from newsgrid.plans.rollups import SUMMARY_SQL
from newsgrid.registry import ORACLE_SQL, count_sql, query
from newsgrid.sources.stored import stored

STATS = """, aged AS (SELECT *, row_number() OVER (PARTITION BY series_id, measure ORDER BY event_date DESC) AS age FROM long),
stats AS (SELECT series_id, measure, COUNT(*) AS days, CAST(SUM(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active, avg(y) AS mean, avg(y) FILTER (age <= 7) AS recent, stddev_pop(y) FILTER (age <= 30) AS dev FROM aged GROUP BY 1, 2)"""


def _long(series):
    return T.measures(T.densify(series))


def _forecast(series):
    return T.excitation_forecast(_long(series)).withColumn("p", F.round("p", 6))


#: The excitation forecast's SQL as one more table of its WITH list.
_LAST = "SELECT series_id, measure, event_date, h,"
_HEAD, _, _BODY = ORACLE_SQL["n04_excitation_forecast"].rpartition(_LAST)
SERVED = f"{_HEAD.rstrip()}, served AS ({_LAST}{_BODY}){STATS}"


@query(
    "n07_empirical_intervals",
    SERVED
    + " SELECT series_id, measure, h, p, round(greatest(0, p - s), 4) AS low, round(p + s, 4) AS high FROM (SELECT *, CASE WHEN days < 7 THEN greatest(1, p * 0.25) ELSE greatest(dev, p * 0.15) * sqrt(h / 7) END AS s FROM served JOIN stats USING (series_id, measure))",
)
def _intervals(spark, sf_dir):
    from newsgrid.sources.adapter import daily_series

    series = daily_series(spark, sf_dir)
    rows = V.with_empirical_interval(_forecast(series), V.history_stats(_long(series)))
    return rows.select("series_id", "measure", "h", "p", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(
    "n08_forecast_summary",
    SERVED
    + """, ranked AS (SELECT s.series_id, s.measure, s.h, s.p, s.event_date, avg(CASE WHEN l.y <= s.p THEN 1.0 ELSE 0.0 END) AS rank, avg(l.y) AS m FROM served s JOIN long l ON l.series_id = s.series_id AND l.measure = s.measure GROUP BY ALL),
risked AS (SELECT *, round(greatest(0, least(100, 65 * rank + 35 * least(p / greatest(m, 1), 2) / 2)), 4) AS risk FROM ranked),
top AS (SELECT * FROM risked QUALIFY row_number() OVER (PARTITION BY series_id, measure ORDER BY risk DESC, h) = 1)
SELECT series_id, measure, event_date + h AS peak_date, p AS expected_events_peak, CAST(risk AS DOUBLE) AS peak_risk_score, CASE WHEN risk >= 80 THEN 'high' WHEN risk >= 60 THEN 'elevated' WHEN risk >= 35 THEN 'moderate' ELSE 'low' END AS risk_level,
  round(CASE WHEN mean = 0 THEN 0 ELSE (recent - mean) / mean * 100 END, 2) AS recent_vs_history_pct, CASE WHEN days >= 90 AND active / days >= 0.5 THEN 'medium-high' WHEN days >= 30 AND active >= 10 THEN 'medium' ELSE 'low' END AS confidence
FROM top JOIN stats USING (series_id, measure)""",
)
def _summary(spark, sf_dir):
    from newsgrid.sources.adapter import daily_series

    series = daily_series(spark, sf_dir)
    long = _long(series)
    return V.forecast_summary(_forecast(series), long, V.history_stats(long))


EXCITED = ORACLE_SQL["n04_excitation_forecast"].replace("greatest(0, m7 - base)", "greatest(0, coalesce(context, m7) - base)").replace(" FROM s)", " FROM s LEFT JOIN ctx USING (series_id) WHERE measure = 'total')")


@query("n06_context_forecast", f"WITH ctx AS ({CONTEXT}), " + EXCITED.removeprefix("WITH "))
def _context(spark, sf_dir):
    """As n04, its excitation taken from the attention context."""
    from newsgrid.operators.extra import attention_context
    from newsgrid.sources.adapter import daily_series

    dense = T.densify(daily_series(spark, sf_dir))
    context = attention_context(T.features(dense), dense).withColumn("context", F.round("context", 6))
    return V.with_context(T.measures(dense).where("measure = 'total'"), context).withColumn("p", F.round("p", 6))


@query("j29_confidence", LONG + STATS + " SELECT series_id, measure, days, active, CASE WHEN days >= 90 AND active / days >= 0.5 THEN 'medium-high' WHEN days >= 30 AND active >= 10 THEN 'medium' ELSE 'low' END AS confidence FROM stats", "series")
def _confidence(series):
    stats = V.history_stats(_long(series))
    return stats.select("series_id", "measure", "days", "active", V.confidence(F.col("days"), F.col("active")).alias("confidence"))


ACTORS = SUMMARY_SQL + ", best AS (SELECT * FROM top_a)"


def _stored(fact):
    summary = R.daily_summary(fact)
    return V.list_to_json(summary.select("date", "total_events", "conflict_events", "cooperation_events", "top_actors"), "top_actors")


@query("m03_list_rows", f", {ACTORS} SELECT date, name, count FROM best", "fact")
def _rows(fact):
    """The day's first actors, written as JSON and read back as rows."""
    return V.json_rows(_stored(fact).select("date", "top_actors"), "top_actors")


@query("j27_json_lists", f", {ACTORS} SELECT date, '[' || string_agg('{{\"name\":\"' || name || '\",\"count\":' || count || '}}', ',' ORDER BY count DESC, name) || ']' AS top_actors FROM best GROUP BY 1", "fact")
def _json(fact):
    return _stored(fact).select("date", "top_actors")


@query(
    "e30_series_from_lists",
    f", {ACTORS}, days AS (SELECT date, total_events AS total, conflict_events AS c, cooperation_events AS k FROM totals) SELECT 'actor:' || name AS series_id, date AS event_date, count AS events, round(CAST(count * c AS DOUBLE) / greatest(total, 1), 6) AS conflict, round(CAST(count * k AS DOUBLE) / greatest(total, 1), 6) AS cooperation FROM best JOIN days USING (date)",
    "fact",
)
def _list_series(fact):
    return V.series_from_lists(_stored(fact), "top_actors", "actor:")


@query(
    "e30_series_of_all_lists",
    f""", {SUMMARY_SQL}, each AS (SELECT 'actor:' || name AS series_id, date, count FROM top_a UNION ALL SELECT 'country:' || name, date, count FROM top_p UNION ALL SELECT 'event_category:' || type, date, n FROM types)
SELECT series_id, date AS event_date, count AS events, round(CAST(count * conflict_events AS DOUBLE) / greatest(total_events, 1), 6) AS conflict, round(CAST(count * cooperation_events AS DOUBLE) / greatest(total_events, 1), 6) AS cooperation FROM each JOIN totals USING (date)""",
    "fact",
)
def _all_lists(fact):
    summary = R.daily_summary(fact).select("date", "total_events", "conflict_events", "cooperation_events", "top_actors", "top_locations", "event_type_distribution")
    return V.all_list_series(V.list_to_json(V.list_to_json(V.list_to_json(summary, "top_actors"), "top_locations"), "event_type_distribution"))


@query(
    "a20_stored_and_rebuilt",
    f", {SERIES_IDS}, r AS (SELECT series_id, SQLDATE AS d, COUNT(*) AS n FROM ids WHERE series_id IS NOT NULL GROUP BY 1, 2) SELECT split_part(series_id, ':', 1) AS kind, {count_sql('dayofmonth(d) <> 3')} AS matched, CAST(0 AS BIGINT) AS only_stored, {count_sql('dayofmonth(d) = 3')} AS only_rebuilt, {count_sql('dayofmonth(d) = 5')} AS counts_differ, CAST(0 AS BIGINT) AS averages_differ FROM r GROUP BY 1",
    "fact",
)
def _rebuilt(fact):
    """Stored series that lack the 3rd of each month and are one short on the 5th, against the rebuilt ones."""
    rebuilt = T.event_series(fact)
    n = F.when(F.dayofmonth("event_date") == 5, F.col("total_events") - 1).otherwise(F.col("total_events"))
    stored = rebuilt.where(F.dayofmonth("event_date") != 3).withColumn("total_events", n)
    return V.stored_and_rebuilt(stored, rebuilt, T.KEY, ["total_events", "conflict_events"], ["avg_goldstein", "avg_tone"])


@query("a19_recomputed", f", {PRINTS_SQL} SELECT COUNT(*) AS checked, {count_sql('dayofmonth(SQLDATE) = 3')} AS missing, CAST(0 AS BIGINT) AS differs_headline, {count_sql('dayofmonth(SQLDATE) = 5')} AS differs_severity_score FROM fact WHERE GlobalEventID % 97 = 0", "fact")
def _recomputed(fact):
    """The check of a sample is the operator; stored rows here lack the 3rd of each month and are changed on the 5th."""
    day = F.dayofmonth("SQLDATE")
    stored = E.fingerprints(fact).join(fact.select("GlobalEventID", day.alias("day")), F.col("global_event_id") == F.col("GlobalEventID"))
    score = F.when(F.col("day") == 5, F.col("severity_score") + 1).otherwise(F.col("severity_score"))
    stored = stored.where("day <> 3").withColumn("severity_score", score)
    return V.recomputed(fact, stored, E.fingerprints, "global_event_id", ["headline", "severity_score"], 97)


@query("a21_window_arrays", WINDOWS + " SELECT COUNT(*) AS windows, CAST(SUM(len(x)) AS BIGINT) AS inputs, CAST(SUM(list_sum(target)) AS DOUBLE) AS target_sum FROM wins", "series")
def _arrays(series):
    base = series.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("window arrays are written to the folder of spark.checkpoint.dir")
    import uuid

    back = V.window_arrays(T.windows(_long(series)), f"{base.rstrip('/')}/windows-{uuid.uuid4().hex}")
    total = F.aggregate("target", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.agg(F.count("*").alias("windows"), F.sum(F.size("x")).alias("inputs"), F.sum(total).alias("target_sum"))


@query("k03_prepared_texts", "SELECT doc_id, md5(left(text, 8000)) AS digest FROM documents WHERE length(text) > 150")
def _prepared(spark, sf_dir):
    return V.prepared_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.md5("text").alias("digest"))


@query("k04_coverage")
def _coverage(spark, sf_dir):
    """Each event's own page (two of three pages can be read), else the pages most like its headline; the texts come from
    regular expressions over HTML that DuckDB does not share, so tests compare them with plain Python."""
    from newsgrid.sources.adapter import fact as read

    pages = X.article(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("text", F.when(F.col("page_id") % 3 != 0, F.col("text")))
    events = read(spark, sf_dir)
    events = E.detailed(events.select("GlobalEventID", "SOURCEURL"), E.fingerprints(events).select("global_event_id", "headline"))
    return V.with_coverage(events, pages).select("GlobalEventID", "source", "page_id", F.md5("text").alias("digest"), F.to_json("near").alias("near"))


@query("n12_chosen_config", WINDOWS + " SELECT model AS config, round(avg(abs(p - t)), 6) AS validation_mae FROM fc GROUP BY 1 ORDER BY 2, 1 LIMIT 1", "series")
def _chosen(series):
    return V.chosen_config(T.error_metrics(_forecasts(series), ["model"]).select(F.col("model").alias("config"), F.col("mae").alias("validation_mae")))


@query("n30_seed_summary", WINDOWS + ", m AS (SELECT h AS seed, model, round(avg(abs(p - t)), 6) AS mae FROM fc GROUP BY 1, 2) SELECT model, COUNT(*) AS seeds, round(avg(mae), 6) AS mean_mae, round(min(mae), 6) AS least_mae, round(max(mae), 6) AS largest_mae FROM m GROUP BY 1", "series")
def _seeds(series):
    """Horizons stand for seeds here."""
    return V.seed_summary(T.error_metrics(_forecasts(series), ["h", "model"]).select(F.col("h").alias("seed"), "model", "mae"))


@query(
    "n28_decisions",
    WINDOWS
    + """, e AS (SELECT series_id, avg(abs(p - t)) FILTER (model = 'moving_avg_7') AS a, avg(abs(p - t)) FILTER (model = 'seasonal_naive') AS b, avg(CASE WHEN model = 'moving_avg_7' THEN CASE WHEN abs(p - t) <= 3 THEN 1.0 ELSE 0.0 END END) AS ca, avg(CASE WHEN model = 'seasonal_naive' THEN CASE WHEN abs(p - t) <= 3 THEN 1.0 ELSE 0.0 END END) AS cb FROM fc GROUP BY 1)
SELECT series_id, CASE WHEN ca >= 0.75 AND cb >= 0.75 THEN CASE WHEN round(a - b, 6) - 0.05 <= 0 AND round(a - b, 6) + 0.05 >= 0 THEN 'b' WHEN a <= b THEN 'a' ELSE 'b' END WHEN ca >= 0.75 THEN 'a' WHEN cb >= 0.75 THEN 'b' ELSE 'none' END AS decision FROM e""",
    "series",
)
def _decisions(series):
    """By series, coverage is the share of forecasts within three events, and the interval the difference +/- 0.05."""
    error = F.abs(F.col("p") - F.col("y"))
    of = lambda m, v: F.avg(F.when(F.col("model") == m, v))
    good = F.when(error <= 3, 1.0).otherwise(0.0)
    rows = _forecasts(series).groupBy("series_id").agg(of("moving_avg_7", error).alias("a_mae"), of("seasonal_naive", error).alias("b_mae"), of("moving_avg_7", good).alias("a_coverage"), of("seasonal_naive", good).alias("b_coverage"))
    gap = F.round(F.col("a_mae") - F.col("b_mae"), 6)
    return V.decision(rows.withColumns({"lo": gap - 0.05, "hi": gap + 0.05})).select("series_id", "decision")


@query("n28_bootstrap_decisions")
def _resampled_decisions(spark, sf_dir):
    """As n28_decisions, with the interval of each series' daily error difference from moving-block resamples, all series in
    one pass. SQL cannot tell the resamples; tests compare them with NumPy."""
    from newsgrid.sources.adapter import daily_series

    error = F.abs(F.col("p") - F.col("y"))
    of = lambda m, v: F.avg(F.when(F.col("model") == m, v))
    good = F.when(error <= 3, 1.0).otherwise(0.0)
    forecasts = stored(_forecasts(daily_series(spark, sf_dir)).where("model IN ('moving_avg_7', 'seasonal_naive')"))
    rows = forecasts.groupBy("series_id").agg(of("moving_avg_7", error).alias("a_mae"), of("seasonal_naive", error).alias("b_mae"), of("moving_avg_7", good).alias("a_coverage"), of("seasonal_naive", good).alias("b_coverage"))
    days = forecasts.groupBy("series_id", F.col("event_date").alias("position")).agg((of("moving_avg_7", error) - of("seasonal_naive", error)).alias("value"))
    return V.decision(rows.join(T.block_bootstrap(days, ["series_id"]).withColumnsRenamed({"low": "lo", "high": "hi"}), "series_id")).select("series_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "decision")


@query("n29_same_features")
def _same(spark, sf_dir):
    """Features as training builds them, over all series at once, and as serving does, a series' own days read again; SQL
    has no second path to compare, so tests ask for no difference."""
    from newsgrid.sources.adapter import daily_series

    series = daily_series(spark, sf_dir)
    training = T.features(T.densify(series))
    serving = T.features(T.densify(series.repartition("series_id").sortWithinPartitions("series_id", F.desc("event_date"))))
    names = [c for c in training.columns if c not in T.KEY]
    return V.largest_difference(training, serving, T.KEY, names)
