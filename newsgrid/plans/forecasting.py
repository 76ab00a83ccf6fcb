"""Series, features, forecasts and their evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from newsgrid.operators import extra as X
from newsgrid.operators import series as T
from newsgrid.registry import count_sql, mean_sql, query

METRICS = f"COUNT(*) AS total_events, {count_sql('GoldsteinScale < 0')} AS conflict_events, {count_sql('GoldsteinScale > 0')} AS cooperation_events, {count_sql("EventRootCode = '14'")} AS protest_events, {mean_sql('GoldsteinScale')} AS avg_goldstein, {mean_sql('AvgTone')} AS avg_tone, CAST(SUM(NumArticles) AS BIGINT) AS total_articles"
SERIES_IDS = """ids AS (SELECT 'global:ALL' AS series_id, * FROM fact UNION ALL SELECT 'country:' || ActionGeo_CountryCode, * FROM fact WHERE ActionGeo_CountryCode <> ''
  UNION ALL SELECT 'country_pair:' || least(Actor1CountryCode, Actor2CountryCode) || '-' || greatest(Actor1CountryCode, Actor2CountryCode), * FROM fact WHERE Actor1CountryCode <> Actor2CountryCode
  UNION ALL SELECT 'event_root:' || EventRootCode, * FROM fact UNION ALL SELECT 'event_code:' || EventCode, * FROM fact)"""


@query("e25_event_series", f", {SERIES_IDS} SELECT series_id, SQLDATE AS event_date, {METRICS} FROM ids WHERE series_id IS NOT NULL GROUP BY 1, 2", "fact")
def _event_series(fact):
    return T.event_series(fact)


@query(
    "e27_actor_series",
    f", z AS (SELECT * REPLACE (coalesce(GoldsteinScale, 0) AS GoldsteinScale, coalesce(AvgTone, 0) AS AvgTone) FROM fact), ids AS (SELECT 'actor:' || Actor1Name AS series_id, * FROM z UNION ALL SELECT 'actor:' || Actor2Name, * FROM z UNION ALL SELECT 'actor_pair:' || least(Actor1Name, Actor2Name) || ' :: ' || greatest(Actor1Name, Actor2Name), * FROM z WHERE Actor1Name IS NOT NULL AND Actor2Name IS NOT NULL) SELECT series_id, SQLDATE AS event_date, {METRICS} FROM ids WHERE series_id IS NOT NULL GROUP BY 1, 2",
    "fact",
)
def _actor_series(fact):
    return T.actor_series(fact)


@query("e29_largest_series", f", {SERIES_IDS} SELECT series_id, COUNT(*) AS total, split_part(series_id, ':', 1) AS kind, CAST(row_number() OVER (PARTITION BY split_part(series_id, ':', 1) ORDER BY COUNT(*) DESC, series_id) AS INTEGER) AS rank FROM ids WHERE series_id IS NOT NULL GROUP BY 1 QUALIFY rank <= 5", "fact")
def _largest(fact):
    return T.largest(T.event_series(fact), 5)


DENSE = """, spans AS (SELECT series_id, min(event_date) AS a, max(event_date) AS z FROM series GROUP BY 1),
days AS (SELECT series_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS event_date FROM spans),
dense AS (SELECT d.series_id, d.event_date, coalesce(total_events, 0) AS total_events, CAST(coalesce(conflict_events, 0) AS BIGINT) AS conflict_events, CAST(coalesce(cooperation_events, 0) AS BIGINT) AS cooperation_events, CAST(coalesce(protest_events, 0) AS BIGINT) AS protest_events,
  coalesce(avg_goldstein, 0) AS avg_goldstein, coalesce(avg_tone, 0) AS avg_tone, CAST(coalesce(total_articles, 0) AS BIGINT) AS total_articles FROM days d LEFT JOIN series s ON s.series_id = d.series_id AND s.event_date = d.event_date)"""
LONG = DENSE + """, long AS (SELECT series_id, event_date, 'total' AS measure, CAST(total_events AS DOUBLE) AS y FROM dense UNION ALL SELECT series_id, event_date, 'conflict', conflict_events FROM dense UNION ALL SELECT series_id, event_date, 'cooperation', cooperation_events FROM dense UNION ALL SELECT series_id, event_date, 'protest', protest_events FROM dense)"""
WINDOWS = LONG + """, w AS (SELECT series_id, measure, event_date, y, list(y) OVER (r ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS x, list(y) OVER (r ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS target,
  avg(y) OVER (r ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS scale, avg(y) OVER (r ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS moving_avg_7 FROM long WINDOW r AS (PARTITION BY series_id, measure ORDER BY event_date)),
wins AS (SELECT * FROM w WHERE len(x) = 14 AND len(target) = 7),
hs AS (SELECT *, CAST(unnest([1, 2, 3, 4, 5, 6, 7]) AS INTEGER) AS h FROM wins),
fc AS (SELECT series_id, measure, event_date, scale, h, target[h] AS t, 'naive_last' AS model, x[14] AS p FROM hs UNION ALL SELECT series_id, measure, event_date, scale, h, target[h], 'moving_avg_7', moving_avg_7 FROM hs UNION ALL SELECT series_id, measure, event_date, scale, h, target[h], 'seasonal_naive', x[7 + h] FROM hs)"""


@query("c12_dense_days", DENSE + " SELECT series_id, event_date, total_events, conflict_events, cooperation_events, protest_events, total_articles FROM dense", "series")
def _dense(series):
    return T.densify(series).drop("avg_goldstein", "avg_tone")


@query("n01_measures", LONG + " SELECT * FROM long", "series")
def _measures(series):
    return T.measures(T.densify(series))


@query(
    "n02_features",
    DENSE
    + """, r AS (SELECT *, CAST(total_events AS DOUBLE) AS n, CAST(row_number() OVER k AS DOUBLE) AS i FROM dense WINDOW k AS (PARTITION BY series_id ORDER BY event_date)),
f AS (SELECT *, avg(n) OVER (k ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7, avg(n) OVER (k ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS m14, avg(n) OVER (k ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS m30,
  stddev_pop(n) OVER (k ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sd, coalesce(regr_slope(n, i) OVER (k ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS slope FROM r WINDOW k AS (PARTITION BY series_id ORDER BY event_date))
SELECT series_id, event_date, round(ln(1 + n), 6) + 0.0 AS x0, round(sin((isodow(event_date) - 1) * 2 * pi() / 7), 6) + 0.0 AS x6, round(cos(dayofyear(event_date) * 2 * pi() / 366), 6) + 0.0 AS x9, round(ln(1 + m7), 6) + 0.0 AS x10, round(ln(1 + m14), 6) + 0.0 AS x11, round(ln(1 + m30), 6) + 0.0 AS x12,
  round(least(10, greatest(0, n / greatest(m7, 1))) / 10, 6) + 0.0 AS x13, round(least(10, greatest(0, sd / greatest(m7, 1))) / 10, 6) + 0.0 AS x14, round(least(1, greatest(-1, CASE WHEN isnan(slope) THEN 0 ELSE slope END / greatest(m7, 1))), 6) + 0.0 AS x15 FROM f""",
    "series",
)
def _features(series):
    names = [f"x{i}" for i in (0, 6, 9, 10, 11, 12, 13, 14, 15)]
    return T.features(T.densify(series)).select("series_id", "event_date", *((F.round(c, 6) + 0.0).alias(c) for c in names))


@query("n03_windows", WINDOWS + " SELECT series_id, measure, event_date, array_to_string(list_transform(x, lambda v: CAST(v AS BIGINT)), ',') AS x, array_to_string(list_transform(target, lambda v: CAST(v AS BIGINT)), ',') AS target, x[14] AS naive_last, round(moving_avg_7, 6) AS moving_avg_7 FROM wins", "series")
def _windows(series):
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("long").cast("string")), ",").alias(c)
    return T.windows(T.measures(T.densify(series))).select("series_id", "measure", "event_date", text("x"), text("target"), "naive_last", F.round("moving_avg_7", 6).alias("moving_avg_7"))


def _forecasts(series):
    return T.forecasts(T.windows(T.measures(T.densify(series))))


@query("n14_error_metrics", WINDOWS + " SELECT measure, model, h, COUNT(*) AS n, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(abs(p - t) / greatest(abs(t), 1)) * 100, 6) AS mape FROM fc GROUP BY 1, 2, 3", "series")
def _metrics(series):
    return T.error_metrics(_forecasts(series), ["measure", "model", "h"])


@query("n16_win_rate", WINDOWS + ", e AS (SELECT series_id, measure, avg(CASE WHEN model = 'moving_avg_7' THEN abs(p - t) END) AS m, avg(CASE WHEN model = 'seasonal_naive' THEN abs(p - t) END) AS s FROM fc GROUP BY 1, 2) SELECT COUNT(*) AS n_series, round(avg(CASE WHEN m < s - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM e", "series")
def _win_rate(series):
    return T.win_rate(_forecasts(series), "moving_avg_7", "seasonal_naive")


SPLIT = WINDOWS + """, sp AS (SELECT min(event_date) AS a, datediff('day', min(event_date), max(event_date)) + 8 AS n FROM fc),
parts AS (SELECT fc.*, datediff('day', a, event_date) + 1 AS pos, floor(n * (1 - 0.15 - 0.15)) AS v, floor(n * (1 - 0.15)) AS u FROM fc, sp),
named AS (SELECT *, CASE WHEN pos + 6 < v THEN 'train' WHEN pos >= v AND pos + 6 < u THEN 'validation' WHEN pos >= u THEN 'test' END AS part FROM parts)"""


@query("n13_leak_free_split", SPLIT + " SELECT part, COUNT(*) AS n, min(event_date) AS first_day, max(event_date) AS last_day FROM named GROUP BY 1", "series")
def _split(series):
    return T.split(_forecasts(series), 7, 0.15, 0.15).groupBy("part").agg(F.count("*").alias("n"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))


BINS = "CASE WHEN scale >= 1000 THEN 3 WHEN scale >= 100 THEN 2 WHEN scale >= 10 THEN 1 ELSE 0 END"
LOGS = SPLIT + f""", fit AS (SELECT h, {BINS} AS b, ln(1 + t) - ln(1 + p) AS r FROM named WHERE part = 'validation' AND model = 'moving_avg_7'),
q AS (SELECT h, b, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi FROM fit GROUP BY 1, 2 HAVING COUNT(*) >= 200), q0 AS (SELECT h, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi FROM fit GROUP BY 1),
iv AS (SELECT n.*, {BINS} AS size_bin, greatest(0, exp(ln(1 + p) + coalesce(q.lo, q0.lo)) - 1) AS low, greatest(0, exp(ln(1 + p) + coalesce(q.hi, q0.hi)) - 1) AS high FROM named n JOIN q0 ON q0.h = n.h LEFT JOIN q ON q.h = n.h AND q.b = {BINS} WHERE part = 'test' AND model = 'moving_avg_7')"""


@query("n22_interval_quality", LOGS + " SELECT size_bin, h, COUNT(*) AS n, round(avg(CASE WHEN t >= low - 1e-9 AND t <= high + 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(high - low), 4) AS width FROM iv GROUP BY 1, 2", "series")
def _intervals(series):
    rows = T.split(_forecasts(series).where("model = 'moving_avg_7'"), 7, 0.15, 0.15)
    return T.interval_quality(T.with_intervals(rows.where("part = 'test'"), T.log_intervals(rows.where("part = 'validation'"))), ["size_bin", "h"])


_QUALITY = "SELECT '{model}' AS model, size_bin, round(avg(CASE WHEN t >= low - 1e-9 AND t <= high + 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(high - low), 4) AS width FROM {iv} GROUP BY size_bin"
_OTHER = re.sub(r"\b(fit|q0|q|iv)\b", r"\1_2", LOGS.removeprefix(SPLIT)).replace("moving_avg_7", "seasonal_naive")
GAPS = LOGS + _OTHER + f", quality AS ({_QUALITY.format(model='moving_avg_7', iv='iv')} UNION ALL {_QUALITY.format(model='seasonal_naive', iv='iv_2')}), gaps AS (SELECT model, round(max(abs(coverage - 0.8)), 6) AS worst_gap, round(avg(width), 4) AS mean_width FROM quality GROUP BY 1)"


def _both_qualities(series):
    """Quality by size of the intervals of two forecasts, each with the quantiles of its own residuals."""
    rows = T.split(_forecasts(series), 7, 0.15, 0.15)

    def of(model: str):
        own = rows.where(F.col("model") == model)
        found = T.with_intervals(own.where("part = 'test'"), T.log_intervals(own.where("part = 'validation'")))
        return T.interval_quality(found, ["size_bin"]).withColumn("model", F.lit(model))

    return of("moving_avg_7").unionByName(of("seasonal_naive"))


@query("n24_interval_gaps", GAPS + " SELECT * FROM gaps", "series")
def _gaps(series):
    return X.interval_gaps(_both_qualities(series))


@query("n25_chosen_intervals", GAPS + " SELECT * FROM gaps ORDER BY worst_gap, mean_width, model LIMIT 1", "series")
def _chosen_intervals(series):
    return X.choose_method(_both_qualities(series))


@query(
    "n23_rolling_intervals",
    WINDOWS
    + """, rr AS (SELECT event_date, h, ln(1 + t) - ln(1 + p) AS r FROM fc WHERE model = 'seasonal_naive' AND measure = 'total'), a AS (SELECT DISTINCT event_date + 1 AS fit_day FROM rr)
SELECT a.fit_day, h, COUNT(*) AS n, round(quantile_cont(r, 0.1), 6) AS low_q, round(quantile_cont(r, 0.9), 6) AS high_q FROM a JOIN rr ON datediff('day', rr.event_date + 7, a.fit_day) BETWEEN 1 AND 14 GROUP BY 1, 2""",
    "series",
)
def _rolling(series):
    rows = _forecasts(series).where("model = 'seasonal_naive' AND measure = 'total'")
    return T.rolling_intervals(rows, 14, 7).select("fit_day", "h", "n", F.round("low_q", 6).alias("low_q"), F.round("high_q", 6).alias("high_q"))


@query(
    "n04_excitation_forecast",
    LONG
    + """, b AS (SELECT *, CAST(row_number() OVER k AS DOUBLE) AS i, COUNT(*) OVER (PARTITION BY series_id, measure) AS n, lag(y) OVER k AS before, avg(y) OVER (PARTITION BY series_id, measure) AS mean FROM long WINDOW k AS (PARTITION BY series_id, measure ORDER BY event_date)),
s AS (SELECT series_id, measure, avg(y) AS mean, quantile_cont(y, 0.5) AS median, sum((y - mean) * (before - mean)) / nullif(sum((y - mean) * (y - mean)), 0) AS ac, avg(CASE WHEN i > n - 7 THEN y END) AS m7, regr_slope(CASE WHEN i > n - 21 THEN y END, i) AS slope, max(event_date) AS event_date FROM b GROUP BY 1, 2),
c AS (SELECT *, greatest(0, 0.65 * mean + 0.35 * median) AS base, coalesce(least(0.85, greatest(0.05, ac)), 0.25) AS alpha, CAST(unnest([1, 2, 3, 4, 5, 6, 7]) AS INTEGER) AS h FROM s)
SELECT series_id, measure, event_date, h, round(greatest(0, base + greatest(0, m7 - base) * alpha * exp(-h * ln(2) / 7) + coalesce(slope, 0) * h * exp(-h / 21)), 6) AS p FROM c""",
    "series",
)
def _excitation(series):
    return T.excitation_forecast(T.measures(T.densify(series))).withColumn("p", F.round("p", 6))


@query("n19_horizon_scale", WINDOWS + ", u AS (SELECT h, t / p AS ratio, sum(p) AS w FROM fc WHERE model = 'moving_avg_7' AND measure = 'total' AND p > 1e-6 GROUP BY 1, 2), r AS (SELECT h, ratio, sum(w) OVER (PARTITION BY h ORDER BY ratio) AS run, sum(w) OVER (PARTITION BY h) AS total FROM u) SELECT h, round(min(ratio), 6) AS scale FROM r WHERE run >= total / 2 - 1e-9 GROUP BY 1", "series")
def _scale(series):
    rows = _forecasts(series).where("model = 'moving_avg_7' AND measure = 'total'")
    return T.horizon_scale(rows).withColumn("scale", F.round("scale", 6))


@query("n27_block_bootstrap")
def _bootstrap(spark, sf_dir):
    """Interval of the mean daily error difference of two baselines; resampling cannot be told in SQL, its properties are tested."""
    from newsgrid.sources.adapter import daily_series

    rows = _forecasts(daily_series(spark, sf_dir)).where("measure = 'total' AND h = 1 AND model IN ('moving_avg_7', 'seasonal_naive')")
    e = F.abs(F.col("p") - F.col("y"))
    days = rows.groupBy("event_date").agg(F.avg(F.when(F.col("model") == "moving_avg_7", e)).alias("a"), F.avg(F.when(F.col("model") == "seasonal_naive", e)).alias("b"))
    first = rows.agg(F.min("event_date").alias("first"))
    values = days.crossJoin(F.broadcast(first)).select(F.datediff("event_date", "first").cast("long").alias("position"), (F.col("a") - F.col("b")).alias("value"))
    return T.block_bootstrap(values)
