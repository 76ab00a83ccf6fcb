"""Forecasts by boosted trees: their inputs, held-out errors, the chosen configuration, seeds, and inputs as serving builds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgrid.operators import series as T
from newsgrid.operators import served as V
from newsgrid.operators import trees as B
from newsgrid.plans.forecasting import WINDOWS
from newsgrid.registry import query
from newsgrid.sources.adapter import daily_series
from newsgrid.sources.stored import stored

_K = "WINDOW k AS (PARTITION BY series_id ORDER BY event_date)"
#: Features 1 to 15 of each day, as series.features has them, beside the windows.
INPUTS = (
    WINDOWS
    + f""", fr AS (SELECT *, CAST(total_events AS DOUBLE) AS n, greatest(CAST(total_events AS DOUBLE), 1) AS most, CAST(row_number() OVER k AS DOUBLE) AS i, (isodow(event_date) - 1) * 2 * pi() / 7 AS dow, dayofyear(event_date) * 2 * pi() / 366 AS doy FROM dense {_K}),
ff AS (SELECT *, avg(n) OVER (k ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7, avg(n) OVER (k ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS m14, avg(n) OVER (k ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS m30,
  stddev_pop(n) OVER (k ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sd, coalesce(regr_slope(n, i) OVER (k ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS slope FROM fr {_K}),
last AS (SELECT series_id, event_date, conflict_events / most AS last1, cooperation_events / most AS last2, avg_goldstein / 10 AS last3, avg_tone / 10 AS last4, ln(1 + total_articles) AS last5, sin(dow) AS last6, cos(dow) AS last7, sin(doy) AS last8, cos(doy) AS last9, ln(1 + m7) AS last10, ln(1 + m14) AS last11, ln(1 + m30) AS last12,
  least(10, greatest(0, n / greatest(m7, 1))) / 10 AS last13, least(10, greatest(0, sd / greatest(m7, 1))) / 10 AS last14, least(1, greatest(-1, CASE WHEN isnan(slope) THEN 0 ELSE slope END / greatest(m7, 1))) AS last15 FROM ff),
inputs AS (SELECT series_id, measure, event_date, h, x, target[h] AS y, x[7 + h] AS seasonal, l.* EXCLUDE (series_id, event_date), CAST(isodow(event_date + h) - 1 AS INTEGER) AS weekday, split_part(series_id, ':', 1) AS kind FROM hs JOIN last l USING (series_id, event_date))"""
)


def _rows(series: DataFrame) -> DataFrame:
    dense = T.densify(series)
    return B.tree_rows(T.windows(T.measures(dense)), T.features(dense))


def _parts(spark, sf_dir: str) -> DataFrame:
    """All inputs with their part, written once: every fit reads them again."""
    return stored(T.split(_rows(daily_series(spark, sf_dir)), 7, 0.15, 0.15).where("part IS NOT NULL"))


_LAGS_SQL = ", ".join(f"round(ln(1 + x[{i + 1}]), 7) + 0.0 AS {c}" for i, c in enumerate(B.LAGS))
#: The two averages are rounded where the series are derived, and engines settle ties of that apart; n29 compares them.
_COMPARED = [c for c in B.LAST if c not in ("last3", "last4")]
_LAST_SQL = ", ".join(f"round({c}, 7) + 0.0 AS {c}" for c in _COMPARED)


@query("n09_tree_inputs", INPUTS + f" SELECT series_id, measure, event_date, h, {_LAGS_SQL}, {_LAST_SQL}, round(ln(1 + seasonal), 7) + 0.0 AS seasonal_log, weekday, kind, round(ln(1 + y) - ln(1 + seasonal), 7) + 0.0 AS residual FROM inputs", "series")
def _inputs(series):
    numbers = [(F.round(c, 7) + 0.0).alias(c) for c in [*B.LAGS, *_COMPARED]]
    residual = (F.round(B.label("residual"), 7) + 0.0).alias("residual")
    return _rows(series).select("series_id", "measure", "event_date", "h", *numbers, (F.round("seasonal_log", 7) + 0.0).alias("seasonal_log"), "weekday", "kind", residual)


@query("n11_boosted_trees")
def _boosted(spark, sf_dir):
    """Held-out error of boosted trees and of the value a week before, by measure and day ahead; SQL cannot learn trees, so
    tests hold them against the baseline."""
    rows, config = _parts(spark, sf_dir), B.Config()
    out = B.forecasts(B.fit(rows, config), config, rows.where("part = 'test'"))
    both = F.array(F.struct(F.lit("boosted").alias("model"), F.col("p")), F.struct(F.lit("seasonal_naive").alias("model"), F.col("seasonal").alias("p")))
    return T.error_metrics(out.select("measure", "h", "y", F.inline(both)), ["model", "measure", "h"])


@query("n12_tree_config")
def _config(spark, sf_dir):
    """Each configuration tried, its error on the validation days, and whether it was chosen; the chosen one's error on the
    test days, and that of the value a week before. Learned, so tests hold the choice against its own errors."""
    rows = _parts(spark, sf_dir)
    best, tried = B.choose(rows)
    test = rows.where("part = 'test'")
    errors = B.forecasts(tried[best][0], best, test).agg(F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("test_mae"), F.round(F.avg(F.abs(F.col("seasonal") - F.col("y"))), 6).alias("seasonal_mae"))
    table = spark.createDataFrame([(str(c), e, c == best) for c, (_, e) in tried.items()], "config string, validation_mae double, chosen boolean")
    held_out = errors.withColumn("chosen", F.lit(True))
    return table.join(F.broadcast(held_out), "chosen", "left").select("config", "validation_mae", "chosen", "test_mae", "seasonal_mae")


@query("n30_tree_seeds")
def _seeds(spark, sf_dir):
    """Mean and range over seeds of the trees' errors on the test days, each seed with samples of its own."""
    rows = _parts(spark, sf_dir)
    runs = spark.createDataFrame([(s, "boosted", e) for s, e in B.seed_errors(rows, B.Config())], "seed long, model string, mae double")
    return V.seed_summary(runs)


@query("n29_served_inputs")
def _served(spark, sf_dir):
    """One row: model inputs as training builds them (windows over all series) and as serving does (a series' own last days
    in plain Python), over all windows; the largest difference of any input. SQL has no second path to compare."""
    series = T.densify(daily_series(spark, sf_dir))
    long = T.measures(series)
    training = stored(B.tree_rows(T.windows(long), T.features(series)))
    serving = B.served_rows(long, series, training.select("series_id", "measure", "event_date").distinct())
    return V.largest_difference(training, serving, [*T.KEY, "measure", "h"], ["seasonal", *B.NUMBERS[:-1], "weekday"])
