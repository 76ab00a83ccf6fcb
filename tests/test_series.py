"""Properties of splits, intervals and resampling."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgrid.operators import series as T


def long(spark, days=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("s", date(2024, 1, 1) + timedelta(i), "total", float(rng.poisson(20 + 10 * (i % 7 == 0)))) for i in range(days)]
    return spark.createDataFrame(rows, "series_id string, event_date date, measure string, y double")


def test_splits_do_not_leak(spark):
    rows = T.split(T.forecasts(T.windows(long(spark))), 7, 0.2, 0.2)
    ends = {r.part: (r.a, r.z) for r in rows.groupBy("part").agg(F.min("event_date").alias("a"), F.max("event_date").alias("z")).collect()}
    assert ends["train"][1] + timedelta(7) <= ends["validation"][0] + timedelta(1)
    assert ends["validation"][1] + timedelta(7) <= ends["test"][0] + timedelta(1)
    assert None in ends


def test_coverage_is_near_nominal(spark):
    rows = T.forecasts(T.windows(long(spark, 900))).where("model = 'moving_avg_7'")
    fit, held = rows.where("event_date < DATE '2025-03-01'"), rows.where("event_date >= DATE '2025-03-15'")
    quality = T.interval_quality(T.with_intervals(held, T.log_intervals(fit)), ["measure"]).first()
    assert 0.72 <= quality.coverage <= 0.88


def test_bootstrap(spark):
    constant = spark.range(30).select(F.col("id").alias("position"), F.lit(2.0).alias("value"))
    r = T.block_bootstrap(constant, resamples=200).first()
    assert (r.low, r.high, r.mean) == (2.0, 2.0, 2.0)
    wavy = spark.range(60).select(F.col("id").alias("position"), F.sin(F.col("id") / 8).alias("value"))
    noisy = spark.range(60).select(F.col("id").alias("position"), F.sin(F.col("id") * 97).alias("value"))
    a, b = (T.block_bootstrap(x, resamples=400).first() for x in (wavy, noisy))
    assert a.high - a.low > b.high - b.low
    assert T.block_bootstrap(wavy, resamples=400).first() == a


@pytest.mark.parametrize("least", [0, 10**9])
def test_series_filter(spark, least):
    s = spark.createDataFrame([("a", date(2024, 1, 1), 1), ("a", date(2024, 1, 4), 2)], "series_id string, event_date date, total_events long")
    assert T.densify(s, least).count() == (0 if least else 4)
