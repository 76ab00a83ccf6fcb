"""Boosted trees: held-out errors, the choice of a configuration, samples by seed, inputs as serving builds them."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgrid.operators import series as T
from newsgrid.operators import trees as B

SCHEMA = "series_id string, event_date date, total_events long, conflict_events long, cooperation_events long, protest_events long, avg_goldstein double, avg_tone double, total_articles long"


@pytest.fixture(scope="module")
def series(spark):
    """Two series of 300 days, busier once a week, one with gaps, and one too short for any window."""
    rng = np.random.default_rng(3)
    rows = []
    for name, days, mean in (("country:A", 300, 20), ("actor:B", 300, 6), ("actor:SHORT", 13, 5)):
        for i in range(days):
            if name == "actor:B" and i % 11 == 5:
                continue
            n = int(rng.poisson(mean + mean * (i % 7 == 0)))
            rows.append((name, date(2024, 1, 1) + timedelta(i), n, n // 3, n // 2, n // 9, float(rng.normal()), float(rng.normal()), 3 * n))
    return T.densify(spark.createDataFrame(rows, SCHEMA))


@pytest.fixture(scope="module")
def rows(series):
    out = T.split(B.tree_rows(T.windows(T.measures(series)), T.features(series)), 7, 0.2, 0.2)
    return out.where("part IS NOT NULL").cache()


def baseline(rows):
    return B.error(rows, "seasonal")


def test_inputs_of_one_window(series, rows):
    r = rows.where("series_id = 'country:A' AND measure = 'total' AND event_date = DATE '2024-02-01' AND h = 3").first()
    y = {d.event_date: d.total_events for d in series.where("series_id = 'country:A'").collect()}
    at = lambda k: y[date(2024, 2, 1) + timedelta(k)]
    assert [r[c] for c in B.LAGS] == pytest.approx([np.log1p(at(k)) for k in range(-13, 1)])
    assert (r.y, r.seasonal, r.weekday, r.kind) == (at(3), at(-4), 6, "country")
    assert r.last10 == pytest.approx(np.log1p(np.mean([at(k) for k in range(-6, 1)])))
    assert rows.where("series_id = 'actor:SHORT'").isEmpty()


def test_the_chosen_configuration_has_the_least_error_and_beats_the_baseline(rows):
    trials = [B.Config("residual", "squared", depth=3), B.Config("log", "absolute", depth=3)]
    best, tried = B.choose(rows, trials, [{"series_id": True}, {}], iterations=6)
    assert len(tried) == 3  # the variant without a change is not fitted again
    assert tried[best][1] == min(e for _, e in tried.values())
    test = rows.where("part = 'test'")
    assert B.error(B.forecasts(tried[best][0], best, test)) < baseline(test)
    again = B.error(B.forecasts(B.fit(rows, best, 6), best, rows.where("part = 'validation'")))
    assert again == pytest.approx(tried[best][1], abs=1e-6)


def test_test_days_take_no_part_in_a_fit(rows):
    config = B.Config(depth=2)
    other = rows.withColumn("y", F.when(F.col("part") == "test", F.col("y") * 50).otherwise(F.col("y")))
    one, two = (B.error(B.forecasts(B.fit(r, config, 2), config, rows.where("part = 'validation'"))) for r in (rows, other))
    assert one == two


def test_seeds_differ_and_repeat(rows):
    config = B.Config(depth=3)
    errors = dict(B.seed_errors(rows, config, (1, 2), 3, 0.5))
    assert errors[1] != errors[2]
    assert dict(B.seed_errors(rows, config, (1,), 3, 0.5))[1] == pytest.approx(errors[1], abs=1e-6)


def test_too_many_series_for_a_category_are_refused(rows):
    with pytest.raises(ValueError, match="too many"):
        B.fit(rows, B.Config(series_id=True), 1, most_categories=30)


def test_serving_builds_the_same_inputs(series, rows):
    long = T.measures(series)
    training = B.tree_rows(T.windows(long), T.features(series))
    origins = training.where("dayofmonth(event_date) % 9 = 1").select(*T.KEY, "measure").distinct()
    extra = series.sparkSession.createDataFrame([("actor:SHORT", date(2024, 1, 13), "total"), ("country:A", date(2030, 1, 1), "total"), ("none", date(2024, 3, 1), "total")], "series_id string, event_date date, measure string")
    served = B.served_rows(long, series, origins.unionByName(extra))
    keys = [*T.KEY, "measure", "h"]
    assert served.count() == 7 * origins.count()  # an unknown series or day, or a short history, gives none
    met = training.alias("t").join(served.alias("s"), keys)
    assert met.count() == served.count()
    gaps = [F.max(F.abs(F.col(f"t.{c}") - F.col(f"s.{c}"))) for c in ["seasonal", *B.NUMBERS[:-1], "weekday"]]
    assert max(met.agg(*gaps).first()) < 1e-9
    model = B.fit(rows, B.Config(depth=2), 2)
    one, two = (B.forecasts(model, B.Config(depth=2), met.select(*keys, *(f"{side}.{c}" for c in ["seasonal", *B.NUMBERS[:-1], "weekday", "kind"]))) for side in "ts")
    assert one.join(two.withColumnRenamed("p", "q"), keys).where("abs(p - q) > 1e-9").isEmpty()
