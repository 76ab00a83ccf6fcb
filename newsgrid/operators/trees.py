"""Forecasts by gradient-boosted trees: inputs of windows, fits with early stopping, chosen configurations, seeds, serving."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrid.operators.series import KEY

HISTORY = 14
LAGS = [f"lag{i}" for i in range(HISTORY)]
LAST = [f"last{i}" for i in range(1, 16)]
NUMBERS = [*LAGS, *LAST, "seasonal_log", "h"]
CATEGORIES = ["weekday", "kind", "measure"]


@dataclass(frozen=True)
class Config:
    """target: residual (against the value a week before) or log; loss: squared or absolute; series_id: a category, too."""

    target: str = "residual"
    loss: str = "squared"
    series_id: bool = False
    depth: int = 5

    def __str__(self) -> str:
        return f"{self.target}/{self.loss}/{'series' if self.series_id else 'kinds'}/{self.depth}"


#: Targets and losses are tried first, then one change each to the best of them.
TRIALS = [Config(t, loss) for t in ("residual", "log") for loss in ("squared", "absolute")]
VARIANTS = [{"series_id": True}, {"depth": 4}, {"depth": 6}]


def tree_rows(windows: DataFrame, features: DataFrame, horizon: int = 7) -> DataFrame:
    """One row for each window and day ahead: the window's 14 log counts, the other 15 features of its last day
    (features: series.features), the log count a week before the day, days ahead, weekday, kind of series and measure.

    windows: series.windows. A window whose last day has no features is left out.
    """
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    last = features.select(*KEY, *(F.col(f"x{i}").alias(f"last{i}") for i in range(1, 16)))
    rows = windows.join(last, KEY).select(*KEY, "measure", "x", "target", "scale", *LAST, h)
    seasonal = F.element_at("x", F.size("x") - 6 + F.pmod(F.col("h") - 1, F.lit(7)))
    return rows.select(
        *KEY, "measure", "scale", "h",
        F.element_at("target", F.col("h")).alias("y"),
        seasonal.alias("seasonal"),
        F.log1p(seasonal).alias("seasonal_log"),
        *(F.log1p(F.col("x")[i]).alias(c) for i, c in enumerate(LAGS)),
        *LAST,
        F.weekday(F.date_add("event_date", F.col("h"))).alias("weekday"),
        F.split_part("series_id", F.lit(":"), F.lit(1)).alias("kind"),
    )


def label(target: str) -> Column:
    """What a tree learns: the log count, or how far it is from that of a week before."""
    y = F.log1p("y")
    return {"residual": y - F.col("seasonal_log"), "log": y}[target]


def counts(target: str, prediction: str = "prediction") -> Column:
    """A learned value as a count, never below 0."""
    log = {"residual": F.col(prediction) + F.col("seasonal_log"), "log": F.col(prediction)}[target]
    return F.greatest(F.lit(0.0), F.expm1(log))


def fit(rows: DataFrame, config: Config, iterations: int = 12, seed: int = 2025, subsample: float = 1.0, most_categories: int = 4096) -> PipelineModel:
    """Indexers, assembler and trees fitted to rows whose part is train; those of part validation stop it early.

    Series as a category need a bin each in every node's statistics, so more than most_categories of them are refused; kind
    and measure carry over to any number of series.
    """
    names = CATEGORIES + (["series_id"] if config.series_id else [])
    bins = 32
    if config.series_id:
        bins = max(bins, rows.agg(F.count_distinct("series_id")).first()[0] + 1)
        if bins > most_categories:
            raise ValueError(f"{bins} series are too many for a category: leave series_id out")
    indexed = StringIndexer(inputCols=names, outputCols=[c + "_id" for c in names], handleInvalid="keep", stringOrderType="alphabetAsc")
    inputs = VectorAssembler(inputCols=[*NUMBERS, *(c + "_id" for c in names)], outputCol="features")
    trees = GBTRegressor(labelCol="label", lossType=config.loss, maxIter=iterations, maxDepth=config.depth, maxBins=bins, minInstancesPerNode=20, subsamplingRate=subsample, validationIndicatorCol="held", validationTol=1e-5, seed=seed)
    known = rows.where("part IN ('train', 'validation')").withColumns({"label": label(config.target), "held": F.col("part") == "validation"})
    return Pipeline(stages=[indexed, inputs, trees]).fit(known)


def forecasts(model: PipelineModel, config: Config, rows: DataFrame) -> DataFrame:
    """rows with p, the forecast count."""
    return model.transform(rows).withColumn("p", counts(config.target)).select(*rows.columns, "p")


def error(rows: DataFrame, p: str = "p") -> float:
    """Mean absolute error; one number reaches the driver."""
    return rows.agg(F.round(F.avg(F.abs(F.col(p) - F.col("y"))), 6)).first()[0]


def choose(rows: DataFrame, trials: list[Config] = TRIALS, variants: list[dict] = VARIANTS, iterations: int = 12, seed: int = 2025, at_once: int = 2) -> tuple[Config, dict[Config, tuple[PipelineModel, float]]]:
    """The configuration with the least error on the validation days, and all models with their errors.

    First the trials, then each variant of the best of them; of equal errors the one tried first counts. at_once fits run
    side by side, as jobs of their own. Test days take no part.
    """
    validation = rows.where("part = 'validation'")

    def run(config: Config) -> tuple[PipelineModel, float]:
        model = fit(rows, config, iterations, seed)
        return model, error(forecasts(model, config, validation))

    tried: dict[Config, tuple[PipelineModel, float]] = {}

    def try_all(configs: Iterable[Config]) -> Config:
        new = [c for c in dict.fromkeys(configs) if c not in tried]
        with ThreadPool(at_once) as pool:
            tried.update(zip(new, pool.map(run, new)))
        return min(tried, key=lambda c: tried[c][1])

    best = try_all(trials)
    return try_all(Config(**{**vars(best), **v}) for v in variants), tried


def seed_errors(rows: DataFrame, config: Config, seeds: tuple[int, ...] = (42, 1, 2), iterations: int = 12, subsample: float = 0.8) -> list[tuple[int, float]]:
    """(seed, error on the test days) of fits that see other samples of rows in each tree."""
    test = rows.where("part = 'test'")
    return [(s, error(forecasts(fit(rows, config, iterations, s, subsample), config, test))) for s in seeds]


def served_rows(long: DataFrame, series: DataFrame, origins: DataFrame, horizon: int = 7) -> DataFrame:
    """The columns of tree_rows that a model reads, built as serving does: for each asked origin (series_id, measure,
    event_date) from that series' own days alone, in plain Python, one series a call.

    long: series.measures of series; a series' days are as many as its span has. Origins with under 14 days are left out.
    """
    import numpy as np
    import pandas as pd

    values = [c for c in series.columns if c not in KEY]
    by_measure = long.groupBy(*KEY).pivot("measure", ["total", "conflict", "cooperation", "protest"]).agg(F.first("y"))
    days = series.select(*KEY, *values).join(by_measure, KEY)
    schema = f"series_id string, measure string, event_date date, h int, seasonal double, {', '.join(f'{c} double' for c in [*LAGS, *LAST, 'seasonal_log'])}, weekday int, kind string"

    def serve(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("event_date", ignore_index=True)
        place = {d: i for i, d in enumerate(own["event_date"])}
        n = own["total_events"].to_numpy(float)
        last = {i: _last_features(own.iloc[i], n[max(0, i - 29) : i + 1]) for i in {place.get(d, -1) for d in asked["asked_day"]} if i >= HISTORY - 1}
        out = []
        for measure, day in zip(asked["asked_measure"], asked["asked_day"]):
            i = place.get(day, -1)
            if i not in last:
                continue
            past = own[measure].to_numpy(float)[i - HISTORY + 1 : i + 1]
            for h in range(1, horizon + 1):
                seasonal = past[HISTORY - 7 + (h - 1) % 7]
                out.append((key[0], measure, day, h, seasonal, *np.log1p(past), *last[i], np.log1p(seasonal), (day.weekday() + h) % 7, key[0].split(":")[0]))
        return pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    # names of their own, as origins may come from series itself
    asked = origins.select(F.col("series_id").alias("asked_id"), F.col("measure").alias("asked_measure"), F.col("event_date").alias("asked_day")).distinct()
    return days.groupBy("series_id").cogroup(asked.groupBy("asked_id")).applyInPandas(serve, schema)


def _last_features(today, n) -> list[float]:
    """Features 1 to 15 of a day, n being the counts of up to 30 days that end with it."""
    import math

    week = n[-7:]
    most, base = max(n[-1], 1.0), max(week.mean(), 1.0)
    at = [i - (len(week) - 1) / 2 for i in range(len(week))]
    slope = sum(a * v for a, v in zip(at, week)) / max(sum(a * a for a in at), 1e-9)
    dow = today["event_date"].weekday() * 2 * math.pi / 7
    doy = today["event_date"].timetuple().tm_yday * 2 * math.pi / 366
    return [
        today["conflict_events"] / most, today["cooperation_events"] / most, float(today["avg_goldstein"]) / 10, float(today["avg_tone"]) / 10,
        math.log1p(today["total_articles"]), math.sin(dow), math.cos(dow), math.sin(doy), math.cos(doy),
        math.log1p(week.mean()), math.log1p(n[-14:].mean()), math.log1p(n.mean()),
        min(n[-1] / base, 10.0) / 10, min(week.std() / base, 10.0) / 10, max(-1.0, min(1.0, slope / base)),
    ]
