"""Daily time series: building, densifying, windowed features, baselines, intervals and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrid.functions import scalars as S
from newsgrid.operators.quantiles import quantiles, weighted_medians
from newsgrid.sources.stored import stored

KEY = ["series_id", "event_date"]


def _metrics() -> list[Column]:
    return [
        F.count("*").alias("total_events"),
        S.share(S.conflict(0)).alias("conflict_events"),
        S.share(S.cooperation(0)).alias("cooperation_events"),
        S.share(S.protest()).alias("protest_events"),
        S.mean(F.col("GoldsteinScale")).alias("avg_goldstein"),
        S.mean(F.col("AvgTone")).alias("avg_tone"),
        F.sum("NumArticles").alias("total_articles"),
    ]


def event_series(events: DataFrame) -> DataFrame:
    """Daily metrics for the world, countries, unordered country pairs, root codes and codes: one scan, one aggregation."""
    a, b = F.col("Actor1CountryCode"), F.col("Actor2CountryCode")
    ids = F.array_compact(
        F.array(
            F.lit("global:ALL"),
            F.concat(F.lit("country:"), S.filled(F.col("ActionGeo_CountryCode"))),
            F.when(a.isNotNull() & b.isNotNull() & (a != "") & (b != "") & (a != b), F.concat(F.lit("country_pair:"), F.least(a, b), F.lit("-"), F.greatest(a, b))),
            F.concat(F.lit("event_root:"), S.filled(F.col("EventRootCode"))),
            F.concat(F.lit("event_code:"), S.filled(F.col("EventCode"))),
        )
    )
    rows = events.select(F.explode(ids).alias("series_id"), F.col("SQLDATE").alias("event_date"), "GoldsteinScale", "AvgTone", "NumArticles", "EventRootCode")
    return rows.groupBy(*KEY).agg(*_metrics())


def actor_series(events: DataFrame) -> DataFrame:
    """Daily metrics of actors and unordered actor pairs; null scores count as 0; an event of an actor with itself counts twice."""
    one, two = S.filled(S.actor_name(F.col("Actor1Name"))), S.filled(S.actor_name(F.col("Actor2Name")))
    pair = F.when(one.isNotNull() & two.isNotNull(), F.concat(F.lit("actor_pair:"), F.concat_ws(" :: ", F.array_sort(F.array(one, two)))))
    ids = F.array_compact(F.array(F.concat(F.lit("actor:"), one), F.concat(F.lit("actor:"), two), pair))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    rows = events.select(F.explode(ids).alias("series_id"), F.col("SQLDATE").alias("event_date"), zero("GoldsteinScale"), zero("AvgTone"), "NumArticles", "EventRootCode")
    return rows.groupBy(*KEY).agg(*_metrics())


def largest(series: DataFrame, n: int) -> DataFrame:
    """The n series of each kind with the most events."""
    totals = series.groupBy("series_id").agg(F.sum("total_events").alias("total")).withColumn("kind", F.split_part("series_id", F.lit(":"), F.lit(1)))
    order = Window.partitionBy("kind").orderBy(F.desc("total"), "series_id")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def densify(series: DataFrame, least: int = 0) -> DataFrame:
    """Every day from a series' first to its last, absent ones as 0; series with fewer than `least` events in all are left out."""
    spans = series.groupBy("series_id").agg(F.min("event_date").alias("a"), F.max("event_date").alias("z"), F.sum("total_events").alias("n")).where(F.col("n") >= least)
    days = spans.select("series_id", F.explode(F.sequence("a", "z")).alias("event_date"))
    values = [c for c in series.columns if c not in KEY]
    return days.join(series, KEY, "left").select(*KEY, *(F.coalesce(c, F.lit(0)).alias(c) for c in values))


def measures(series: DataFrame) -> DataFrame:
    """(series_id, event_date, measure, y): total, conflict, cooperation and protest counts below each other."""
    names = ["total", "conflict", "cooperation", "protest"]
    stack = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"{m}_events").cast("double").alias("y")) for m in names))
    return series.select(*KEY, F.inline(stack))


def _rows(n: int, by: tuple[str, ...] = ("series_id",), day: str = "event_date"):
    return Window.partitionBy(*by).orderBy(day).rowsBetween(-(n - 1), 0)


def features(series: DataFrame) -> DataFrame:
    """The 16 features of each day: counts and shares, averages, calendar, rolling means, spike, volatility and trend."""
    n, d = F.col("total_events").cast("double"), F.col("event_date")
    most = F.greatest(n, F.lit(1.0))
    dow, doy = F.weekday(d) * (2 * 3.141592653589793 / 7), F.dayofyear(d) * (2 * 3.141592653589793 / 366)
    position = F.row_number().over(Window.partitionBy("series_id").orderBy("event_date")).cast("double")
    out = series.withColumn("i", position)
    m7, m14, m30 = (F.avg(n).over(_rows(k)) for k in (7, 14, 30))
    slope = F.coalesce(F.regr_slope(n, F.col("i")).over(_rows(7)), F.lit(0.0))
    deviation = F.stddev_pop(n).over(_rows(7))
    base = F.greatest(m7, F.lit(1.0))
    clip = lambda x, a, z: F.least(F.lit(z), F.greatest(F.lit(a), x))
    values = [
        F.log1p(n), F.col("conflict_events") / most, F.col("cooperation_events") / most, F.col("avg_goldstein") / 10, F.col("avg_tone") / 10,
        F.log1p(F.col("total_articles").cast("double")), F.sin(dow), F.cos(dow), F.sin(doy), F.cos(doy),
        F.log1p(m7), F.log1p(m14), F.log1p(m30), clip(n / base, 0.0, 10.0) / 10, clip(deviation / base, 0.0, 10.0) / 10, clip(slope / base, -1.0, 1.0),
    ]
    return out.select(*KEY, *(v.alias(f"x{i}") for i, v in enumerate(values)))


def windows(long: DataFrame, history: int = 14, horizon: int = 7) -> DataFrame:
    """(series_id, measure, event_date, x, y, scale, naive_last, moving_avg_7): each day's `history` values and the `horizon`
    values after it, for days that have both. long: (series_id, measure, event_date, y)."""
    by = ("series_id", "measure")
    w = Window.partitionBy(*by).orderBy("event_date")
    past, ahead = F.collect_list("y").over(w.rowsBetween(-(history - 1), 0)), F.collect_list("y").over(w.rowsBetween(1, horizon))
    rows = long.select(*by, "event_date", past.alias("x"), ahead.alias("target"), F.avg("y").over(_rows(history, by)).alias("scale"), F.avg("y").over(_rows(7, by)).alias("moving_avg_7"))
    rows = rows.where((F.size("x") == history) & (F.size("target") == horizon))
    return rows.withColumn("naive_last", F.element_at("x", -1))


def forecasts(wins: DataFrame, horizon: int = 7) -> DataFrame:
    """A row for each window, horizon and model: naive_last, moving_avg_7, seasonal_naive (a week before) and its error."""
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    rows = wins.select("series_id", "measure", "event_date", "scale", "x", "target", "naive_last", "moving_avg_7", h)
    seasonal = F.element_at("x", F.size("x") - 6 + F.pmod(F.col("h") - 1, F.lit(7)))
    models = F.array(*(F.struct(F.lit(n).alias("model"), v.alias("p")) for n, v in (("naive_last", F.col("naive_last")), ("moving_avg_7", F.col("moving_avg_7")), ("seasonal_naive", seasonal))))
    return rows.select("series_id", "measure", "event_date", "scale", "h", F.element_at("target", F.col("h")).alias("y"), F.inline(models))


def excitation_forecast(long: DataFrame, horizon: int = 7, context: DataFrame | None = None) -> DataFrame:
    """Decayed excitation from each series' last day: base 0.65 mean + 0.35 median, excitation above it by the lag-1
    autocorrelation with a half-life of 7 days, and a damped trend of the last 21 days. Excitation starts at the mean of the
    last 7 days, or at the series' context (series_id, context)."""
    by = ("series_id", "measure")
    w = Window.partitionBy(*by).orderBy("event_date")
    rows = long.withColumns({"i": F.row_number().over(w).cast("double"), "n": F.count("*").over(Window.partitionBy(*by)), "before": F.lag("y").over(w), "mean": F.avg("y").over(Window.partitionBy(*by))})
    stats = rows.groupBy(*by).agg(
        F.avg("y").alias("mean"),
        F.percentile("y", 0.5).alias("median"),
        F.sum((F.col("y") - F.col("mean")) * (F.col("before") - F.col("mean"))).alias("cross"),
        F.sum(F.pow(F.col("y") - F.col("mean"), 2)).alias("square"),
        F.avg(F.when(F.col("i") > F.col("n") - 7, F.col("y"))).alias("m7"),
        F.regr_slope(F.when(F.col("i") > F.col("n") - 21, F.col("y")), F.col("i")).alias("slope"),
        F.max("event_date").alias("event_date"),
    )
    base = F.greatest(F.lit(0.0), 0.65 * F.col("mean") + 0.35 * F.col("median"))
    alpha = F.coalesce(F.least(F.lit(0.85), F.greatest(F.lit(0.05), F.try_divide(F.col("cross"), F.col("square")))), F.lit(0.25))
    start = F.col("m7")
    if context is not None:
        stats, start = stats.join(context, "series_id", "left"), F.coalesce("context", "m7")
    lift = F.greatest(F.lit(0.0), start - base) * alpha
    h = F.col("h").cast("double")
    value = base + lift * F.exp(-h * 0.6931471805599453 / 7) + F.coalesce("slope", F.lit(0.0)) * h * F.exp(-h / 21)
    return stats.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(*by, "event_date", "h", F.greatest(F.lit(0.0), value).alias("p"))


def split(rows: DataFrame, horizon: int, validation: float, test: float, day: str = "event_date") -> DataFrame:
    """rows with part: train, validation or test by the whole span of a window's targets; null where a span crosses a border.

    day is the last day before the targets; borders are fractions of all days.
    """
    span = rows.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    p = F.datediff(day, "first") + 1
    days = F.datediff("last", "first") + 1 + horizon
    v, t = F.floor(days * (1 - test - validation)), F.floor(days * (1 - test))
    part = F.when(p + horizon - 1 < v, "train").when((p >= v) & (p + horizon - 1 < t), "validation").when(p >= t, "test")
    return rows.crossJoin(F.broadcast(span)).withColumn("part", part).drop("first", "last")


def error_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE and MAPE (denominators of 1 at least) of p against y."""
    e = F.col("p") - F.col("y")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(1.0))) * 100, 6).alias("mape"))


def win_rate(rows: DataFrame, model: str, baseline: str) -> DataFrame:
    """Share of series whose MAE is lower under model than under baseline."""
    errors = rows.where(F.col("model").isin(model, baseline)).groupBy("series_id", "measure").pivot("model", [model, baseline]).agg(F.avg(F.abs(F.col("p") - F.col("y"))))
    return errors.agg(F.count("*").alias("n_series"), F.round(F.avg((F.col(model) < F.col(baseline) - 1e-9).cast("double")), 6).alias("win_rate"))


def size_bin(scale: Column) -> Column:
    """How many of 10, 100 and 1000 the mean daily count reaches."""
    return sum((F.when(scale >= e, 1).otherwise(0) for e in (10, 100, 1000)), F.lit(0))


def log_intervals(fit: DataFrame, least: int = 200) -> DataFrame:
    """(h, size_bin, low_q, high_q): 10th and 90th percentiles of log1p(y) - log1p(p) by horizon and size, pooled over
    sizes (size_bin -1) as well; bins of fewer than `least` rows are left out."""
    rows = fit.select("h", size_bin(F.col("scale")).alias("size_bin"), (F.log1p("y") - F.log1p("p")).alias("r"))
    both = rows.unionByName(rows.withColumn("size_bin", F.lit(-1)))
    out = quantiles(both, ["h", "size_bin"], "r", [0.1, 0.9])
    return out.where((F.col("n") >= least) | (F.col("size_bin") == -1)).select("h", "size_bin", F.col("q")[0].alias("low_q"), F.col("q")[1].alias("high_q"))


def with_intervals(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """rows with low and high: of their horizon and size, else of the horizon."""
    own = intervals.where("size_bin >= 0").withColumnsRenamed({"low_q": "l1", "high_q": "h1"})
    pooled = intervals.where("size_bin = -1").select("h", F.col("low_q").alias("l0"), F.col("high_q").alias("h0"))
    met = rows.withColumn("size_bin", size_bin(F.col("scale"))).join(F.broadcast(own), ["h", "size_bin"], "left").join(F.broadcast(pooled), "h", "left")
    bound = lambda q: F.greatest(F.lit(0.0), F.expm1(F.log1p("p") + q))
    return met.withColumns({"low": bound(F.coalesce("l1", "l0")), "high": bound(F.coalesce("h1", "h0"))}).drop("l1", "h1", "l0", "h0")


def interval_quality(rows: DataFrame, by: list[str]) -> DataFrame:
    inside = (F.col("y") >= F.col("low") - 1e-9) & (F.col("y") <= F.col("high") + 1e-9)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(inside.cast("double")), 6).alias("coverage"), F.round(F.avg(F.col("high") - F.col("low")), 4).alias("width"))


def rolling_intervals(rows: DataFrame, days: int, horizon: int) -> DataFrame:
    """(fit_day, h, low_q, high_q): for each forecast day the percentiles over windows whose last target fell in the
    `days` days before it. Each residual is sent to the days it serves, so days meet by equality."""
    last = F.date_add("event_date", horizon)
    spread = rows.select("h", (F.log1p("y") - F.log1p("p")).alias("r"), F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, days))).alias("fit_day"))
    asked = rows.select(F.date_add("event_date", 1).alias("fit_day")).distinct()
    out = spread.join(asked, "fit_day", "left_semi").groupBy("fit_day", "h").agg(F.count("*").alias("n"), F.percentile("r", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    return out.select("fit_day", "h", "n", F.col("q")[0].alias("low_q"), F.col("q")[1].alias("high_q"))


def horizon_scale(rows: DataFrame) -> DataFrame:
    """By horizon the weighted median of y / p with weight p: the first ratio whose running weight reaches half."""
    usable = rows.where(F.col("p") > 1e-6).select("h", (F.col("y") / F.col("p")).alias("value"), F.col("p").alias("weight"))
    return weighted_medians(usable, ["h"]).withColumnRenamed("value", "scale")


def block_bootstrap(values: DataFrame, by: list[str] = [], block: int = 7, resamples: int = 2000, seed: int = 1) -> DataFrame:  # noqa: B006
    """2.5th and 97.5th percentiles of means of moving-block resamples, and the mean, of each group: by, low, high, mean.

    values: (*by, position, value), one row a day; only the order of positions counts. Resample r of n days is
    ceil(n / block) blocks of `block` days, all of them within the days, the last one cut so that it has n days; its k-th
    block starts where a hash of (seed, r, k) says. Null values are left out, no rows give no groups.

    A block's sum is what a resample needs of it, and the number of times that a resample draws a start is its weight: sums
    of blocks meet draws by equality on group and start, and no day is copied into a resample. Draws depend on the number of
    days alone, so that groups with as many days share them.
    """
    rows = values.where("value IS NOT NULL").select(*by, "position", "value")
    order = Window.partitionBy(*by).orderBy("position")
    ahead = order.rowsBetween(0, block - 1)
    days = rows.withColumns({"start": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(*by)), "next": F.collect_list("value").over(ahead)})
    size = F.least(F.lit(block), F.col("n"))
    days = days.withColumns({"blocks": F.ceil(F.col("n") / size), "room": F.col("n") - size + 1}).withColumn("rest", F.col("n") - (F.col("blocks") - 1) * size)
    total = lambda length: F.aggregate(F.slice("next", F.lit(1), length.cast("int")), F.lit(0.0), lambda s, x: s + x)
    days = stored(days.select(*by, "start", "n", "blocks", "room", "value", total(size).alias("whole"), total(F.col("rest")).alias("part")))
    kinds = days.select("n", "blocks", "room").distinct()
    draws = kinds.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    start = F.pmod(F.xxhash64(F.lit(seed), "r", "k"), "room").alias("start")
    last = F.col("k") == F.col("blocks") - 1
    draws = draws.select("n", "r", start, last.alias("last")).groupBy("n", "start", "r").agg(F.count_if(~F.col("last")).alias("times"), F.count_if("last").alias("cut"))
    sums = days.drop("blocks", "room", "value").join(draws, ["n", "start"]).groupBy(*by, "n", "r")
    means = sums.agg((F.sum(F.col("whole") * F.col("times") + F.col("part") * F.col("cut")) / F.col("n")).alias("m"))
    q = means.groupBy(*by).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    means_of = days.groupBy(*by).agg(F.avg("value").alias("mean"))
    both = q.join(means_of, by) if by else q.crossJoin(means_of).where("q IS NOT NULL")
    return both.select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "mean")
