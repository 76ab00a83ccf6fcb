"""Calendar helpers, storyline scores, risk and further checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsgrid.functions import dates as D
from newsgrid.functions import scalars as S
from newsgrid.operators import events as E
from newsgrid.operators import rollups as R
from newsgrid.operators import scores as C
from newsgrid.operators import series as T
from newsgrid.plans.events import PRINTS_SQL
from newsgrid.plans.forecasting import LONG, SPLIT, WINDOWS, _forecasts
from newsgrid.plans.rollups import SUMMARY_SQL
from newsgrid.registry import count_sql, mean_sql, query


@query(
    "j19_calendar_bounds",
    "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, last_day(o_orderdate) AS month_end, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS week_end, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end FROM orders",
)
def _bounds(spark, sf_dir):
    day = F.col("day")
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day")).distinct()
    m, w, q = D.month_bounds(day), D.week_bounds(day), D.quarter_bounds(day)
    return days.select("day", m[0].alias("month_start"), m[1].alias("month_end"), w[0].alias("week_start"), w[1].alias("week_end"), q[0].alias("quarter_start"), q[1].alias("quarter_end"))


@query(
    "j21_earlier_ranges",
    """SELECT s, e, CASE WHEN s = date_trunc('month', s) AND e = last_day(s) THEN CAST(s - INTERVAL 1 MONTH AS DATE) ELSE s - CAST(datediff('day', s, e) + 1 AS INTEGER) END AS earlier_start, s - 1 AS earlier_end
FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS s, CASE WHEN o_orderkey % 2 = 0 THEN last_day(o_orderdate) ELSE CAST(o_orderdate AS DATE) END AS e FROM orders)""",
)
def _earlier(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = F.to_date("o_orderdate")
    ranges = orders.select(F.to_date(F.trunc(d, "month")).alias("s"), F.when(F.col("o_orderkey") % 2 == 0, F.last_day(d)).otherwise(d).alias("e")).distinct()
    a, b = D.earlier_range(F.col("s"), F.col("e"))
    return ranges.select("s", "e", a.alias("earlier_start"), b.alias("earlier_end"))


@query(
    "g09_relevance",
    """, s AS (SELECT GlobalEventID AS seed_id, SQLDATE AS d, Actor1Name AS s1, Actor2Name AS s2, ActionGeo_FullName AS sp, CAST(coalesce(NumArticles, 0) AS DOUBLE) AS m, abs(coalesce(GoldsteinScale, 0)) AS h FROM fact WHERE GlobalEventID % 50 = 0),
c AS (SELECT *, datediff('day', d, SQLDATE) AS gap, CAST(coalesce(NumArticles, 0) AS DOUBLE) AS n, abs(coalesce(GoldsteinScale, 0)) AS g,
  len(list_intersect(list_filter([Actor1Name, Actor2Name], lambda x: x IS NOT NULL), list_filter([s1, s2], lambda x: x IS NOT NULL))) AS shared FROM fact JOIN s ON abs(datediff('day', d, SQLDATE)) <= 9 AND GlobalEventID <> seed_id),
r AS (SELECT seed_id, GlobalEventID, SQLDATE, round(least(20, 20 * exp(-power(gap - CASE WHEN gap >= 0 THEN 4.5 ELSE -4.5 END, 2) / 18))
  + CASE WHEN ActionGeo_FullName IS NULL OR sp IS NULL THEN 2 WHEN ActionGeo_FullName = sp THEN 10 WHEN contains(ActionGeo_FullName, sp) OR contains(sp, ActionGeo_FullName) THEN 6 ELSE 2 END
  + CASE WHEN shared >= 2 THEN 20 WHEN shared = 1 THEN 12 ELSE 3 END
  + least(15, 8 * CASE WHEN greatest(n, m) = 0 THEN 1 ELSE 1 - abs(n - m) / greatest(n, m) END + 7 * CASE WHEN greatest(g, h) = 0 THEN 1 ELSE 1 - abs(g - h) / greatest(g, h) END), 6) AS score FROM c)
SELECT seed_id, GlobalEventID, SQLDATE, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, SQLDATE, GlobalEventID) AS INTEGER) AS rank FROM r QUALIFY rank <= 10""",
    "fact",
)
def _relevance(fact):
    return C.scored(fact.where(F.col("GlobalEventID") % 50 == 0), fact, 9, 10)


@query("j25_significance", f", {PRINTS_SQL} SELECT GlobalEventID, least(10.0, round(least(coalesce(NumArticles, 0) / 50, 4) + least(abs(coalesce(GoldsteinScale, 0)) / 2, 3) + severity_score + 1, 6))::DOUBLE AS significance FROM fact JOIN prints ON global_event_id = GlobalEventID", "fact")
def _significance(fact):
    return E.detailed(fact, E.fingerprints(fact)).select("GlobalEventID", C.significance(6).alias("significance"))


@query("j18_intensity", "SELECT CASE WHEN abs(GoldsteinScale) > 7 THEN 'critical' WHEN abs(GoldsteinScale) > 5 THEN 'high' WHEN abs(GoldsteinScale) > 3 THEN 'medium' ELSE 'low' END AS intensity, COUNT(*) AS n FROM fact GROUP BY 1", "fact")
def _intensity(fact):
    return fact.groupBy(S.intensity(F.col("GoldsteinScale")).alias("intensity")).agg(F.count("*").alias("n"))


@query("j08_divisions", "SELECT GlobalEventID, CASE WHEN contains(ActionGeo_FullName, ',') THEN trim(list_extract(string_split(ActionGeo_FullName, ','), len(string_split(ActionGeo_FullName, ',')) - 1)) END AS division FROM fact", "fact")
def _divisions(fact):
    return fact.select("GlobalEventID", S.division(F.col("ActionGeo_FullName")).alias("division"))


@query("f06_first_rows_per_name", "SELECT ActionGeo_FullName, GlobalEventID, CAST(row_number() OVER (PARTITION BY ActionGeo_FullName ORDER BY GlobalEventID) AS INTEGER) AS rank FROM fact WHERE ActionGeo_FullName IS NOT NULL QUALIFY rank <= 3", "fact")
def _first_rows(fact):
    order = Window.partitionBy("ActionGeo_FullName").orderBy("GlobalEventID")
    return fact.where("ActionGeo_FullName IS NOT NULL").select("ActionGeo_FullName", "GlobalEventID", F.row_number().over(order).alias("rank")).where("rank <= 3")


@query("e20_daily_brief", f", {SUMMARY_SQL} SELECT date, total_events, conflict_events, cooperation_events, avg_goldstein, avg_tone FROM totals", "fact")
def _brief(fact):
    """Stored days where there are any, others from the events."""
    columns = ["date", "total_events", "conflict_events", "cooperation_events", "avg_goldstein", "avg_tone"]
    stored = R.daily_summary(fact.where("SQLDATE < DATE '2024-01-16'")).select(*columns)
    live = R.daily_summary(fact.where("SQLDATE >= DATE '2024-01-10'")).select(*columns)
    return R.upsert(live, stored, ["date"])


@query("e23_sentiment", f", {SUMMARY_SQL} SELECT round(SUM(CAST(round(avg_tone * total_events * 1e6) AS BIGINT)) / (SUM(total_events) * 1e6), 4) AS avg_tone, round(SUM(CAST(round(avg_goldstein * total_events * 1e6) AS BIGINT)) / (SUM(total_events) * 1e6), 4) AS avg_goldstein, CAST(SUM(conflict_events) AS BIGINT) AS conflict_count, CAST(SUM(cooperation_events) AS BIGINT) AS cooperation_count, CAST(SUM(total_events) AS BIGINT) AS total_events FROM totals", "fact")
def _sentiment(fact):
    days, n = R.daily_summary(fact), F.col("total_events")
    return days.agg(R.weighted(F.col("avg_tone"), n).alias("avg_tone"), R.weighted(F.col("avg_goldstein"), n).alias("avg_goldstein"), F.sum("conflict_events").alias("conflict_count"), F.sum("cooperation_events").alias("cooperation_count"), F.sum(n).alias("total_events"))


@query("e09_grid_heatmap", f"SELECT lat_grid, lng_grid, CAST(SUM(n) AS BIGINT) AS intensity, round(SUM(CAST(round(a * n * 1e6) AS BIGINT)) / (SUM(n) * 1e6), 4) AS avg_goldstein FROM (SELECT floor(ActionGeo_Lat / 0.5) * 0.5 AS lat_grid, floor(ActionGeo_Long / 0.5) * 0.5 AS lng_grid, SQLDATE, COUNT(*) AS n, {mean_sql('GoldsteinScale')} AS a FROM fact WHERE ActionGeo_Lat <> 0 AND ActionGeo_Long <> 0 GROUP BY 1, 2, 3) WHERE n > 1 GROUP BY 1, 2", "fact")
def _grid_heatmap(fact):
    n = F.col("event_count")
    return R.grid_days(fact, more_than=1).groupBy("lat_grid", "lng_grid").agg(F.sum(n).alias("intensity"), R.weighted(F.col("avg_goldstein"), n).alias("avg_goldstein"))


@query("a17_day_status", f"SELECT SQLDATE, COUNT(*) AS events, {count_sql('GlobalEventID % 3 <> 0 OR dayofmonth(SQLDATE) < 20')} AS derived, derived < COUNT(*) AS to_fill FROM fact GROUP BY 1", "fact")
def _day_status(fact):
    derived = fact.where((F.col("GlobalEventID") % 3 != 0) | (F.dayofmonth("SQLDATE") < 20)).groupBy("SQLDATE").agg(F.count("*").alias("derived"))
    days = fact.groupBy("SQLDATE").agg(F.count("*").alias("events")).join(derived, "SQLDATE", "full_outer")
    return days.select("SQLDATE", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("derived", F.lit(0)).alias("derived")).withColumn("to_fill", F.col("derived") < F.col("events"))


@query("n17_metrics_by_kind", WINDOWS + " SELECT split_part(series_id, '-', 2) AS kind, model, COUNT(*) AS n, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(abs(p - t) / greatest(abs(t), 1)) * 100, 6) AS mape FROM fc GROUP BY 1, 2", "series")
def _by_kind(series):
    return T.error_metrics(_forecasts(series).withColumn("kind", F.split_part("series_id", F.lit("-"), F.lit(2))), ["kind", "model"])


@query("n26_error_by_day", WINDOWS + " SELECT event_date, model, COUNT(*) AS n, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(abs(p - t) / greatest(abs(t), 1)) * 100, 6) AS mape FROM fc GROUP BY 1, 2", "series")
def _by_day(series):
    return T.error_metrics(_forecasts(series), ["event_date", "model"])


@query("n15_strongest_baseline", SPLIT + ", m AS (SELECT part, model, round(avg(abs(p - t)), 6) AS mae FROM named WHERE part IS NOT NULL GROUP BY 1, 2) SELECT part, model, mae, round((min(mae) OVER (PARTITION BY part) - mae) / min(mae) OVER (PARTITION BY part) * 100, 4) AS improvement_pct, mae = min(mae) OVER (PARTITION BY part) AS strongest FROM m", "series")
def _strongest(series):
    errors = T.error_metrics(T.split(_forecasts(series), 7, 0.15, 0.15).where("part IS NOT NULL"), ["part", "model"]).select("part", "model", "mae")
    best = F.min("mae").over(Window.partitionBy("part"))
    return errors.withColumns({"improvement_pct": F.round((best - F.col("mae")) / best * 100, 4), "strongest": F.col("mae") == best})


@query(
    "j28_risk",
    LONG
    + """, b AS (SELECT *, CAST(row_number() OVER k AS DOUBLE) AS i, COUNT(*) OVER (PARTITION BY series_id, measure) AS n FROM long WINDOW k AS (PARTITION BY series_id, measure ORDER BY event_date)),
f AS (SELECT series_id, measure, avg(CASE WHEN i > n - 7 THEN y END) AS p FROM b GROUP BY 1, 2),
s AS (SELECT series_id, measure, p, avg(CASE WHEN y <= p THEN 1.0 ELSE 0.0 END) AS r, avg(y) AS mean FROM long JOIN f USING (series_id, measure) GROUP BY 1, 2, 3),
z AS (SELECT series_id, measure, round(greatest(0, least(100, 65 * r + 35 * least(p / greatest(mean, 1), 2) / 2)), 4) AS risk_score FROM s)
SELECT *, CASE WHEN risk_score >= 80 THEN 'high' WHEN risk_score >= 60 THEN 'elevated' WHEN risk_score >= 35 THEN 'moderate' ELSE 'low' END AS risk_level FROM z""",
    "series",
)
def _risk(series):
    long = T.measures(T.densify(series))
    order = Window.partitionBy("series_id", "measure").orderBy(F.desc("event_date"))
    last = long.withColumn("r", F.row_number().over(order)).where("r <= 7").groupBy("series_id", "measure").agg(F.avg("y").alias("p")).withColumn("h", F.lit(1))
    return C.risk(long, last).select("series_id", "measure", "risk_score", "risk_level")
