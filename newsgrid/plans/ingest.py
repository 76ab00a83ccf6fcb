"""Batch forms of the ingest and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.registry import count_sql, query
from newsgrid.sources import exports
from newsgrid.streaming import events as V


@query("a03_batch_stamps", "SELECT DISTINCT strftime(t, '%Y%m%d%H%M%S') AS stamp FROM (SELECT unnest(generate_series(to_timestamp(floor(min(epoch(ts)) / 900) * 900) AT TIME ZONE 'UTC', to_timestamp(floor(max(epoch(ts)) / 900) * 900) AT TIME ZONE 'UTC', INTERVAL 15 MINUTE)) AS t FROM events GROUP BY CAST(ts AS DATE))")
def _stamps(spark, sf_dir):
    """The batches that hold each day's arrivals, from the first to the last."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return exports.stamps_between(events.groupBy(F.to_date("ts")).agg(F.min("ts").alias("a"), F.max("ts").alias("z")), "a", "z")


@query(
    "a05_clean_coordinates",
    """, raw2 AS (SELECT GlobalEventID, TRY_CAST(CASE WHEN GlobalEventID % 9 = 0 THEN 'x' ELSE CAST(ActionGeo_Lat * 2 AS VARCHAR) END AS DOUBLE) AS lat, TRY_CAST(CAST(ActionGeo_Long * 2 AS VARCHAR) AS DOUBLE) AS lng, SQLDATE FROM fact)
SELECT GlobalEventID, coalesce(CASE WHEN lat BETWEEN -90 AND 90 THEN lat END, 0.0) AS ActionGeo_Lat, coalesce(CASE WHEN lng BETWEEN -180 AND 180 THEN lng END, 0.0) AS ActionGeo_Long, SQLDATE,
  'POINT(' || CAST(coalesce(CASE WHEN lat BETWEEN -90 AND 90 THEN lat END, 0.0) AS VARCHAR) || ' ' || CAST(coalesce(CASE WHEN lng BETWEEN -180 AND 180 THEN lng END, 0.0) AS VARCHAR) || ')' AS ActionGeo_Point_WKT FROM raw2""",
    "fact",
)
def _clean(fact):
    lat = F.when(F.col("GlobalEventID") % 9 == 0, "x").otherwise((F.col("ActionGeo_Lat") * 2).cast("string"))
    raw = fact.select("GlobalEventID", lat.alias("ActionGeo_Lat"), (F.col("ActionGeo_Long") * 2).cast("string").alias("ActionGeo_Long"), F.date_format("SQLDATE", "yyyyMMdd").alias("SQLDATE"))
    return exports.cleaned(raw)


@query("a11_period_with_late_rows", "SELECT GlobalEventID, SQLDATE FROM fact WHERE SQLDATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND CAST(DATEADDED AS DATE) <= DATE '2024-01-10'", "fact")
def _period(fact):
    return exports.period(fact, "2024-01-05", "2024-01-12", "2024-01-10").select("GlobalEventID", "SQLDATE")


@query("l05_batch_counts", f"SELECT strftime(time_bucket(INTERVAL 15 MINUTE, DATEADDED), '%Y-%m-%d %H:%M') AS start, COUNT(*) AS n, {count_sql('GoldsteinScale < -5')} AS conflicts FROM fact GROUP BY 1", "fact")
def _counts(fact):
    return V.counts_by_window(fact).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "conflicts")


@query(
    "l06_sliding_counts",
    f", d AS (SELECT unnest(generate_series(date_trunc('day', DATEADDED) - INTERVAL 6 DAY, date_trunc('day', DATEADDED), INTERVAL 1 DAY)) AS s, GoldsteinScale FROM fact) SELECT strftime(s, '%Y-%m-%d') AS start, COUNT(*) AS n, {count_sql('GoldsteinScale < -5')} AS conflicts FROM d GROUP BY 1",
    "fact",
)
def _sliding(fact):
    return V.counts_by_window(fact, "7 days", "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n", "conflicts")


@query(
    "l07_sessions",
    """, o AS (SELECT EventRootCode, DATEADDED, CASE WHEN DATEADDED < lag(DATEADDED) OVER k + INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS fresh FROM fact WINDOW k AS (PARTITION BY EventRootCode ORDER BY DATEADDED)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY EventRootCode ORDER BY DATEADDED ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT EventRootCode, strftime(min(DATEADDED), '%Y-%m-%d %H:%M:%S') AS start, COUNT(*) AS n FROM g GROUP BY EventRootCode, s""",
    "fact",
)
def _sessions(fact):
    return V.sessions(fact, "120 minutes").select("EventRootCode", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("l07_missing_days", "SELECT CAST(day AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS day) WHERE CAST(day AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)")
def _missing(spark, sf_dir):
    from newsgrid.sources.adapter import fact

    return V.missing_days(fact(spark, sf_dir), "2023-12-25", "2024-02-05")
