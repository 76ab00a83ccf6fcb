"""Further queries on events, rollups and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.functions import dates as D
from newsgrid.functions import scalars as S
from newsgrid.operators import extra as X
from newsgrid.operators import rollups as R
from newsgrid.operators import series as T
from newsgrid.plans.forecasting import SPLIT, WINDOWS, _forecasts
from newsgrid.plans.rollups import REGION_SQL, TYPE
from newsgrid.registry import ORACLE_SQL, query


@query(
    "g05_candidate_top",
    f", {REGION_SQL}, best AS (SELECT region_type, region_code, SQLDATE, GlobalEventID, NumArticles FROM reg QUALIFY row_number() OVER (PARTITION BY region_type, region_code, date ORDER BY NumArticles DESC, GlobalEventID) <= 5) SELECT *, CAST(row_number() OVER (PARTITION BY region_type, region_code ORDER BY NumArticles DESC, GlobalEventID) AS INTEGER) AS rank FROM best QUALIFY rank <= 5",
    "fact",
)
def _candidates(fact):
    return X.candidate_top(R.region_days(fact), fact)


@query("g13_suggest_places", "SELECT name, kind FROM (SELECT 'CITY OF ANGELS' AS name, 1 AS kind UNION ALL SELECT DISTINCT ActionGeo_FullName, 2 FROM fact WHERE starts_with(ActionGeo_FullName, 'CITY')) ORDER BY kind, name LIMIT 12", "fact")
def _places(fact):
    return X.suggest_places(fact, "CITY", ["CITY OF ANGELS", "OHIO"], 12)


@query("e36_place_evolution", f"SELECT ActionGeo_FullName AS place, COUNT(*) AS events, min(SQLDATE) AS first_seen, max(SQLDATE) AS last_seen, COUNT(DISTINCT Actor1Name) AS actors, array_to_string(list_sort(list(DISTINCT {TYPE})), ';') AS types FROM fact WHERE ActionGeo_FullName IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15", "fact")
def _evolution(fact):
    return X.place_evolution(fact)


@query(
    "e38_timeline",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY Actor1Name ORDER BY coalesce(NumArticles, 0) * abs(coalesce(GoldsteinScale, 0)) DESC, GlobalEventID) AS r, concat_ws(', ', CASE WHEN NumArticles > 80 THEN 'wide coverage' END, CASE WHEN abs(GoldsteinScale) > 7 THEN 'extreme score' END) AS reason FROM fact WHERE Actor1Name IS NOT NULL)
SELECT Actor1Name, min(SQLDATE) AS start, max(SQLDATE) AS "end", COUNT(*) AS events, string_agg(CAST(GlobalEventID AS VARCHAR) || ':' || reason, '; ' ORDER BY r) FILTER (r <= 3) AS milestones, CAST(datediff('day', min(SQLDATE), max(SQLDATE)) + 1 AS INTEGER) AS days FROM r GROUP BY 1""",
    "fact",
)
def _timeline(fact):
    return X.timeline(fact)


@query("j16_plain_texts", "SELECT doc_id, md5(trim(replace(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), '|', ' '))) AS digest FROM documents")
def _plain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(S.plain_text(F.col("text"))).alias("digest"))


HINTS = ["today", "yesterday", "this_week", "this_month", "2023", "2023-02", "2023-02-14"]


@query(
    "j20_named_ranges",
    """SELECT DISTINCT hint, d AS reference,
  CASE hint WHEN 'today' THEN d WHEN 'yesterday' THEN d - 1 WHEN 'this_week' THEN CAST(date_trunc('week', d) AS DATE) WHEN '2023' THEN DATE '2023-01-01' WHEN '2023-02' THEN DATE '2023-02-01' WHEN '2023-02-14' THEN DATE '2023-02-14' ELSE CAST(date_trunc('month', d) AS DATE) END AS range_start,
  CASE hint WHEN 'yesterday' THEN d - 1 WHEN '2023' THEN DATE '2023-12-31' WHEN '2023-02' THEN DATE '2023-02-28' WHEN '2023-02-14' THEN DATE '2023-02-14' ELSE d END AS range_end
FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), (SELECT unnest(['"""
    + "', '".join(HINTS)
    + "']) AS hint)",
)
def _hints(spark, sf_dir):
    days = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("reference")).distinct()
    rows = days.select("reference", F.explode(F.array(*(F.lit(h) for h in HINTS))).alias("hint"))
    a, b = D.named_range(F.col("hint"), F.col("reference"))
    return rows.select("hint", "reference", a.alias("range_start"), b.alias("range_end"))


@query(
    "j22_range_problems",
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN s > e THEN 'reversed' END, CASE WHEN e < DATE '1996-01-01' OR s > DATE '1998-01-01' THEN 'outside' END, CASE WHEN s < DATE '1996-01-01' OR e > DATE '1998-01-01' THEN 'partly_outside' END], lambda x: x IS NOT NULL), ',') AS problems
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 5 AS INTEGER) AS e FROM orders)""",
)
def _problems(spark, sf_dir):
    s = F.to_date("o_orderdate")
    e = F.date_add(s, (F.col("o_orderkey") % 40 - 5).cast("int"))
    first, last = F.lit("1996-01-01").cast("date"), F.lit("1998-01-01").cast("date")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.array_join(D.range_problems(s, e, first, last), ",").alias("problems"))


@query("n18_error_by_origin", WINDOWS + ", b AS (SELECT min(event_date) AS a, (datediff('day', min(event_date), max(event_date)) + 1) / 3 AS w FROM fc) SELECT CAST(floor(datediff('day', a, event_date) / w) + 1 AS INTEGER) AS bucket, model, COUNT(*) AS n, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(abs(p - t) / greatest(abs(t), 1)) * 100, 6) AS mape FROM fc, b GROUP BY 1, 2", "series")
def _origins(series):
    return T.error_metrics(X.origin_buckets(_forecasts(series)), ["bucket", "model"])


@query("n20_residual_quantiles", SPLIT + " SELECT h, COUNT(*) AS n, round(quantile_cont(t - p, 0.1), 6) AS low_q, round(quantile_cont(t - p, 0.9), 6) AS high_q FROM named WHERE part = 'validation' AND model = 'moving_avg_7' GROUP BY 1", "series")
def _quantiles(series):
    rows = T.split(_forecasts(series), 7, 0.15, 0.15).where("part = 'validation' AND model = 'moving_avg_7'")
    return X.residual_quantiles(rows).select("h", "n", F.round("low_q", 6).alias("low_q"), F.round("high_q", 6).alias("high_q"))


#: All features of a day as one list, over the derived rows of the feature query.
_ROWS = ORACLE_SQL["n02_features"].rpartition("SELECT series_id, event_date, round(ln")[0]
CONTEXT = f"""WITH feats AS ({_ROWS} SELECT series_id, event_date, total_events, [ln(1 + n), conflict_events / greatest(n, 1), cooperation_events / greatest(n, 1), avg_goldstein / 10, avg_tone / 10, ln(1 + total_articles), sin((isodow(event_date) - 1) * 2 * pi() / 7), cos((isodow(event_date) - 1) * 2 * pi() / 7),
  sin(dayofyear(event_date) * 2 * pi() / 366), cos(dayofyear(event_date) * 2 * pi() / 366), ln(1 + m7), ln(1 + m14), ln(1 + m30), least(10, greatest(0, n / greatest(m7, 1))) / 10, least(10, greatest(0, sd / greatest(m7, 1))) / 10, least(1, greatest(-1, CASE WHEN isnan(slope) THEN 0 ELSE slope END / greatest(m7, 1)))] AS k FROM f),
recent AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY event_date DESC) AS r FROM feats), newest AS (SELECT series_id, k AS q, event_date AS day FROM recent WHERE r = 1),
weights AS (SELECT series_id, total_events, exp(list_dot_product(k, q) / 4 - datediff('day', event_date, day) / 7) AS w FROM recent JOIN newest USING (series_id) WHERE r <= 30)
SELECT series_id, round(sum(w * total_events) / sum(w), 6) AS context FROM weights GROUP BY 1"""


@query("n05_attention_context", CONTEXT)
def _attention(spark, sf_dir):
    from newsgrid.sources.adapter import daily_series

    dense = T.densify(daily_series(spark, sf_dir))
    return X.attention_context(T.features(dense), dense).withColumn("context", F.round("context", 6))


@query("c16_matched_cells", WINDOWS + ", a AS (SELECT series_id, measure, event_date, h, p FROM fc WHERE model = 'moving_avg_7'), b AS (SELECT series_id, measure, event_date, h, p FROM fc WHERE model = 'seasonal_naive' AND h % 2 = 0) SELECT COUNT(*) AS cells, round(max(abs(a.p - b.p)), 6) AS largest_difference FROM a JOIN b USING (series_id, measure, event_date, h)", "series")
def _cells(series):
    rows = _forecasts(series)
    out = X.matched_cells(rows.where("model = 'moving_avg_7'"), rows.where("model = 'seasonal_naive' AND h % 2 = 0"), ["series_id", "measure", "event_date", "h"], "p")
    return out.withColumn("largest_difference", F.round("largest_difference", 6))
