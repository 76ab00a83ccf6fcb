"""Rollups and what is answered from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.functions import constants as K
from newsgrid.functions import scalars as S
from newsgrid.operators import rollups as R
from newsgrid.registry import count_sql, mean_sql, query

CONFLICT, COOPERATION = count_sql("GoldsteinScale < -5"), count_sql("GoldsteinScale > 5")
TYPE = "CASE EventRootCode " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.DAILY_TYPES.items()) + " ELSE 'other' END"
#: Arrays of (name, count) as text, for comparison.
LIST_SQL = "string_agg(name || '=' || CAST(count AS VARCHAR), ';' ORDER BY count DESC, name)"


def as_text(column):
    return F.array_join(F.transform(column, lambda x: F.concat(x["name"], F.lit("="), x["count"].cast("string"))), ";")


SUMMARY_SQL = f"""totals AS (SELECT SQLDATE AS date, COUNT(*) AS total_events, {CONFLICT} AS conflict_events, {COOPERATION} AS cooperation_events,
  {mean_sql("GoldsteinScale")} AS avg_goldstein, {mean_sql("AvgTone")} AS avg_tone, CAST(SUM(NumArticles) AS BIGINT) AS total_articles FROM fact GROUP BY 1),
actors AS (SELECT date, name, COUNT(*) AS count FROM (SELECT SQLDATE AS date, Actor1Name AS name FROM fact UNION ALL SELECT SQLDATE, Actor2Name FROM fact) WHERE name IS NOT NULL GROUP BY 1, 2),
top_a AS (SELECT * FROM actors QUALIFY row_number() OVER (PARTITION BY date ORDER BY count DESC, name) <= 10),
places AS (SELECT SQLDATE AS date, ActionGeo_FullName AS name, COUNT(*) AS count FROM fact WHERE ActionGeo_FullName IS NOT NULL GROUP BY 1, 2),
top_p AS (SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY date ORDER BY count DESC, name) <= 10),
types AS (SELECT SQLDATE AS date, {TYPE} AS type, COUNT(*) AS n FROM fact GROUP BY 1, 2),
hot AS (SELECT SQLDATE AS date, GlobalEventID, coalesce(NumArticles, 0) * abs(coalesce(GoldsteinScale, 0)) AS heat FROM fact QUALIFY row_number() OVER (PARTITION BY SQLDATE ORDER BY heat DESC, GlobalEventID) <= 20)"""


@query(
    "e12_daily_summary",
    f""", {SUMMARY_SQL}
SELECT t.*, (SELECT {LIST_SQL} FROM top_a a WHERE a.date = t.date) AS top_actors, (SELECT {LIST_SQL} FROM top_p a WHERE a.date = t.date) AS top_locations,
  (SELECT string_agg(type || '=' || CAST(n AS VARCHAR), ';' ORDER BY type) FROM types y WHERE y.date = t.date) AS event_type_distribution,
  (SELECT string_agg(CAST(GlobalEventID AS VARCHAR), ';' ORDER BY heat DESC, GlobalEventID) FROM hot h WHERE h.date = t.date) AS hot_event_ids
FROM totals t""",
    "fact",
)
def _daily(fact):
    types = F.transform(F.map_entries("event_type_distribution"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    out = R.daily_summary(fact)
    return out.withColumns({"top_actors": as_text(F.col("top_actors")), "top_locations": as_text(F.col("top_locations")), "event_type_distribution": F.array_join(types, ";"), "hot_event_ids": F.array_join(F.transform("hot_event_ids", lambda x: x.cast("string")), ";")})


DIVISION = "trim(list_extract(string_split(ActionGeo_FullName, ','), len(string_split(ActionGeo_FullName, ',')) - 1))"
REGION_SQL = f"""regions AS (SELECT *, 'country' AS region_type, nullif(ActionGeo_CountryCode, '') AS region_code FROM fact
  UNION ALL SELECT *, 'state', CASE WHEN ActionGeo_Type BETWEEN 2 AND 5 AND contains(ActionGeo_FullName, ',') THEN upper({DIVISION}) END FROM fact),
reg AS (SELECT *, SQLDATE AS date FROM regions WHERE region_code IS NOT NULL),
stats AS (SELECT region_type, region_code, date, coalesce(max(CASE WHEN ActionGeo_Type = 1 THEN ActionGeo_FullName END), region_code) AS region_name, COUNT(*) AS event_count,
  {CONFLICT} AS conflict_events, {COOPERATION} AS cooperation_events, {mean_sql("GoldsteinScale")} AS avg_goldstein,
  {mean_sql("greatest(-coalesce(GoldsteinScale, 0), 0)")} AS conflict_intensity, {mean_sql("greatest(coalesce(GoldsteinScale, 0), 0)")} AS cooperation_intensity, {mean_sql("AvgTone")} AS avg_tone
  FROM reg GROUP BY region_type, region_code, date)"""


@query(
    "e13_region_days",
    f""", {REGION_SQL},
names AS (SELECT region_type, region_code, date, name, COUNT(*) AS count FROM (SELECT region_type, region_code, date, Actor1Name AS name FROM reg UNION ALL SELECT region_type, region_code, date, Actor2Name FROM reg) WHERE name IS NOT NULL GROUP BY ALL),
top_n AS (SELECT * FROM names QUALIFY row_number() OVER (PARTITION BY region_type, region_code, date ORDER BY count DESC, name) <= 3),
lists AS (SELECT region_type, region_code, date, {LIST_SQL} AS primary_actors FROM top_n GROUP BY ALL),
best AS (SELECT region_type, region_code, date, GlobalEventID, NumArticles FROM reg QUALIFY row_number() OVER (PARTITION BY region_type, region_code, date ORDER BY NumArticles DESC, GlobalEventID) <= 5),
ids AS (SELECT region_type, region_code, date, string_agg(CAST(GlobalEventID AS VARCHAR), ';' ORDER BY NumArticles DESC, GlobalEventID) AS top_event_ids FROM best GROUP BY ALL)
SELECT s.*, l.primary_actors, i.top_event_ids FROM stats s LEFT JOIN lists l USING (region_type, region_code, date) LEFT JOIN ids i USING (region_type, region_code, date)""",
    "fact",
)
def _regions(fact):
    out = R.region_days(fact)
    return out.withColumns({"primary_actors": as_text(F.col("primary_actors")), "top_event_ids": F.array_join(F.transform("top_event_ids", lambda x: x.cast("string")), ";")})


@query(
    "e10_grid_days",
    f"""SELECT *, printf('%.1f_%.1f', lat_grid, lng_grid) AS grid_id FROM (SELECT floor(ActionGeo_Lat / 0.5) * 0.5 AS lat_grid, floor(ActionGeo_Long / 0.5) * 0.5 AS lng_grid, SQLDATE AS date, COUNT(*) AS event_count,
  {CONFLICT} AS conflict_sum, {mean_sql("GoldsteinScale")} AS avg_goldstein, {mean_sql("AvgTone")} AS avg_tone
FROM fact WHERE ActionGeo_Lat <> 0 AND ActionGeo_Long <> 0 GROUP BY 1, 2, 3) WHERE event_count > 1""",
    "fact",
)
def _grid(fact):
    return R.grid_days(fact, more_than=1)


@query(
    "e11_cell_labels",
    "SELECT lat_grid, lng_grid, label, n FROM (SELECT floor(ActionGeo_Lat / 0.5) * 0.5 AS lat_grid, floor(ActionGeo_Long / 0.5) * 0.5 AS lng_grid, ActionGeo_FullName AS label, COUNT(*) AS n FROM fact WHERE ActionGeo_Lat <> 0 AND ActionGeo_Long <> 0 AND ActionGeo_FullName IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY lat_grid, lng_grid ORDER BY n DESC, label) = 1",
    "fact",
)
def _labels(fact):
    return R.cell_labels(fact)


@query("f04_representatives", "SELECT * FROM (SELECT SQLDATE, GlobalEventID, CAST(row_number() OVER (PARTITION BY SQLDATE ORDER BY coalesce(NumArticles, 0) * abs(coalesce(GoldsteinScale, 0)) DESC, GlobalEventID DESC) AS INTEGER) AS rank FROM fact) WHERE rank <= 25", "fact")
def _representatives(fact):
    return R.representatives(fact)


@query("e06_merged_actors", f", {SUMMARY_SQL} SELECT name, CAST(SUM(count) AS BIGINT) AS count FROM top_a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "fact")
def _merged(fact):
    return R.merged_top(R.daily_summary(fact), "top_actors", 10)


@query("e06_merged_types", f", {SUMMARY_SQL} SELECT type, CAST(SUM(n) AS BIGINT) AS n FROM types GROUP BY 1", "fact")
def _merged_types(fact):
    return R.merged_types(R.daily_summary(fact))


@query(
    "e18_regional_overview",
    f", {REGION_SQL} SELECT region_type, region_code, CAST(SUM(event_count) AS BIGINT) AS total, CAST(SUM(conflict_events) AS BIGINT) AS conflicts, CAST(SUM(cooperation_events) AS BIGINT) AS cooperation, round(SUM(CAST(round(avg_goldstein * event_count * 1e6) AS BIGINT)) / (SUM(event_count) * 1e6), 4) AS avg_goldstein, round(SUM(CAST(round(avg_tone * event_count * 1e6) AS BIGINT)) / (SUM(event_count) * 1e6), 4) AS avg_tone FROM stats WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-24' GROUP BY 1, 2",
    "fact",
)
def _overview(fact):
    days = R.region_days(fact).where("date BETWEEN DATE '2024-01-03' AND DATE '2024-01-24'")
    n = F.col("event_count")
    return days.groupBy("region_type", "region_code").agg(F.sum(n).alias("total"), F.sum("conflict_events").alias("conflicts"), F.sum("cooperation_events").alias("cooperation"), R.weighted(F.col("avg_goldstein"), n).alias("avg_goldstein"), R.weighted(F.col("avg_tone"), n).alias("avg_tone"))


for _granularity, _period in (("day", "SQLDATE"), ("week", "CAST(SQLDATE - CAST(dayofweek(SQLDATE) AS INTEGER) AS DATE)"), ("month", "CAST(date_trunc('month', SQLDATE) AS DATE)")):

    @query(
        f"e07_time_series_{_granularity}",
        f"SELECT {_period} AS period, COUNT(*) AS event_count, round(100.0 * {CONFLICT} / COUNT(*), 2) AS conflict_pct, round(100.0 * {COOPERATION} / COUNT(*), 2) AS cooperation_pct, {mean_sql('GoldsteinScale')} AS avg_goldstein, round(stddev_pop(GoldsteinScale), 2) AS std_goldstein, {mean_sql('AvgTone')} AS avg_tone, round(stddev_pop(AvgTone), 2) AS std_tone FROM fact GROUP BY 1",
        "fact",
    )
    def _series(fact, granularity=_granularity):
        return R.time_series(fact, granularity)


@query(
    "e08_heatmap",
    f"SELECT round(ActionGeo_Lat, 1) AS lat, round(ActionGeo_Long, 1) AS lng, COUNT(*) AS intensity, {mean_sql('GoldsteinScale')} AS avg_conflict, min(ActionGeo_FullName) AS sample_location FROM fact WHERE ActionGeo_Lat <> 0 AND ActionGeo_Long <> 0 GROUP BY 1, 2 HAVING COUNT(*) >= 5 ORDER BY intensity DESC, lat, lng LIMIT 1000",
    "fact",
)
def _heatmap(fact):
    return R.heatmap(fact)


@query(
    "a10_upsert",
    f", old AS (SELECT SQLDATE, COUNT(*) AS n, 'old' AS version FROM fact GROUP BY 1), new AS (SELECT SQLDATE, {CONFLICT} AS n, 'new' AS version FROM fact WHERE SQLDATE >= DATE '2024-01-20' GROUP BY 1) SELECT * FROM new UNION ALL SELECT * FROM old WHERE SQLDATE NOT IN (SELECT SQLDATE FROM new)",
    "fact",
)
def _upsert(fact):
    old = fact.groupBy("SQLDATE").agg(F.count("*").alias("n")).withColumn("version", F.lit("old"))
    new = fact.where("SQLDATE >= DATE '2024-01-20'").groupBy("SQLDATE").agg(S.share(S.conflict()).alias("n")).withColumn("version", F.lit("new"))
    return R.upsert(old, new, ["SQLDATE"])


@query(
    "a09_keep_first",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem WHERE l_orderkey % 5 <> 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)) WHERE r = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)",
)
def _keep_first(spark, sf_dir):
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    target = orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.keep_first(target, lines, "l_orderkey", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_extendedprice")).select("l_orderkey", "l_linenumber", "l_partkey")
