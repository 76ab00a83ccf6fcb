"""Dashboards, comparisons, packed fields and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.functions import constants as K
from newsgrid.functions import scalars as S
from newsgrid.operators import analysis as A
from newsgrid.operators import events as E
from newsgrid.plans.rollups import TYPE
from newsgrid.registry import count_sql, mean_sql, query

CONFLICT, COOPERATION = count_sql("GoldsteinScale < -5"), count_sql("GoldsteinScale > 5")
G, T = mean_sql("GoldsteinScale"), mean_sql("AvgTone")


@query("e01_daily_trend", f"SELECT SQLDATE, COUNT(*) AS cnt, {G} AS goldstein, {CONFLICT} AS conflict FROM fact GROUP BY 1", "fact")
def _trend(fact):
    return A.daily_trend(fact)


@query("e02_top_actors", "SELECT Actor1Name AS actor, COUNT(*) AS event_count FROM fact WHERE Actor1Name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "fact")
def _top_actors(fact):
    return A.top_values(fact, "Actor1Name", 10, "actor")


@query("e03_live_types", "SELECT CASE WHEN CAST(EventRootCode AS INT) BETWEEN 1 AND 9 THEN 'Public Statement' WHEN CAST(EventRootCode AS INT) BETWEEN 10 AND 19 THEN 'Yield' WHEN CAST(EventRootCode AS INT) BETWEEN 20 AND 29 THEN 'Investigate' ELSE 'Other' END AS event_type, COUNT(*) AS event_count FROM fact GROUP BY 1", "fact")
def _live(fact):
    return A.live_type_buckets(fact)


@query("e03_type_histogram", f"SELECT {TYPE} AS type, COUNT(*) AS n FROM fact GROUP BY 1", "fact")
def _types(fact):
    return fact.groupBy(S.daily_type().alias("type")).agg(F.count("*").alias("n"))


@query("e04_summary_stats", f"SELECT COUNT(*) AS total_events, COUNT(DISTINCT Actor1Name) AS unique_actors, {G} AS avg_goldstein, {T} AS avg_tone, CAST(SUM(NumArticles) AS BIGINT) AS total_articles FROM fact", "fact")
def _stats(fact):
    return A.summary_stats(fact)


PERIODS = [("first", "2024-01-01", "2024-01-10"), ("second", "2024-01-11", "2024-01-25"), ("none", "2023-05-01", "2023-05-31"), ("all", "2024-01-01", "2024-12-31")]
PERIODS_SQL = "periods AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in PERIODS) + ') p(label, "start", "end"))'


def _periods(spark):
    rows = ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in PERIODS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS p(label, start, end)")


@query("e16_period_counts", f', {PERIODS_SQL} SELECT label, "start", "end", COUNT(GlobalEventID) AS event_count, CAST(coalesce(SUM(NumArticles), 0) AS BIGINT) AS article_count FROM periods LEFT JOIN fact ON SQLDATE BETWEEN "start" AND "end" GROUP BY ALL', "fact")
def _period_counts(fact):
    return A.period_counts(fact, _periods(fact.sparkSession))


@query(
    "e17_compare_periods",
    f""", {PERIODS_SQL}, c AS (SELECT label, datediff('day', "start", "end") + 1 AS days, COUNT(GlobalEventID) AS n FROM periods LEFT JOIN fact ON SQLDATE BETWEEN "start" AND "end" GROUP BY ALL),
p AS (SELECT a.label AS earlier, b.label AS later, a.n AS n1, a.days AS days1, b.n AS n2, b.days AS days2, a.n / a.days AS r1, b.n / b.days AS r2 FROM c a JOIN c b ON a.label < b.label)
SELECT earlier, later, n1, n2, n2 - n1 AS absolute_change, round(r2 - r1, 2) AS per_day_change, CASE WHEN n1 > 0 THEN round((r2 - r1) / r1 * 100, 1) END AS percent_change_per_day,
  CASE WHEN n1 = 0 AND n2 = 0 THEN 'no_data' WHEN n1 = 0 THEN 'new_activity' WHEN least(n1, n2) < 30 THEN 'inconclusive_low_volume' WHEN abs((r2 - r1) / r1 * 100) < 5 THEN 'flat' WHEN r2 > r1 THEN 'increase' ELSE 'decrease' END AS direction,
  CASE WHEN days1 <> days2 THEN 'different_lengths' END AS caveat FROM p""",
    "fact",
)
def _compare(fact):
    counts = A.period_counts(fact, _periods(fact.sparkSession)).withColumn("days", F.datediff("end", "start") + 1)
    a = counts.select(F.col("label").alias("earlier"), F.col("event_count").alias("n1"), F.col("days").alias("days1"))
    b = counts.select(F.col("label").alias("later"), F.col("event_count").alias("n2"), F.col("days").alias("days2"))
    pairs = a.join(F.broadcast(b), F.col("earlier") < F.col("later"))  # a handful of named periods
    return A.compare_periods(pairs).drop("days1", "days2")


@query("e22_event_sequence", f"SELECT SQLDATE AS date, COUNT(*) AS event_count, {count_sql('GoldsteinScale < 0')} AS conflict_events, {count_sql('GoldsteinScale > 0')} AS cooperation_events, {G} AS avg_goldstein, {T} AS avg_tone, CAST(SUM(NumArticles) AS BIGINT) AS total_articles FROM fact WHERE ActionGeo_CountryCode = 'EU' GROUP BY 1", "fact")
def _sequence(fact):
    return A.event_sequence(fact.where(E.at_place("EU")))


@query(
    "e21_actor_activity",
    f"SELECT SQLDATE AS date, COUNT(*) AS total_events, CAST(SUM(NumArticles) AS BIGINT) AS total_articles, {G} AS avg_goldstein, {T} AS avg_tone, {CONFLICT} AS severe_conflict, {COOPERATION} AS severe_cooperation, arg_max(EventCode, NumArticles * 1000000000 - GlobalEventID) AS top_event_code FROM (SELECT * REPLACE (CAST(NumArticles AS BIGINT) AS NumArticles) FROM fact) WHERE coalesce(Actor1Name = 'ACTOR 7', false) OR coalesce(Actor2Name = 'ACTOR 7', false) GROUP BY 1",
    "fact",
)
def _activity(fact):
    return A.actor_activity(fact, "ACTOR 7")


@query("e24_quad_classes", "SELECT QuadClass, COUNT(*) AS n, round(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS pct FROM fact GROUP BY 1", "fact")
def _quads(fact):
    return A.distribution(fact, "QuadClass")


@query("e32_themes", "SELECT theme, COUNT(*) AS n FROM (SELECT split_part(unnest(string_split(V2Themes, ';')), ',', 1) AS theme FROM packed) WHERE theme <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "packed")
def _themes(packed):
    return A.theme_counts(packed)


@query("e32_themes_by_day", "SELECT event_day, theme, n, CAST(row_number() OVER (PARTITION BY event_day ORDER BY n DESC, theme) AS INTEGER) AS rank FROM (SELECT event_day, theme, COUNT(*) AS n FROM (SELECT event_day, split_part(unnest(string_split(V2Themes, ';')), ',', 1) AS theme FROM packed) WHERE theme <> '' GROUP BY 1, 2) QUALIFY rank <= 5", "packed")
def _themes_by_day(packed):
    return A.theme_counts_by_day(packed)


@query(
    "e33_cooccurring",
    """, own AS (SELECT * FROM packed WHERE contains(V2Persons, 'ACTOR 4')),
names AS (SELECT 'person' AS kind, split_part(unnest(string_split(V2Persons, ';')), ',', 1) AS name FROM own UNION ALL SELECT 'organisation', split_part(unnest(string_split(V2Organizations, ';')), ',', 1) FROM own UNION ALL SELECT 'theme', split_part(unnest(string_split(V2Themes, ';')), ',', 1) FROM own)
SELECT kind, name, n, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) AS INTEGER) AS rank FROM (SELECT kind, name, COUNT(*) AS n FROM names WHERE name <> '' AND NOT contains(name, 'ACTOR 4') GROUP BY 1, 2) QUALIFY rank <= 15""",
    "packed",
)
def _cooccurring(packed):
    return A.cooccurring(packed, "ACTOR 4")


@query("e34_tone_timeline", f"SELECT event_day, {mean_sql('tone')} AS avg_tone, COUNT(tone) AS mentions FROM (SELECT event_day, TRY_CAST(split_part(V2Tone, ',', 1) AS DOUBLE) AS tone FROM packed) GROUP BY 1", "packed")
def _tone(packed):
    return A.tone_timeline(packed)


@query(
    "e35_actor_evolution",
    f""", r AS (SELECT SQLDATE, GoldsteinScale, ActionGeo_FullName, Actor1Name AS actor, Actor2Name AS other FROM fact UNION ALL SELECT SQLDATE, GoldsteinScale, ActionGeo_FullName, Actor2Name, Actor1Name FROM fact),
a AS (SELECT actor, min(SQLDATE) AS first_seen, max(SQLDATE) AS last_seen, COUNT(*) AS events, COUNT(DISTINCT ActionGeo_FullName) AS places, array_to_string(list_slice(list_sort(list(DISTINCT other) FILTER (other IS NOT NULL)), 1, 10), ';') AS co_actors, {G} AS avg_goldstein FROM r WHERE actor IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN avg_goldstein IS NULL THEN 'unknown' WHEN avg_goldstein < -3 THEN 'antagonist' WHEN avg_goldstein > 3 THEN 'cooperator' ELSE 'neutral' END AS role FROM a ORDER BY events DESC, actor LIMIT 20""",
    "fact",
)
def _evolution(fact):
    return A.actor_evolution(fact)


@query(
    "e37_theme_trend",
    """, c AS (SELECT event_day, theme, COUNT(*) AS n FROM (SELECT event_day, split_part(unnest(string_split(V2Themes, ';')), ',', 1) AS theme FROM packed WHERE contains(V2Persons, 'ACTOR 3')) WHERE theme <> '' GROUP BY 1, 2),
p AS (SELECT theme, CAST(SUM(CASE WHEN event_day = (SELECT min(event_day) FROM c) THEN n ELSE 0 END) AS BIGINT) AS first_n, CAST(SUM(CASE WHEN event_day = (SELECT max(event_day) FROM c) THEN n ELSE 0 END) AS BIGINT) AS last_n FROM c GROUP BY 1),
t AS (SELECT *, CASE WHEN last_n > 2 * first_n AND last_n >= 3 THEN 'emerging' WHEN first_n > 2 * last_n AND first_n >= 3 THEN 'declining' END AS trend, round(greatest(first_n, last_n) / greatest(least(first_n, last_n), 1), 1) AS ratio FROM p)
SELECT *, CAST(row_number() OVER (PARTITION BY trend ORDER BY ratio DESC, theme) AS INTEGER) AS rank FROM t WHERE trend IS NOT NULL QUALIFY rank <= 10""",
    "packed",
)
def _theme_trend(packed):
    return A.theme_trend(packed.where(F.col("V2Persons").contains("ACTOR 3")))


@query("e39_compare_sides", f"SELECT {TYPE} AS type, {count_sql("Actor1Name = 'ACTOR 1'")} AS left_events, {count_sql("Actor1Name = 'ACTOR 2'")} AS right_events FROM fact WHERE Actor1Name IN ('ACTOR 1', 'ACTOR 2') GROUP BY 1", "fact")
def _sides(fact):
    return A.compare_sides(fact, "Actor1Name", "ACTOR 1", "ACTOR 2")


@query(
    "e40_headline_figures",
    f"""SELECT (SELECT SQLDATE FROM fact GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS busiest_day, (SELECT Actor1Name FROM fact WHERE Actor1Name IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS leading_actor,
  (SELECT ActionGeo_FullName FROM fact WHERE ActionGeo_FullName IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS leading_place,
  (SELECT {TYPE} AS y FROM fact GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS dominant_type, (SELECT COUNT(*) AS n FROM fact GROUP BY {TYPE} ORDER BY n DESC LIMIT 1) AS dominant_count,
  (SELECT COUNT(*) FROM fact) AS total, (SELECT round(100.0 * {CONFLICT} / COUNT(*), 2) FROM fact) AS conflict_pct""",
    "fact",
)
def _figures(fact):
    return A.headline_figures(fact)


@query(
    "e41_half_trend",
    """, d AS (SELECT SQLDATE, COUNT(*) AS c FROM fact GROUP BY 1), i AS (SELECT c, row_number() OVER (ORDER BY SQLDATE) AS i, COUNT(*) OVER () AS n FROM d),
a AS (SELECT avg(CASE WHEN i * 2 <= n THEN c END) AS f, avg(CASE WHEN i * 2 > n THEN c END) AS s, avg(CASE WHEN i <= 7 THEN c END) AS e, avg(CASE WHEN i > n - 7 THEN c END) AS l FROM i)
SELECT round((s - f) / f * 100, 2) AS half_change_pct, round((l - e) / e * 100, 2) AS week_change_pct FROM a""",
    "fact",
)
def _half(fact):
    return A.half_trend(A.event_sequence(fact))


@query(
    "e42_place_dictionary",
    """SELECT * FROM (SELECT 'division' AS kind, list_extract(string_split(ActionGeo_FullName, ', '), len(string_split(ActionGeo_FullName, ', ')) - 1) AS name, COUNT(*) AS n FROM fact WHERE ActionGeo_Type BETWEEN 2 AND 5 AND len(string_split(ActionGeo_FullName, ', ')) >= 2 GROUP BY 2 HAVING COUNT(*) >= 20
UNION ALL SELECT 'city', split_part(ActionGeo_FullName, ', ', 1), COUNT(*) FROM fact WHERE len(string_split(ActionGeo_FullName, ', ')) >= 3 GROUP BY 2 HAVING COUNT(*) >= 50)
WHERE NOT regexp_matches(name, '\\b(University|Department|Bank|Tower|Hospital|Airport|College)\\b') AND name NOT IN ("""
    + ", ".join(f"'{x}'" for x in K.NOT_PLACES)
    + ")",
    "fact",
)
def _places(fact):
    return A.place_dictionary(fact, 20, 50)


@query(
    "h05_theme_overlap",
    """, n AS (SELECT event_day, split_part(unnest(string_split(V2Themes, ';')), ',', 1) AS theme FROM packed), s AS (SELECT list(theme) AS seed FROM (SELECT theme FROM n WHERE event_day = DATE '2024-01-05' AND theme <> '' GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 3)),
d AS (SELECT event_day, list(DISTINCT theme) AS themes FROM n WHERE theme <> '' GROUP BY 1)
SELECT event_day, round(len(list_intersect(themes, seed)) / len(list_distinct(list_concat(themes, seed))), 3) AS jaccard, array_to_string(list_slice(list_sort(list_intersect(themes, seed)), 1, 5), ';') AS shared FROM d, s
WHERE round(len(list_intersect(themes, seed)) / len(list_distinct(list_concat(themes, seed))), 3) >= 0.15""",
    "packed",
)
def _overlap(packed):
    return A.theme_overlap(packed, "2024-01-05", 0.15, 3)


@query("a15_profile", f"SELECT COUNT(*) AS n_rows, min(SQLDATE) AS first_day, max(SQLDATE) AS last_day, COUNT(DISTINCT SQLDATE) AS days, round(100.0 * {count_sql('ActionGeo_Lat IS NOT NULL AND ActionGeo_Long IS NOT NULL')} / COUNT(*), 2) AS placed_pct FROM fact", "fact")
def _profile(fact):
    return A.profile(fact)


@query("a16_coverage", f"SELECT SQLDATE, COUNT(*) AS events, {count_sql('GlobalEventID % 10 < dayofmonth(SQLDATE)')} AS derived FROM fact GROUP BY 1 HAVING derived < 0.9 * COUNT(*)", "fact")
def _coverage(fact):
    return A.coverage(fact, fact.where(F.col("GlobalEventID") % 10 < F.dayofmonth("SQLDATE")).select(F.col("GlobalEventID").alias("global_event_id")))


@query(
    "a18_reconcile",
    """, s AS (SELECT * FROM fact WHERE GlobalEventID % 7 <> 0), t AS (SELECT GlobalEventID, CASE WHEN GlobalEventID % 11 = 0 THEN GoldsteinScale + 1 ELSE GoldsteinScale + 0.00001 END AS GoldsteinScale, CASE WHEN GlobalEventID % 13 = 0 THEN NULL ELSE Actor1Name END AS Actor1Name FROM fact WHERE GlobalEventID % 5 <> 0),
b AS (SELECT s.GlobalEventID AS a, t.GlobalEventID AS b, s.GoldsteinScale AS g1, t.GoldsteinScale AS g2, s.Actor1Name AS n1, t.Actor1Name AS n2 FROM s FULL JOIN t ON s.GlobalEventID = t.GlobalEventID)
SELECT 'only_source' AS "check", COUNT(*) AS n FROM b WHERE b IS NULL UNION ALL SELECT 'only_target', COUNT(*) FROM b WHERE a IS NULL
UNION ALL SELECT 'differs_GoldsteinScale', COUNT(*) FROM b WHERE a IS NOT NULL AND b IS NOT NULL AND NOT coalesce(abs(g1 - g2) < 0.0001, g1 IS NULL AND g2 IS NULL)
UNION ALL SELECT 'differs_Actor1Name', COUNT(*) FROM b WHERE a IS NOT NULL AND b IS NOT NULL AND n1 IS DISTINCT FROM n2""",
    "fact",
)
def _reconcile(fact):
    i = F.col("GlobalEventID")
    target = fact.where(i % 5 != 0).withColumns({"GoldsteinScale": F.col("GoldsteinScale") + F.when(i % 11 == 0, 1.0).otherwise(0.00001), "Actor1Name": F.when(i % 13 != 0, F.col("Actor1Name"))})
    return A.reconcile(fact.where(i % 7 != 0), target, "GlobalEventID", ["GoldsteinScale", "Actor1Name"])
