"""Filters, scalars, searches and top lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsgrid.functions import constants as K
from newsgrid.functions import scalars as S
from newsgrid.operators import events as E
from newsgrid.operators import keyword_index as I
from newsgrid.registry import count_sql, query

START, END = "2024-01-05", "2024-01-20"
DAYS = f"SQLDATE BETWEEN DATE '{START}' AND DATE '{END}'"


def _case(column: str, i: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in K.ROOTS.items())
    return f"CASE {column} {whens} ELSE '{K.DEFAULT_ROOT[i]}' END"


PRINTS_SQL = f"""prints AS (
  SELECT GlobalEventID AS global_event_id,
    concat_ws('-', coalesce(nullif(ActionGeo_CountryCode, ''), 'XX'), strftime(SQLDATE, '%Y%m%d'),
      coalesce(nullif(substr(regexp_replace(upper(split_part(coalesce(ActionGeo_FullName, ''), ',', 1)), '[^A-Z]', '', 'g'), 1, 3), ''), 'UNK'),
      {_case("EventRootCode", 0)}, CAST(GlobalEventID AS VARCHAR)) AS fingerprint,
    left(coalesce(Actor1Name, 'Unidentified actor') || ' ' || {_case("EventRootCode", 2)}
      || CASE WHEN Actor2Name IS NULL THEN '' WHEN {_case("EventRootCode", 3)} = '' THEN ' ' || Actor2Name ELSE ' ' || {_case("EventRootCode", 3)} || ' ' || Actor2Name END
      || CASE WHEN ActionGeo_FullName IS NULL THEN '' ELSE ' (' || ActionGeo_FullName || ')' END, 255) AS headline,
    {_case("EventRootCode", 1)} || ' involving ' || coalesce(nullif(concat_ws(', ', Actor1Name, Actor2Name), ''), 'unidentified actors')
      || CASE WHEN ActionGeo_FullName IS NULL THEN '' ELSE ' in ' || ActionGeo_FullName END
      || ', Goldstein ' || printf('%.1f', coalesce(GoldsteinScale, 0.0)) || ', ' || CAST(coalesce(NumArticles, 0) AS VARCHAR) || ' articles.' AS summary,
    list_filter([Actor1Name, Actor2Name], lambda x: x IS NOT NULL) AS key_actors,
    {_case("EventRootCode", 1)} AS event_type_label,
    least(10.0, least(10.0, greatest(1.0, abs(coalesce(GoldsteinScale, 0)) * 2)) + CASE WHEN coalesce(NumArticles, 0) > 100 THEN 1 ELSE 0 END)::DOUBLE AS severity_score,
    left(coalesce(ActionGeo_FullName, ''), 100) AS location_name, coalesce(nullif(ActionGeo_CountryCode, ''), 'XX') AS location_country,
    trim(regexp_replace(lower(regexp_replace(coalesce(SOURCEURL, ''), '^https?://[^/]+', '', 'i')), '[^a-z0-9]+', ' ', 'g')) AS source_text
  FROM fact
)"""


@query("j04_fingerprints", f", {PRINTS_SQL} SELECT * EXCLUDE (key_actors), array_to_string(key_actors, ';') AS key_actors FROM prints", "fact")
def _fingerprints(fact):
    return E.fingerprints(fact).withColumn("key_actors", F.array_join("key_actors", ";"))


@query("b01_date_range", f"SELECT * FROM fact WHERE {DAYS}", "fact")
def _date_range(fact):
    return E.between_dates(fact, START, END)


@query(
    "b02_event_types",
    f"SELECT {count_sql('GoldsteinScale < -5')} AS conflict, {count_sql('GoldsteinScale > 5')} AS cooperation, {count_sql("EventRootCode = '14'")} AS protest, {count_sql('GoldsteinScale < 0')} AS daily_conflict, COUNT(*) AS any_type FROM fact",
    "fact",
)
def _event_types(fact):
    kinds = [(k, E.of_type(k)) for k in ("conflict", "cooperation", "protest")] + [("daily_conflict", E.of_type("conflict", K.DAILY_BAR)), ("any_type", E.of_type("any"))]
    return fact.agg(*(S.share(c).alias(n) for n, c in kinds))


@query("b03_exact_place", "SELECT GlobalEventID, ActionGeo_FullName FROM fact WHERE ActionGeo_CountryCode = 'AS' OR ActionGeo_FullName = 'FRANCE, EUROPE'", "fact")
def _exact_place(fact):
    return fact.where(E.at_place("AS") | E.at_place("FRANCE, EUROPE")).select("GlobalEventID", "ActionGeo_FullName")


@query(
    "b04_place_hint",
    "SELECT GlobalEventID, ActionGeo_FullName FROM fact WHERE ActionGeo_CountryCode = 'CITY 3' OR starts_with(ActionGeo_FullName, 'CITY 3') OR trim(list_extract(string_split(ActionGeo_FullName, ','), greatest(len(string_split(ActionGeo_FullName, ',')) - 1, 1))) = 'CITY 3'",
    "fact",
)
def _place_hint(fact):
    return fact.where(E.at_place(hint="CITY 3")).select("GlobalEventID", "ActionGeo_FullName")


@query("b06_actor_either_side", "SELECT GlobalEventID, Actor1Name, Actor2Name FROM fact WHERE coalesce(Actor1Name = 'ACTOR 3', false) OR coalesce(Actor2Name = 'ACTOR 3', false) OR coalesce(contains(Actor1Name, 'R 7'), false) OR coalesce(contains(Actor2Name, 'R 7'), false)", "fact")
def _actor(fact):
    return fact.where(E.with_actor("ACTOR 3") | E.with_actor(contains="R 7")).select("GlobalEventID", "Actor1Name", "Actor2Name")


@query("b07_actor_first_side", "SELECT GlobalEventID FROM fact WHERE Actor1Name = 'ACTOR 3'", "fact")
def _actor_first(fact):
    return fact.where(E.with_actor("ACTOR 3", first_only=True)).select("GlobalEventID")


@query(
    "b08_all_words",
    f", {PRINTS_SQL} SELECT global_event_id, headline FROM prints WHERE list_has_all(string_split(regexp_replace(lower(headline || ' ' || source_text), '[^a-z0-9]+', ' ', 'g'), ' '), ['protests', 'europe'])",
    "fact",
)
def _words(fact):
    return E.with_all_words(E.fingerprints(fact), ["protests", "europe"]).select("global_event_id", "headline")


@query("b08_keyword_index", f", {PRINTS_SQL} SELECT global_event_id, headline, source_text FROM prints WHERE list_has_all(string_split(regexp_replace(lower(headline || ' ' || source_text), '[^a-z0-9]+', ' ', 'g'), ' '), ['with', 'consults', 'europe'])", "fact")
def _indexed(fact):
    """The index is written from one half of the rows, then the other half is appended to it."""
    prints, spark = E.fingerprints(fact), fact.sparkSession
    index, tokens = f"keyword_index_{uuid.uuid4().hex}", I.words("headline", "source_text")
    for half in (0, 1):
        I.append(prints.where(F.pmod(F.col("global_event_id"), F.lit(2)) == half), index, "global_event_id", tokens, buckets=16)
    return I.search(prints, index, ["with", "consults", "europe"], "global_event_id").select("global_event_id", "headline", "source_text")


@query(
    "b09_keyword_terms",
    "SELECT doc_id, array_to_string(list_slice(t, 1, 5), ' ') AS terms FROM (SELECT doc_id, list_filter(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'i': list_position(w, x), 'w': x})), lambda s: s.w), lambda x: length(x) >= 3 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in K.FILLER_WORDS)
    + "], x)) AS t FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents))",
)
def _terms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.array_join(S.keyword_terms(F.col("text")), " ").alias("terms"))


@query("b10_known_coordinates", "SELECT GlobalEventID, ActionGeo_Lat, ActionGeo_Long FROM fact WHERE ActionGeo_Lat IS NOT NULL AND ActionGeo_Long IS NOT NULL AND ActionGeo_Lat <> 0 AND ActionGeo_Long <> 0", "fact")
def _coordinates(fact):
    return fact.where(E.has_place()).select("GlobalEventID", "ActionGeo_Lat", "ActionGeo_Long")


@query("b12_bounding_box", "SELECT GlobalEventID FROM fact WHERE ActionGeo_Lat BETWEEN -60 AND 70 AND ActionGeo_Long BETWEEN -150 AND 160", "fact")
def _box(fact):
    return fact.where(E.in_box(-60, 70, -150, 160)).select("GlobalEventID")


@query(
    "b13_radius",
    """, d AS (SELECT GlobalEventID, 2 * 6370.986 * asin(least(1.0, sqrt(power(sin((radians(10.0) - radians(ActionGeo_Lat)) / 2), 2) + cos(radians(ActionGeo_Lat)) * cos(radians(10.0)) * power(sin(radians(20.0 - ActionGeo_Long) / 2), 2)))) AS km FROM fact)
SELECT GlobalEventID, CAST(round(km, 3) AS DOUBLE) AS km FROM d WHERE km <= 6000""",
    "fact",
)
def _radius(fact):
    return E.within(fact, 10.0, 20.0, 6000).select("GlobalEventID", F.round("km", 3).alias("km"))


@query("c01_details", f", {PRINTS_SQL} SELECT f.GlobalEventID, f.SQLDATE, p.fingerprint, p.severity_score FROM fact f LEFT JOIN prints p ON p.global_event_id = f.GlobalEventID", "fact")
def _details(fact):
    return E.detailed(fact, E.fingerprints(fact)).select("GlobalEventID", "SQLDATE", "fingerprint", "severity_score")


@query(
    "g01_search",
    f", {PRINTS_SQL}, best AS (SELECT * FROM fact WHERE {DAYS} AND GoldsteinScale < -5 AND (coalesce(contains(Actor1Name, 'ACTOR 1'), false) OR coalesce(contains(Actor2Name, 'ACTOR 1'), false)) ORDER BY NumArticles DESC, GlobalEventID LIMIT 50) SELECT {', '.join(E.EVENT_COLUMNS)}, fingerprint, headline, summary, event_type_label, severity_score FROM best LEFT JOIN prints ON global_event_id = GlobalEventID",
    "fact",
)
def _search(fact):
    return E.search(fact, START, END, "conflict", actor="ACTOR 1")


@query("g02_top_events", f"SELECT GlobalEventID, SQLDATE, EventRootCode, NumArticles, SOURCEURL FROM fact WHERE {DAYS} AND EventRootCode = '14' ORDER BY NumArticles DESC, GlobalEventID LIMIT 20", "fact")
def _top(fact):
    found = E.between_dates(fact, START, END).where(E.of_type("protest"))
    return E.top(found.select("GlobalEventID", "SQLDATE", "EventRootCode", "NumArticles", "SOURCEURL"), 20)


@query("g03_geo_points", f"SELECT GlobalEventID, ActionGeo_Lat AS lat, ActionGeo_Long AS lng, NumArticles FROM fact WHERE {DAYS} AND ActionGeo_Lat IS NOT NULL AND ActionGeo_Long IS NOT NULL AND ActionGeo_Lat <> 0 AND ActionGeo_Long <> 0 ORDER BY NumArticles DESC, GlobalEventID LIMIT 100", "fact")
def _geo(fact):
    found = E.between_dates(fact, START, END).where(E.has_place())
    return E.top(found.select("GlobalEventID", F.col("ActionGeo_Lat").alias("lat"), F.col("ActionGeo_Long").alias("lng"), "NumArticles"), 100)


@query("a14_actor_stream", "SELECT GlobalEventID, SQLDATE, NumArticles FROM fact WHERE coalesce(Actor1Name = 'ACTOR 5', false) OR coalesce(Actor2Name = 'ACTOR 5', false) ORDER BY SQLDATE DESC, GlobalEventID LIMIT 200", "fact")
def _actor_stream(fact):
    return E.top(fact.where(E.with_actor("ACTOR 5")).select("GlobalEventID", "SQLDATE", "NumArticles"), 200, F.desc("SQLDATE"))


@query(
    "f01_hot_per_day",
    "SELECT SQLDATE, rank, GlobalEventID FROM (SELECT SQLDATE, GlobalEventID, CAST(row_number() OVER (PARTITION BY SQLDATE ORDER BY coalesce(NumArticles, 0) * abs(coalesce(GoldsteinScale, 0)) DESC, GlobalEventID) AS INTEGER) AS rank FROM fact) WHERE rank <= 20",
    "fact",
)
def _hot(fact):
    return E.hot_per_day(fact, 20).select("SQLDATE", "rank", "GlobalEventID")


@query(
    "g07_similar_events",
    """, s AS (SELECT GlobalEventID AS seed_id, SQLDATE AS d, Actor1Name AS s1, Actor2Name AS s2, ActionGeo_FullName AS p FROM fact WHERE GlobalEventID % 50 = 0),
m AS (SELECT seed_id, GlobalEventID, SQLDATE, NumArticles,
  CASE WHEN coalesce(Actor1Name = s1 AND Actor2Name = s2, false) OR coalesce(Actor1Name = s2 AND Actor2Name = s1, false) THEN 2
       WHEN coalesce(Actor1Name = s1, false) OR coalesce(Actor2Name = s2, false) OR coalesce(Actor1Name = s2, false) OR coalesce(Actor2Name = s1, false) THEN 1 ELSE 0 END AS actor_rank,
  CASE WHEN ActionGeo_FullName = p THEN 1 ELSE 0 END AS place_rank
  FROM fact JOIN s ON abs(datediff('day', d, SQLDATE)) BETWEEN 1 AND 10 AND GlobalEventID <> seed_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY actor_rank DESC, place_rank DESC, NumArticles DESC, GlobalEventID) AS INTEGER) AS rank FROM m)
SELECT seed_id, rank, GlobalEventID, SQLDATE, actor_rank, place_rank, NumArticles FROM r WHERE rank <= 25""",
    "fact",
)
def _similar(fact):
    return E.similar(fact.where(F.col("GlobalEventID") % 50 == 0), fact, 10, 25)


@query(
    "g08_storyline",
    """, s AS (SELECT GlobalEventID AS seed_id, SQLDATE AS d, Actor1Name AS s1, Actor2Name AS s2 FROM fact WHERE GlobalEventID % 50 = 0),
m AS (SELECT seed_id, GlobalEventID, SQLDATE, NumArticles, datediff('day', d, SQLDATE) AS ahead,
  coalesce(Actor1Name = s1, false) AS a11, coalesce(Actor2Name = s2, false) AS a22, coalesce(Actor1Name = s2, false) AS a12, coalesce(Actor2Name = s1, false) AS a21, Actor1Name IS NOT NULL AS has1
  FROM fact JOIN s ON datediff('day', d, SQLDATE) BETWEEN -7 AND 5 AND GlobalEventID <> seed_id),
c AS (SELECT *, CASE WHEN (a11 AND a22) OR (a12 AND a21) THEN 2.0 WHEN a11 OR a22 OR a12 OR a21 THEN 1.0 ELSE 0.0 END AS actors,
  CASE WHEN a21 AND has1 AND NOT a11 AND NOT a12 THEN 2.0 WHEN a22 AND has1 AND NOT a11 AND NOT a12 THEN 1.0 WHEN a11 OR a22 OR a12 OR a21 THEN 0.5 END AS reaction FROM m),
u AS (SELECT seed_id, GlobalEventID, SQLDATE, NumArticles, 'preceding' AS phase, actors AS score FROM c WHERE ahead < 0
  UNION ALL SELECT seed_id, GlobalEventID, SQLDATE, NumArticles, 'following', actors FROM c WHERE ahead > 0
  UNION ALL SELECT seed_id, GlobalEventID, SQLDATE, NumArticles, 'reactions', reaction FROM c WHERE ahead > 0 AND reaction IS NOT NULL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id, phase ORDER BY score DESC, NumArticles DESC, GlobalEventID) AS INTEGER) AS rank FROM u)
SELECT seed_id, GlobalEventID, SQLDATE, NumArticles, phase, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 15""",
    "fact",
)
def _storyline(fact):
    return E.storyline(fact.where(F.col("GlobalEventID") % 50 == 0), fact, 7, 5, 15)


@query(
    "c08_shared_articles",
    """, a AS (SELECT DISTINCT GLOBALEVENTID AS seed_id, MentionSourceName, MentionIdentifier FROM mentions WHERE GLOBALEVENTID % 50 = 0),
b AS (SELECT DISTINCT GLOBALEVENTID, MentionSourceName, MentionIdentifier FROM mentions)
SELECT seed_id, b.GLOBALEVENTID, COUNT(*) AS shared_articles, COUNT(DISTINCT b.MentionSourceName) AS shared_sources,
  array_to_string(list_slice(list_sort(list(DISTINCT b.MentionIdentifier)), 1, 5), ' ') AS sample_urls
FROM a JOIN b ON a.MentionSourceName = b.MentionSourceName AND a.MentionIdentifier = b.MentionIdentifier AND b.GLOBALEVENTID <> seed_id GROUP BY 1, 2""",
    "mentions",
)
def _shared(mentions):
    return E.shared_articles(mentions, mentions.where(F.col("GLOBALEVENTID") % 50 == 0))


@query("g12_suggest_actors", "SELECT actor, COUNT(*) AS event_count FROM (SELECT Actor1Name AS actor FROM fact UNION ALL SELECT Actor2Name FROM fact) WHERE starts_with(actor, 'ACTOR 1') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", "fact")
def _suggest(fact):
    return E.suggest_actors(fact, "ACTOR 1", 8)


@query(
    "h01_union_search",
    f"SELECT * FROM (SELECT GlobalEventID, SQLDATE, NumArticles FROM fact WHERE {DAYS} AND GoldsteinScale < -5 UNION SELECT GlobalEventID, SQLDATE, NumArticles FROM fact WHERE {DAYS} AND EventRootCode = '14') ORDER BY NumArticles DESC, GlobalEventID LIMIT 60",
    "fact",
)
def _union(fact):
    rows = E.between_dates(fact, START, END)
    pick = lambda kind: rows.where(E.of_type(kind)).select("GlobalEventID", "SQLDATE", "NumArticles")
    return E.union_search(pick("conflict"), pick("protest"), 60)


