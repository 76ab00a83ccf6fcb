"""Similar sets of names, relevance by themes and articles, nearest texts, and coverage of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.operators import analysis as A
from newsgrid.operators import events as E
from newsgrid.operators import lookup as L
from newsgrid.operators import nearest_texts as N
from newsgrid.operators import places as P
from newsgrid.operators import scores as C
from newsgrid.operators import set_similarity as J
from newsgrid.plans.events import PRINTS_SQL
from newsgrid.registry import CONTEXT_SQL, FACT_SQL, ORACLE_SQL, query
from newsgrid.sources import adapter


@query(
    "h06_similar_name_sets",
    """, sets AS (SELECT items, min(GlobalEventID) AS set_id, COUNT(*) AS members, COUNT(*) FILTER (GlobalEventID % 50 = 0) AS queries FROM (SELECT GlobalEventID, list_sort(list_distinct(['T' || CAST(GlobalEventID % 7 AS VARCHAR), Actor1Name, Actor2Name, ActionGeo_FullName])) AS items FROM fact) GROUP BY 1),
each AS (SELECT set_id, len(items) AS n, members, queries, unnest(items) AS item FROM sets),
met AS (SELECT q.set_id AS query_set, x.set_id AS other_set, any_value(q.n) + any_value(x.n) - COUNT(*) AS every, COUNT(*) AS overlap FROM each q JOIN each x ON q.item = x.item AND (q.set_id <> x.set_id OR x.members > 1) WHERE q.queries > 0 GROUP BY 1, 2)
SELECT query_set, other_set, CAST(overlap AS INTEGER) AS overlap, round(overlap / every, 6) AS jaccard FROM met WHERE overlap >= every * 0.15""",
    "fact",
)
def _sets(fact):
    names = F.array(F.concat(F.lit("T"), (F.col("GlobalEventID") % 7).cast("string")), "Actor1Name", "Actor2Name", "ActionGeo_FullName")
    sets = J.distinct_sets(fact, "GlobalEventID", names, F.col("GlobalEventID") % 50 == 0)
    return J.similar_sets(sets, 0.15).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "g09_context_relevance",
    CONTEXT_SQL
    + """, names AS (SELECT event_day, split_part(p, ',', 1) AS actor, split_part(unnest(ts), ',', 1) AS theme FROM (SELECT event_day, unnest(list_distinct(string_split(V2Persons, ';'))) AS p, string_split(V2Themes, ';') AS ts FROM packed)),
tops AS (SELECT actor, event_day, theme FROM names WHERE actor <> '' AND theme <> '' GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY actor, event_day ORDER BY COUNT(*) DESC, theme) <= 100),
themes AS MATERIALIZED (SELECT actor, event_day, list(theme) AS themes FROM tops GROUP BY 1, 2),
named AS MATERIALIZED (SELECT DISTINCT GLOBALEVENTID AS id, MentionSourceName AS source, MentionIdentifier AS url FROM mentions),
shared AS MATERIALIZED (SELECT a.id AS seed_id, b.id, COUNT(*) AS shared_articles FROM named a JOIN named b ON a.source = b.source AND a.url = b.url WHERE a.id % 50 = 0 GROUP BY 1, 2),
s AS (SELECT GlobalEventID AS seed_id, SQLDATE AS d, Actor1Name AS s1, Actor2Name AS s2, ActionGeo_FullName AS sp, CAST(coalesce(NumArticles, 0) AS DOUBLE) AS m, abs(coalesce(GoldsteinScale, 0)) AS h FROM fact WHERE GlobalEventID % 50 = 0),
c AS (SELECT *, datediff('day', d, SQLDATE) AS gap, CAST(coalesce(NumArticles, 0) AS DOUBLE) AS n, abs(coalesce(GoldsteinScale, 0)) AS g,
  len(list_intersect(list_filter([Actor1Name, Actor2Name], lambda x: x IS NOT NULL), list_filter([s1, s2], lambda x: x IS NOT NULL))) AS same FROM fact JOIN s ON abs(datediff('day', d, SQLDATE)) <= 9 AND GlobalEventID <> seed_id),
k AS (SELECT c.*, round(len(list_intersect(a.themes, b.themes)) / len(list_distinct(list_concat(a.themes, b.themes))), 3) AS theme_overlap, shared_articles
  FROM c LEFT JOIN themes a ON a.actor = s1 AND a.event_day = d LEFT JOIN themes b ON b.actor = s1 AND b.event_day = SQLDATE AND a.actor IS NOT NULL LEFT JOIN shared ON shared.seed_id = c.seed_id AND shared.id = GlobalEventID),
r AS (SELECT seed_id, GlobalEventID, SQLDATE, coalesce(theme_overlap, 0) AS theme_overlap, coalesce(shared_articles, 0) AS shared_articles, round(least(20, 20 * exp(-power(gap - CASE WHEN gap >= 0 THEN 4.5 ELSE -4.5 END, 2) / 18))
  + CASE WHEN ActionGeo_FullName IS NULL OR sp IS NULL THEN 2 WHEN ActionGeo_FullName = sp THEN 10 WHEN contains(ActionGeo_FullName, sp) OR contains(sp, ActionGeo_FullName) THEN 6 ELSE 2 END
  + CASE WHEN same >= 2 THEN 20 WHEN same = 1 THEN 12 ELSE 3 END
  + least(15, 8 * CASE WHEN greatest(n, m) = 0 THEN 1 ELSE 1 - abs(n - m) / greatest(n, m) END + 7 * CASE WHEN greatest(g, h) = 0 THEN 1 ELSE 1 - abs(g - h) / greatest(g, h) END)
  + CASE WHEN theme_overlap > 0 THEN 20 * theme_overlap ELSE 2 END
  + CASE WHEN shared_articles > 0 THEN least(7 + 8 * ln(1 + shared_articles) / ln(6), 15) ELSE 1 END, 6) AS score FROM k)
SELECT seed_id, GlobalEventID, SQLDATE, theme_overlap, shared_articles, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, SQLDATE, GlobalEventID) AS INTEGER) AS rank FROM r QUALIFY rank <= 10""",
)
def _context(spark, sf_dir):
    fact = adapter.fact(spark, sf_dir)
    return C.scored_in_context(fact.where(F.col("GlobalEventID") % 50 == 0), fact, adapter.packed(spark, sf_dir), adapter.mentions(spark, sf_dir), 9, 10)


_WEIGHED = "CAST(round(1000 * (1 + ln(tf)) * idf) AS BIGINT)"
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(
    "k04_nearest_texts",
    f"""WITH t AS (SELECT doc_id AS id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY 1, 2),
stats AS (SELECT term, ln(1 + CAST(number AS DOUBLE) / COUNT(*)) AS idf FROM t, (SELECT COUNT(DISTINCT id) AS number FROM t) GROUP BY term, number),
tr AS (SELECT id, term, {_WEIGHED} AS raw FROM t JOIN stats USING (term)),
tw AS MATERIALIZED (SELECT id, term, CAST(floor(1000000 * raw / sqrt(CAST(SUM(raw * raw) OVER (PARTITION BY id) AS DOUBLE))) AS BIGINT) AS w FROM tr),
q AS (SELECT item_id AS query_id, term, COUNT(*) AS tf FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY 1, 2),
qr AS (SELECT query_id, term, {_WEIGHED} AS raw FROM q JOIN stats USING (term)),
qw AS (SELECT query_id, term, CAST(floor(1000000 * raw / sqrt(CAST(SUM(raw * raw) OVER (PARTITION BY query_id) AS DOUBLE))) AS BIGINT) AS q FROM qr),
s AS (SELECT query_id, id, CAST(SUM(q * w) AS BIGINT) AS score FROM qw JOIN tw USING (term) GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM s WHERE score > 0 QUALIFY rank <= 3""",
)
def _nearest(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    weights, stats = N.lists(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", wanted=N.words(items))
    return N.nearest_texts(items, weights, stats, 3, "item_id")


_PIECES = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')"
#: The dictionary of places, as that query has it, as a further table.
_DICTIONARY = ORACLE_SQL["e42_place_dictionary"].removeprefix(FACT_SQL)


@query(
    "k12_places_of_dictionary",
    f""", {PRINTS_SQL}, dictionary AS ({_DICTIONARY}),
d AS (SELECT name, lower(name) AS key, len({_PIECES.format("name")}) AS n FROM (SELECT min(trim(name)) AS name FROM dictionary GROUP BY lower(trim(name)))),
p AS (SELECT global_event_id AS id, {_PIECES.format("lower(headline || '. ' || summary)")} AS pieces FROM prints),
w AS (SELECT id, pieces, unnest(range(1, len(pieces) + 1)) AS pos FROM p),
m AS (SELECT id, pos, name FROM w JOIN d ON array_to_string(list_slice(pieces, pos, pos + n - 1), '') = key)
SELECT p.id, place FROM p LEFT JOIN (SELECT id, name AS place FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos, length(name) DESC, name) = 1) f ON f.id = p.id""",
    "fact",
)
def _dictionary(fact):
    texts = E.fingerprints(fact).select("global_event_id", F.concat_ws(". ", "headline", "summary").alias("text"))
    return P.first_place(texts, A.place_dictionary(fact, 20, 50).select("name"), "global_event_id")


@query(
    "e05_merged_distincts",
    "SELECT CAST(date_trunc('week', SQLDATE) AS DATE) AS period, COUNT(*) AS events, COUNT(DISTINCT Actor1Name) AS Actor1Name, COUNT(DISTINCT ActionGeo_FullName) AS ActionGeo_FullName FROM fact GROUP BY 1",
    "fact",
)
def _distincts(fact):
    columns = ["Actor1Name", "ActionGeo_FullName"]
    return L.distincts_over(L.day_sketches(fact, columns), F.to_date(F.date_trunc("week", "SQLDATE")), columns)
