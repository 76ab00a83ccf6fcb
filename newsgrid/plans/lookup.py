"""Requests for events, names and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.functions import constants as K
from newsgrid.functions import scalars as S
from newsgrid.operators import analysis as A
from newsgrid.operators import events as E
from newsgrid.operators import lookup as L
from newsgrid.operators import rollups as R
from newsgrid.operators import scores as C
from newsgrid.plans.events import PRINTS_SQL
from newsgrid.plans.more import SUMMARY_SQL
from newsgrid.registry import ORACLE_SQL, count_sql, mean_sql, query
from newsgrid.sources.stored import counted


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ALIASES_SQL = "alias(k, v) AS (VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, vs in K.REGION_ALIASES.items() for v in vs) + ")"
STATES_SQL = "state(k, v) AS (VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in K.STATE_CODES.items()) + ")"
NAMES_SQL = "SELECT n_name AS t FROM nation UNION SELECT substr(n_name, 1, 2) FROM nation UNION SELECT n_name || ' city' FROM nation UNION SELECT 'New York, ' || n_name || ' , LA' FROM nation UNION SELECT c_name FROM customer UNION SELECT 'DC'"


@query(
    "b05_region_terms",
    f"""WITH texts AS ({NAMES_SQL}), {ALIASES_SQL}, {STATES_SQL},
parts AS (SELECT t, trim(unnest(regexp_split_to_array(t, '\\s*,\\s*'))) AS p FROM texts), known AS (SELECT t, t AS p FROM texts UNION SELECT t, p FROM parts WHERE length(p) > 1),
terms AS (SELECT t, p FROM known UNION SELECT t, regexp_replace(t, '\\s+(City|County|State)$', '', 'i') FROM texts UNION SELECT t, v FROM known JOIN alias ON k = p
  UNION SELECT t, k FROM texts JOIN state ON k = upper(t) UNION SELECT t, v FROM texts JOIN state ON k = upper(t) UNION SELECT t, 'Washington' FROM texts WHERE upper(t) = 'DC')
SELECT t AS region, array_to_string(list_sort(list(DISTINCT p)), '|') AS terms FROM terms GROUP BY 1""",
)
def _terms(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = F.col("n_name")
    texts = F.array(n, F.substring(n, 1, 2), F.concat(n, F.lit(" city")), F.concat(F.lit("New York, "), n, F.lit(" , LA")), F.lit("DC"))
    rows = read("nation").select(F.explode(texts).alias("region")).union(read("customer").select("c_name")).distinct()
    return rows.select("region", F.array_join(L.region_terms(F.col("region")), "|").alias("terms"))


@query(
    "b20_event_details",
    f""", {PRINTS_SQL}, asked AS (SELECT 'EVT-' || CAST(SQLDATE AS VARCHAR) || '-' || GlobalEventID AS request, GlobalEventID AS g, 1 AS way FROM fact UNION ALL SELECT lpad(CAST(GlobalEventID AS VARCHAR), 9, '0'), GlobalEventID, 1 FROM fact UNION ALL SELECT fingerprint, global_event_id, 2 FROM prints)
SELECT request, g AS "GlobalEventID", CASE WHEN way = 1 THEN coalesce(Actor1Name, 'Unknown') || ' vs ' || coalesce(Actor2Name, 'Unknown') ELSE headline END AS headline, CASE WHEN way = 1 THEN abs(GoldsteinScale) ELSE severity_score END AS severity_score, CASE WHEN way = 1 THEN ActionGeo_FullName ELSE location_name END AS location_name
FROM asked JOIN fact ON GlobalEventID = g JOIN prints ON global_event_id = g""",
    "fact",
)
def _details(fact):
    # requests and answers read both: derived once
    fact, _ = counted(fact)
    prints, _ = counted(E.fingerprints(fact).select("global_event_id", "fingerprint", "headline", "severity_score", "location_name"))
    ids = F.col("GlobalEventID").cast("string")
    asked = fact.select(F.explode(F.array(F.concat_ws("-", F.lit("EVT"), F.col("SQLDATE").cast("string"), ids), F.lpad(ids, 9, "0"))).alias("request"))
    return L.event_details(asked.union(prints.select("fingerprint")), fact, prints)


@query(
    "b21_first_by_id",
    """, r AS (SELECT CASE WHEN GLOBALEVENTID % 7 = 0 THEN NULL ELSE GLOBALEVENTID END AS id, MentionIdentifier AS url, event_day FROM mentions)
SELECT coalesce(id, -1) AS id, url, event_day FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY url, event_day) AS n FROM r) WHERE n = 1 OR id IS NULL""",
    "mentions",
)
def _first(mentions):
    rows = mentions.select(F.when(F.col("GLOBALEVENTID") % 7 != 0, F.col("GLOBALEVENTID")).alias("id"), F.col("MentionIdentifier").alias("url"), "event_day")
    return L.first_by_id(rows, "id", F.col("url"), F.col("event_day")).withColumn("id", F.coalesce("id", F.lit(-1)))


G, T = mean_sql("GoldsteinScale"), mean_sql("AvgTone")
LIVE = f"COUNT(*) AS total_events, {count_sql('GoldsteinScale < -5')} AS conflict_events, {count_sql('GoldsteinScale > 5')} AS cooperation_events, {G} AS avg_goldstein, {T} AS avg_tone"


@query(
    "e19_live_overview",
    f", own AS (SELECT * FROM fact WHERE ActionGeo_CountryCode = 'EU' OR contains(ActionGeo_FullName, 'eu')) SELECT COUNT(*) AS total, {G} AS avg_goldstein, {T} AS avg_tone, {count_sql('GoldsteinScale < -5')} AS conflicts, {count_sql('GoldsteinScale > 5')} AS cooperation, (SELECT string_agg(CAST(GlobalEventID AS VARCHAR), ';' ORDER BY NumArticles DESC, GlobalEventID) FROM (SELECT * FROM own ORDER BY NumArticles DESC, GlobalEventID LIMIT 5)) AS hot_events FROM own",
    "fact",
)
def _overview(fact):
    return L.live_overview(fact, "eu")


@query("e20_stored_or_live", f", {SUMMARY_SQL} SELECT date, total_events, conflict_events, cooperation_events, avg_goldstein, avg_tone, 'stored' AS source FROM totals WHERE dayofmonth(date) < 16 UNION ALL SELECT SQLDATE, {LIVE.replace('total_events', 'total_events')}, 'live' FROM fact WHERE dayofmonth(SQLDATE) >= 16 GROUP BY 1", "fact")
def _brief(fact):
    return L.daily_brief(R.daily_summary(fact.where(F.dayofmonth("SQLDATE") < 16)), fact)


@query("e05_distinct_by_day", "SELECT COUNT(DISTINCT Actor1Name) AS unique_actors FROM fact", "fact")
def _distinct(fact):
    return L.distinct_by_day(fact)


@query("e02_top_countries", "SELECT ActionGeo_CountryCode AS country, COUNT(*) AS event_count FROM fact WHERE ActionGeo_CountryCode <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "fact")
def _countries(fact):
    return A.top_values(fact, "ActionGeo_CountryCode", 10, "country")


@query("e15_region_days", f"SELECT ActionGeo_CountryCode AS region_code, SQLDATE AS date, {LIVE} FROM fact WHERE ActionGeo_CountryCode <> '' GROUP BY 1, 2 HAVING COUNT(*) > 10", "fact")
def _region_days(fact):
    """The older form of a region's days: no lists, days of over ten events."""
    own = fact.where("ActionGeo_CountryCode <> ''").groupBy(F.col("ActionGeo_CountryCode").alias("region_code"), F.col("SQLDATE").alias("date"))
    rows = own.agg(F.count("*").alias("total_events"), S.share(S.conflict()).alias("conflict_events"), S.share(S.cooperation()).alias("cooperation_events"), S.mean(F.col("GoldsteinScale")).alias("avg_goldstein"), S.mean(F.col("AvgTone")).alias("avg_tone"))
    return rows.where(F.col("total_events") > 10)


@query("e44_sources_of_events", "SELECT sources, COUNT(*) AS events FROM (SELECT COUNT(DISTINCT MentionSourceName) AS sources FROM mentions GROUP BY GLOBALEVENTID) GROUP BY 1", "mentions")
def _sources(mentions):
    return L.source_distribution(mentions)


@query(
    "g04_hot_events",
    f""", {PRINTS_SQL}, hot AS (SELECT SQLDATE, GlobalEventID, row_number() OVER (PARTITION BY SQLDATE ORDER BY coalesce(NumArticles, 0) * abs(coalesce(GoldsteinScale, 0)) DESC, GlobalEventID) AS rank FROM fact),
live AS (SELECT SQLDATE, GlobalEventID, row_number() OVER (PARTITION BY SQLDATE ORDER BY NumArticles DESC, GlobalEventID) AS rank FROM fact),
pick AS (SELECT * FROM hot WHERE rank <= 5 AND dayofmonth(SQLDATE) < 16 UNION ALL SELECT * FROM live WHERE rank <= 5 AND dayofmonth(SQLDATE) >= 16)
SELECT SQLDATE, CAST(rank AS INTEGER) AS rank, GlobalEventID, CASE WHEN GlobalEventID % 3 = 0 AND dayofmonth(SQLDATE) >= 16 THEN 'EVT-' || CAST(SQLDATE AS VARCHAR) || '-' || GlobalEventID ELSE fingerprint END AS fingerprint, CASE WHEN GlobalEventID % 3 = 0 AND dayofmonth(SQLDATE) >= 16 THEN 'temp' ELSE 'standard' END AS fp_type
FROM pick JOIN prints ON global_event_id = GlobalEventID""",
    "fact",
)
def _hot(fact):
    """Days of the first half of a month have stored lists; later events of every third id have no fingerprint yet."""
    early = F.dayofmonth("SQLDATE") < 16
    prints = E.fingerprints(fact.where(early | (F.col("GlobalEventID") % 3 != 0)))
    hot = E.hot_per_day(fact.where(early), 20).join(prints.select(F.col("global_event_id").alias("GlobalEventID"), "fingerprint"), "GlobalEventID")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("rank", "fingerprint"))), lambda x: x["fingerprint"])
    return L.hot_events(hot.groupBy(F.col("SQLDATE").alias("date")).agg(lists.alias("hot")), fact, prints)


@query("g10_reranked")
def _reranked(fact_or_spark, sf_dir):
    """Storylines of the seeds whose id is divisible by 50, ranked again by relevance; compared with plain Python in tests."""
    from newsgrid.sources.adapter import fact as read

    fact = read(fact_or_spark, sf_dir)
    seeds = fact.where(F.col("GlobalEventID") % 50 == 0)
    storylines, _ = counted(E.storyline(seeds, fact, 7, 5, 15))
    return L.reranked(storylines, C.scored_pairs(storylines, seeds, fact))


@query(
    "j13_alias_terms",
    "WITH alias(k, v) AS (VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in K.ACTOR_ALIASES.items()) + "), raw AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT k FROM alias UNION SELECT v FROM alias), normal AS (SELECT name, coalesce(v, name) AS n FROM raw LEFT JOIN alias ON k = name), terms AS (SELECT name, n AS t FROM normal UNION SELECT name, k FROM normal JOIN alias ON v = n) SELECT name, array_to_string(list_sort(list(DISTINCT t)), ';') AS terms FROM terms GROUP BY 1",
)
def _aliases(spark, sf_dir):
    listed = F.explode(F.array(*map(F.lit, sorted({*K.ACTOR_ALIASES, *K.ACTOR_ALIASES.values()})))).alias("name")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    names = nations.select(F.col("n_name").alias("name")).union(nations.select(listed)).distinct()
    return names.select("name", F.array_join(L.alias_terms(F.col("name")), ";").alias("terms"))


@query(
    "j15_suffix_variants",
    """SELECT name, array_to_string(list_sort(list_distinct(list_filter([name, upper(substr(name, 1, 1)) || lower(substr(name, 2)), CASE WHEN name ILIKE '%an' AND length(name) > 4 THEN left(name, length(name) - 2) || 'a' END, CASE WHEN name ILIKE '%ish' AND length(name) > 5 THEN left(name, length(name) - 3) || 'ain' END,
  CASE WHEN name ILIKE '%ese' AND length(name) > 5 THEN left(name, length(name) - 3) END, CASE WHEN name ILIKE '%ian' AND length(name) > 5 THEN left(name, length(name) - 3) || 'a' END, CASE WHEN name ILIKE '%i' AND length(name) > 3 THEN left(name, length(name) - 1) END], lambda x: x IS NOT NULL))), ';') AS variants
FROM (SELECT DISTINCT regexp_replace(n_name, ' .*', '') || s AS name FROM nation, (SELECT unnest(['', 'an', 'ISH', 'ese', 'ian', 'I']) AS s))""",
)
def _variants(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    ends = F.explode(F.array(*map(F.lit, ["", "an", "ISH", "ese", "ian", "I"])))
    names = nations.select(F.regexp_replace("n_name", " .*", "").alias("stem"), ends.alias("s")).select(F.concat("stem", "s").alias("name")).distinct()
    return names.select("name", F.array_join(L.suffix_variants(F.col("name")), ";").alias("variants"))


@query(
    "j17_fine_labels",
    "SELECT EventCode, label, COUNT(*) AS n FROM (SELECT EventCode, coalesce(v, CASE WHEN coalesce(EventCode, '') = '' THEN 'Unknown event' ELSE 'Event type ' || EventCode END) AS label FROM fact LEFT JOIN (VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in K.CODE_LABELS.items()) + ") c(k, v) ON k = EventCode) GROUP BY ALL",
    "fact",
)
def _labels(fact):
    return fact.groupBy("EventCode", L.fine_label(F.col("EventCode"), K.CODE_LABELS).alias("label")).agg(F.count("*").alias("n"))


@query("j31_series_keys")
def _keys(spark, sf_dir):
    """Keys of filters made from pairs of actors and countries; tests compare them with the rules in plain Python."""
    from newsgrid.sources.adapter import fact as read

    a, b, c = F.col("Actor1Name"), F.col("Actor2Name"), F.col("ActionGeo_CountryCode")
    forms = F.array(F.concat(a, F.lit(" vs "), b), F.concat(F.lit("actor pair: "), b, F.lit("/"), a), c, F.lit("united states and china"), F.lit("COUNTRY_PAIR:RUSSIA-CHINA"), F.lit(""))
    rows = read(spark, sf_dir).select(F.explode(forms).alias("region")).distinct()
    return rows.select("region", L.series_key(F.col("region"), F.lit(None).cast("string")).alias("series_id"))


@query("b17_odd_names", "SELECT p_name AS name, COUNT(*) AS n FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN p_name || ' é' ELSE p_name END AS p_name FROM part) WHERE regexp_matches(p_name, '[^ -~]') GROUP BY 1")
def _odd(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" é"))).otherwise(F.col("p_name"))
    return L.odd_names(spark.read.parquet(f"{sf_dir}/part.parquet").select(name.alias("ActionGeo_FullName")))


@query("b16_guarded_themes", "SELECT event_day, COUNT(*) AS n FROM packed WHERE event_day BETWEEN DATE '2024-01-05' AND DATE '2024-01-11' GROUP BY 1", "packed")
def _guarded(packed):
    return L.guarded_range(packed, "2024-01-05", "2024-01-11", 7).groupBy("event_day").agg(F.count("*").alias("n"))


def verdict(rows):
    """rows of compare_periods (earlier, later, n1, n2, direction, percent_change_per_day) with a sentence."""
    n = lambda c: F.format_number(c, 0)
    a, b, pct = F.col("earlier"), F.col("later"), F.col("percent_change_per_day")
    two = F.concat(n("n1"), F.lit(" to "), n("n2"))
    word = F.when(F.col("direction") == "increase", "up").otherwise("down")
    text = (
        F.when(F.col("direction") == "no_data", F.concat(F.lit("No matching events were found in "), a, F.lit(" or "), b, F.lit(".")))
        .when(F.col("direction") == "new_activity", F.concat(b, F.lit(" had "), n("n2"), F.lit(" matching events; "), a, F.lit(" had none.")))
        .when(F.col("direction") == "inconclusive_low_volume", F.concat(F.lit("Too few events to call a direction: "), n("n1"), F.lit(" in "), a, F.lit(" and "), n("n2"), F.lit(" in "), b, F.lit(".")))
        .when(F.col("direction") == "flat", F.concat(F.lit("About flat: "), n("n1"), F.lit(" events in "), a, F.lit(" vs "), n("n2"), F.lit(" in "), b, F.lit(" ("), F.format_string("%+.1f", pct), F.lit("% per day).")))
        .otherwise(F.concat(b, F.lit(" is "), word, F.lit(" "), F.format_string("%.1f", F.abs(pct)), F.lit("% per day versus "), a, F.lit(" ("), two, F.lit(" events).")))
    )
    return rows.withColumn("verdict", text)


@query(
    "e17_verdicts",
    f"""WITH c AS ({ORACLE_SQL['e17_compare_periods']}) SELECT earlier, later, CASE direction WHEN 'no_data' THEN 'No matching events were found in ' || earlier || ' or ' || later || '.' WHEN 'new_activity' THEN later || ' had ' || format('{{:,}}', n2) || ' matching events; ' || earlier || ' had none.'
  WHEN 'inconclusive_low_volume' THEN 'Too few events to call a direction: ' || format('{{:,}}', n1) || ' in ' || earlier || ' and ' || format('{{:,}}', n2) || ' in ' || later || '.'
  WHEN 'flat' THEN 'About flat: ' || format('{{:,}}', n1) || ' events in ' || earlier || ' vs ' || format('{{:,}}', n2) || ' in ' || later || ' (' || printf('%+.1f', percent_change_per_day) || '% per day).'
  ELSE later || ' is ' || CASE direction WHEN 'increase' THEN 'up' ELSE 'down' END || ' ' || printf('%.1f', abs(percent_change_per_day)) || '% per day versus ' || earlier || ' (' || format('{{:,}}', n1) || ' to ' || format('{{:,}}', n2) || ' events).' END AS verdict FROM c""",
)
def _verdicts(spark, sf_dir):
    from newsgrid.plans.analysis import _compare
    from newsgrid.sources.adapter import fact as read

    return verdict(_compare(read(spark, sf_dir))).select("earlier", "later", "verdict")
