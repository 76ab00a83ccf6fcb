"""Finding events and names: region terms, detail requests, hot events, live overviews, name variants, series keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrid.functions import constants as K
from newsgrid.functions import scalars as S
from newsgrid.operators import events as E


def region_terms(region: Column) -> Column:
    """Sorted terms to look for: the text itself, without a last City, County or State, its parts between commas, other
    names of these, and the code and name of a first-level division given by its code."""
    text = F.trim(region)
    parts = F.filter(F.transform(F.split(text, r"\s*,\s*"), lambda p: F.trim(p)), lambda p: F.length(p) > 1)
    known = F.array_union(F.array(text), parts)
    aliases = F.create_map(*(x for k, v in K.REGION_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    others = F.flatten(F.transform(known, lambda p: F.coalesce(aliases[p], F.array().cast("array<string>"))))
    code = F.upper(text)
    name = S.lookup(code, K.STATE_CODES)
    state = F.when(name.isNull(), F.array().cast("array<string>")).when(code == "DC", F.array(code, name, F.lit("Washington"))).otherwise(F.array(code, name))
    short = F.regexp_replace(text, r"(?i)\s+(City|County|State)$", "")
    return F.array_sort(F.array_distinct(F.concat(known, F.array(short), others, state)))


def event_details(requests: DataFrame, events: DataFrame, prints: DataFrame) -> DataFrame:
    """requests (request) with the event each names: EVT-date-id, an id of 9 to 12 digits, or a fingerprint.

    One equality join on ids and one on fingerprints; requests that name nothing are left out.
    """
    dashed = F.when(F.size(F.split("request", "-")) >= 4, F.expr("try_cast(element_at(split(request, '-'), -1) AS bigint)"))
    by_id = F.when(F.col("request").startswith("EVT-"), dashed).when(F.col("request").rlike(r"^\d{9,12}$"), F.col("request").try_cast("long"))
    asked = requests.select("request", by_id.alias("GlobalEventID"))
    direct = asked.where("GlobalEventID IS NOT NULL").join(events, "GlobalEventID")
    names = [F.coalesce(F.col(c), F.lit("Unknown")) for c in ("Actor1Name", "Actor2Name")]
    direct = direct.select("request", "GlobalEventID", F.concat(names[0], F.lit(" vs "), names[1]).alias("headline"), F.abs("GoldsteinScale").alias("severity_score"), F.col("ActionGeo_FullName").alias("location_name"))
    named = asked.where(F.col("GlobalEventID").isNull() & ~F.col("request").startswith("EVT-")).select("request")
    found = named.join(prints, F.col("request") == F.col("fingerprint"))
    found = found.select("request", F.col("global_event_id").alias("GlobalEventID"), "headline", "severity_score", "location_name")
    return direct.unionByName(found)


def first_by_id(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by order, and all rows without a key."""
    ranked = rows.where(F.col(key).isNotNull()).withColumn("first_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("first_rank = 1").drop("first_rank").unionByName(rows.where(F.col(key).isNull()))


def in_region(region: str) -> Column:
    return (F.col("ActionGeo_CountryCode") == region.upper()) | F.col("ActionGeo_FullName").contains(region)


def live_overview(events: DataFrame, region: str, n: int = 5) -> DataFrame:
    """One row: totals of a region's events, and the ids of the n with the most articles."""
    own = events.where(in_region(region))
    totals = own.agg(F.count("*").alias("total"), S.mean(F.col("GoldsteinScale")).alias("avg_goldstein"), S.mean(F.col("AvgTone")).alias("avg_tone"), F.coalesce(S.share(S.conflict()), F.lit(0)).alias("conflicts"), F.coalesce(S.share(S.cooperation()), F.lit(0)).alias("cooperation"))
    best = own.orderBy(F.desc("NumArticles"), "GlobalEventID").limit(n)
    ids = F.transform(F.array_sort(F.collect_list(F.struct(-F.col("NumArticles"), F.col("GlobalEventID").alias("id")))), lambda x: x["id"].cast("string"))
    return totals.crossJoin(F.broadcast(best.agg(F.array_join(ids, ";").alias("hot_events"))))  # one row each


def live_brief(events: DataFrame) -> DataFrame:
    """Totals by day as the live brief gives them: only scores beyond 5 count as conflict or cooperation."""
    return events.groupBy(F.col("SQLDATE").alias("date")).agg(F.count("*").alias("total_events"), S.share(S.conflict()).alias("conflict_events"), S.share(S.cooperation()).alias("cooperation_events"), S.mean(F.col("GoldsteinScale")).alias("avg_goldstein"), S.mean(F.col("AvgTone")).alias("avg_tone"))


def daily_brief(stored: DataFrame, events: DataFrame) -> DataFrame:
    """The stored row of a day, else its live totals; source says which."""
    live = live_brief(events.join(stored.select(F.col("date").alias("SQLDATE")), "SQLDATE", "left_anti"))
    columns = ["date", "total_events", "conflict_events", "cooperation_events", "avg_goldstein", "avg_tone"]
    return stored.select(*columns, F.lit("stored").alias("source")).unionByName(live.select(*columns, F.lit("live").alias("source")))


def hot_events(stored: DataFrame, events: DataFrame, prints: DataFrame, n: int = 5) -> DataFrame:
    """(SQLDATE, rank, GlobalEventID, fingerprint, fp_type) of each day's hot events.

    stored: (date, hot array of fingerprints). A stored list is resolved in its order; a day without one, or with none
    of it known, has its n events with the most articles, and those without a fingerprint a made-up one.
    """
    listed = stored.select(F.col("date").alias("day"), F.posexplode(F.slice("hot", 1, n)).alias("at", "fingerprint"))
    known = listed.join(prints.select("fingerprint", F.col("global_event_id").alias("GlobalEventID")), "fingerprint")
    order = Window.partitionBy("SQLDATE").orderBy("at")
    resolved = known.join(events.select("GlobalEventID", "SQLDATE"), "GlobalEventID").withColumn("rank", F.row_number().over(order))
    resolved = resolved.select("SQLDATE", "rank", "GlobalEventID", "fingerprint", F.lit("standard").alias("fp_type"))
    others = events.join(resolved.select("SQLDATE").distinct(), "SQLDATE", "left_anti")
    by_articles = Window.partitionBy("SQLDATE").orderBy(F.desc("NumArticles"), "GlobalEventID")
    best = others.select("SQLDATE", "GlobalEventID", F.row_number().over(by_articles).alias("rank")).where(F.col("rank") <= n)
    best = best.join(prints.select("fingerprint", F.col("global_event_id").alias("GlobalEventID")), "GlobalEventID", "left")
    made = F.concat_ws("-", F.lit("EVT"), F.col("SQLDATE").cast("string"), F.col("GlobalEventID").cast("string"))
    live = best.select("SQLDATE", "rank", "GlobalEventID", F.coalesce("fingerprint", made).alias("fingerprint"), F.when(F.col("fingerprint").isNull(), "temp").otherwise("standard").alias("fp_type"))
    return resolved.unionByName(live)


def reranked(storylines: DataFrame, scores: DataFrame) -> DataFrame:
    """storylines (seed_id, phase, GlobalEventID, SQLDATE) ranked again by score (seed_id, GlobalEventID, score).

    Of equal scores the later day goes first before the seed, the earlier one after it, and reactions go by id.
    """
    rows = storylines.join(scores.select("seed_id", "GlobalEventID", F.round("score", 3).alias("relevance")), ["seed_id", "GlobalEventID"])
    near = F.when(F.col("phase") == "preceding", -F.unix_date("SQLDATE")).when(F.col("phase") == "following", F.unix_date("SQLDATE")).otherwise(0)
    order = Window.partitionBy("seed_id", "phase").orderBy(F.desc("relevance"), near, "GlobalEventID")
    return rows.select("seed_id", "phase", "GlobalEventID", "relevance", F.row_number().over(order).alias("rank"))


def alias_terms(name: Column) -> Column:
    """The name in its normal form and all names that stand for it, sorted; none for an empty name."""
    by_name: dict[str, list[str]] = {}
    for alias, canonical in K.ACTOR_ALIASES.items():
        by_name.setdefault(canonical, []).append(alias)
    known = F.create_map(*(x for k, v in by_name.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    normal = S.actor_name(name)
    none = F.array().cast("array<string>")
    return F.when(normal == "", none).otherwise(F.array_sort(F.array_union(F.array(normal), F.coalesce(known[normal], none))))


def suffix_variants(name: Column) -> Column:
    """The name, its title case, and country names its ending suggests (Mexican: Mexica, Japanese: Japan), sorted."""
    ends = lambda x, least: F.upper(name).endswith(x) & (F.length(name) > least)
    cut = lambda n, more: F.concat(F.substring(name, F.lit(1), F.length(name) - n), F.lit(more))
    rules = [("AN", 4, 2, "a"), ("ISH", 5, 3, "ain"), ("ESE", 5, 3, ""), ("IAN", 5, 3, "a"), ("I", 3, 1, "")]
    found = [F.when(ends(x, least), cut(n, more)) for x, least, n, more in rules]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(name, F.initcap(F.lower(name)), *found))))


def fine_label(code: Column, labels: dict[str, str]) -> Column:
    """The label of an event code; a made-up one where there is none."""
    made = F.when(F.coalesce(code, F.lit("")) == "", "Unknown event").otherwise(F.concat(F.lit("Event type "), code))
    return S.lookup(code, labels, made) if labels else made


def series_key(region: Column, actor: Column, country_of: Column | None = None) -> Column:
    """The series that a request's filters mean: its actor's, its pair's of actors or countries, its country's, or the world's."""
    text = F.upper(F.trim(region))
    kind = F.when(text.rlike(r"^ACTOR[_ ]?PAIR:"), "actor").when(text.rlike(r"^COUNTRY[_ ]?PAIR:"), "country").otherwise("")
    rest = F.trim(F.regexp_replace(text, r"^(ACTOR|COUNTRY)[_ ]?PAIR:", ""))
    separator = F.when(F.contains(rest, F.lit("-")) & (F.length(rest) <= 15), "-")
    for x in (" AND ", " VS ", " VERSUS ", "/", ","):
        separator = F.coalesce(separator, F.when(F.contains(rest, F.lit(x)), F.lit(x)))
    at = F.position(separator, rest)
    left, right = F.trim(F.substring(rest, F.lit(1), at - 1)), F.trim(F.substring(rest, at + F.length(separator), F.length(rest)))
    a, b = S.actor_country(left), S.actor_country(right)
    x, y = S.filled(S.actor_name(left)), S.filled(S.actor_name(right))
    actors = F.when((kind != "country") & ~((kind == "") & a.isNotNull() & b.isNotNull()) & (x != y), F.concat(F.lit("actor_pair:"), F.least(x, y), F.lit(" :: "), F.greatest(x, y)))
    countries = F.when((kind != "actor") & (a != b), F.concat(F.lit("country_pair:"), F.least(a, b), F.lit("-"), F.greatest(a, b)))
    code = text if country_of is None else F.coalesce(country_of, text)
    country = F.when(F.length(code).between(2, 3), F.concat(F.lit("country:"), code))
    named = F.when(S.filled(actor).isNotNull(), F.concat(F.lit("actor:"), S.actor_name(actor)))
    return F.coalesce(named, F.when(S.filled(region).isNotNull(), F.coalesce(actors, countries, country)), F.lit("global:ALL"))


def source_distribution(mentions: DataFrame) -> DataFrame:
    """How many events have how many distinct sources."""
    each = mentions.groupBy("GLOBALEVENTID").agg(F.count_distinct("MentionSourceName").alias("sources"))
    return each.groupBy("sources").agg(F.count("*").alias("events"))


def distinct_by_day(events: DataFrame) -> DataFrame:
    """Distinct first actors, counted over (day, actor) pairs, which a rollup by day can keep."""
    return events.where("Actor1Name IS NOT NULL").select("SQLDATE", "Actor1Name").distinct().agg(F.count_distinct("Actor1Name").alias("unique_actors"))


def day_sketches(events: DataFrame, columns: list[str], bits: int = 14) -> DataFrame:
    """(SQLDATE, events, and for each column a sketch of its distinct values): what a daily summary keeps of them.

    A sketch has at most 2 ** bits registers whatever it counts; with 14 bits its standard error is 0.8 %, and a few
    hundred values are counted as they are. Nulls do not count.
    """
    return events.groupBy("SQLDATE").agg(F.count("*").alias("events"), *(F.hll_sketch_agg(c, bits).alias(c) for c in columns))


def distincts_over(sketches: DataFrame, period: Column, columns: list[str]) -> DataFrame:
    """(period, events, distinct values of each column) from the sketches of its days: no event is read again, and a value
    of several days counts once."""
    return sketches.groupBy(period.alias("period")).agg(F.sum("events").alias("events"), *(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns))


def odd_names(events: DataFrame) -> DataFrame:
    """Place names with characters outside printable ASCII, and how often they occur."""
    rows = events.where(F.col("ActionGeo_FullName").rlike("[^ -~]"))
    return rows.groupBy(F.col("ActionGeo_FullName").alias("name")).agg(F.count("*").alias("n"))


def guarded_range(rows: DataFrame, start: str, end: str, most_days: int, column: str = "event_day") -> DataFrame:
    """rows between two days; a range of over most_days is an error."""
    from datetime import date

    if (date.fromisoformat(end) - date.fromisoformat(start)).days + 1 > most_days:
        raise ValueError(f"at most {most_days} days at once, not {start} to {end}")
    return E.between_dates(rows, start, end, column)
