"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsgrid.functions import constants as K


def lookup(column: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """The table's value for column, else default (null if not given)."""
    found = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[column]
    return found if default is None else F.coalesce(found, default)


def mean(column: Column, digits: int = 1) -> Column:
    """Average of values that have `digits` decimals: summed as whole numbers, so it does not depend on the order of rows."""
    return F.try_divide(F.sum(F.round(column * 10**digits).cast("long")), F.count(column) * F.lit(10.0**digits))


def share(condition: Column) -> Column:
    """Rows that meet condition, as a count."""
    return F.sum(F.when(condition, 1).otherwise(0))


def filled(column: Column) -> Column:
    """null for empty strings."""
    return F.nullif(column, F.lit(""))


def conflict(bar: float = K.SEARCH_BAR) -> Column:
    return F.col("GoldsteinScale") < -bar


def cooperation(bar: float = K.SEARCH_BAR) -> Column:
    return F.col("GoldsteinScale") > bar


def protest() -> Column:
    return F.col("EventRootCode") == K.PROTEST_ROOT


def location_code(place: Column) -> Column:
    """First three ASCII letters of the place's first part, in upper case; UNK if there are none."""
    letters = F.regexp_replace(F.upper(F.substring_index(place, ",", 1)), "[^A-Z]", "")
    return F.coalesce(filled(F.substring(letters, 1, 3)), F.lit("UNK"))


def url_words(url: Column) -> Column:
    """Words of a URL without scheme and host."""
    path = F.regexp_replace(F.coalesce(url, F.lit("")), "(?i)^https?://[^/]+", "")
    return F.trim(F.regexp_replace(F.lower(path), "[^a-z0-9]+", " "))


def severity(goldstein: Column, articles: Column) -> Column:
    """Twice the absolute score between 1 and 10, one more for over 100 articles, 10 at most."""
    score = F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.abs(F.coalesce(goldstein, F.lit(0.0))) * 2))
    return F.least(F.lit(10.0), score + F.when(F.coalesce(articles, F.lit(0)) > 100, 1.0).otherwise(0.0))


def _root(i: int) -> Column:
    return lookup(F.substring(F.coalesce(F.col("EventRootCode"), F.lit("")), 1, 2), {k: v[i] for k, v in K.ROOTS.items()}, F.lit(K.DEFAULT_ROOT[i]))


def fingerprint() -> Column:
    """country-yyyymmdd-PLC-TOKEN-id."""
    country = F.coalesce(filled(F.col("ActionGeo_CountryCode")), F.lit("XX"))
    return F.concat_ws("-", country, F.date_format("SQLDATE", "yyyyMMdd"), location_code(F.coalesce("ActionGeo_FullName", F.lit(""))), _root(0), F.col("GlobalEventID").cast("string"))


def headline() -> Column:
    a1, a2, place = (filled(F.col(c)) for c in ("Actor1Name", "Actor2Name", "ActionGeo_FullName"))
    object_ = F.when(a2.isNull(), "").when(_root(3) == "", F.concat(F.lit(" "), a2)).otherwise(F.concat(F.lit(" "), _root(3), F.lit(" "), a2))
    at = F.when(place.isNull(), "").otherwise(F.concat(F.lit(" ("), place, F.lit(")")))
    return F.left(F.concat(F.coalesce(a1, F.lit(K.UNKNOWN_ACTOR)), F.lit(" "), _root(2), object_, at), F.lit(255))


def summary() -> Column:
    a1, a2, place = (filled(F.col(c)) for c in ("Actor1Name", "Actor2Name", "ActionGeo_FullName"))
    actors = F.coalesce(filled(F.concat_ws(", ", a1, a2)), F.lit("unidentified actors"))
    at = F.when(place.isNull(), "").otherwise(F.concat(F.lit(" in "), place))
    score = F.format_string("%.1f", F.coalesce("GoldsteinScale", F.lit(0.0)))
    articles = F.coalesce("NumArticles", F.lit(0)).cast("string")
    return F.concat(_root(1), F.lit(" involving "), actors, at, F.lit(", Goldstein "), score, F.lit(", "), articles, F.lit(" articles."))


def key_actors() -> Column:
    return F.array_compact(F.array(filled(F.col("Actor1Name")), filled(F.col("Actor2Name"))))


def type_label() -> Column:
    return _root(1)


def daily_type() -> Column:
    return lookup(F.coalesce("EventRootCode", F.lit("")), K.DAILY_TYPES, F.lit("other"))


def division(place: Column) -> Column:
    """First-level division: the last part but one, with damaged names mended; null without a comma."""
    raw = F.trim(F.substring_index(F.substring_index(place, ",", -2), ",", 1))
    return F.when(F.instr(place, ",") > 0, lookup(raw, K.DAMAGED_DIVISIONS, raw))


def fold(text: Column) -> Column:
    """Upper case without Latin accents, as a key."""
    accented = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
    plain = "AAAAAAEEEEIIIIOOOOOUUUUNCY"
    return F.trim(F.translate(F.upper(text), accented, plain))


def actor_name(name: Column) -> Column:
    """Upper case, single blanks, aliases resolved; empty for null."""
    clean = F.regexp_replace(F.upper(F.trim(F.coalesce(name, F.lit("")))), r"\s+", " ")
    clean = F.replace(clean, F.lit("UNITED STATES GOVERNMENT"), F.lit("UNITED STATES"))
    return lookup(clean, K.ACTOR_ALIASES, clean)


def actor_country(name: Column) -> Column:
    return lookup(F.upper(F.trim(name)), K.ACTOR_COUNTRIES)


def plain_text(text: Column) -> Column:
    """Without control characters and bars; N/A for null."""
    clean = F.trim(F.translate(F.regexp_replace(text, r"[\r\n\t]+", " "), "|", " "))
    return F.coalesce(F.regexp_replace(clean, r"\p{C}", ""), F.lit("N/A"))


def intensity(score: Column) -> Column:
    """Level of an absolute score: over 7, 5 and 3."""
    return F.when(F.abs(score) > 7, "critical").when(F.abs(score) > 5, "high").when(F.abs(score) > 3, "medium").otherwise("low")


def keyword_terms(text: Column, most: int = 5) -> Column:
    """Topic words: at least three letters or digits, no filler, each once, the first `most`."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    topical = F.filter(F.array_except(words, F.array(*(F.lit(w) for w in K.FILLER_WORDS))), lambda w: F.length(w) >= 3)
    return F.slice(F.array_distinct(topical), 1, most)


def kilometres(lat1: Column, long1: Column, lat2: Column, long2: Column) -> Column:
    """Great-circle distance on a sphere of 6,370.986 km."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(long2 - long1) / 2), 2)
    return F.lit(2 * 6370.986) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
