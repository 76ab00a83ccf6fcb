"""Checks of written reports against the data: numbers and bounds, dates, totals, trends, record counts, directions, causes.

Texts become sentences, sentences become words, and each check is a rule over words: what a word is, what stands before
and after it, and which words of a list a sentence holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrid.functions import constants as K
from newsgrid.operators import texts as X

#: Steps that show some events, and steps that count all of them.
SAMPLE_STEPS = ["events", "top_events", "hot_events", "similar_events"]
COUNT_STEPS = ["compare_periods", "daily_brief", "regional_overview"]
#: Steps after which other dates than those of the plan are in place.
OPEN_STEPS = ["event_detail", "similar_events"]

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Words before a number that make it a bound from below or above, and words after it that do.
AT_LEAST = ["more than", "over", "above", "at least", "no fewer than", "beyond", "upwards of", "in excess of"]
AT_MOST = ["fewer than", "less than", "under", "below", "at most", "no more than", "up to"]
OR_MORE = [r"\+", "- ?plus", "plus", "or more"]
SPANS = ["second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade"]
#: Beginnings of words.
RISES = ["increas", "rose$", "rise", "rising", "grew$", "grow", "climb", "surg", "spik", "jump", "soar", "escalat", "intensif", "mount(?:ed|ing)$"]
FALLS = ["decreas", "fell$", "fall(?:s|ing|en)?$", "drop", "declin", "shrank$", "shrink", "wan(?:ed|ing)$", "taper", "plung", "subsid", "eas(?:ed|ing)$"]
MORE_OF = ["higher", "more", "up", "upward"]
LESS_OF = ["lower", "fewer", "less", "down", "downward"]
EVEN = ["flat", "steady", "stable", "unchanged", "level"]
TOO_LITTLE = ["insufficient", "cannot", "can't", "inconclusive"]
SUBJECTS = ["activit", "coverage", "protest", "event", "report", "attention", "incident", "tension", "volume", "interest", "violence"]
RECORDS = ["records?", "events?", "entr(?:y|ies)", "incidents?"]
TOTALS = ["total", "totaled", "totalled", "totaling", "totalling", "altogether", "overall"]
#: Words that take a sentence's claim back, or say what data cannot tell.
HEDGES = ["whether", "cannot", "can't", "couldn't", "unclear", "impossible", "unable", "unknown", "doesn't", "don't", "didn't", "not"]
CAUSES = ["because", "due to", "caused by", "led to", "leading to", "resulted in", "as a result of", "driven by", "triggered by", "sparked by", "in response to", "in retaliation for", "stems from", "motivated by", "suggests", "suggesting", "reflects", "reflecting"]
#: Words before a count that make it the size of a list, not a claim about records.
LIST_SIZES = ["the", "these", "those", "of", "top", "first", "last", "all", "only", "its", "their"]

_ISO = r"\d{4}-\d{2}-\d{2}"
_NUMBER = r"\d[\d,]*(?:\.\d+)?%?"
#: A word may hold digits; a number that runs into letters is a word, too.
_TOKEN = rf"{_ISO}|[a-z_]\w*(?:['’-][a-z]\w*)*|\d+[a-z]\w*|{_NUMBER}|[-–+()]"


def _any(options: list[str]) -> str:
    return "(?:" + "|".join(options) + ")"


def tokens(text: Column) -> Column:
    """Words, numbers, ISO dates, dashes, plus signs and parentheses, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), 0)


def _begins(words: Column, stems: list[str]) -> Column:
    """Whether any of the words begins with one of the stems."""
    return F.exists(words, lambda w: w.rlike("^" + _any(stems)))


def _holds(words: Column, phrases: list[str]) -> Column:
    """Whether the words hold one of the phrases."""
    return F.array_join(words, " ").rlike("(^| )" + _any(phrases) + "( |$)")


_MONTH = _any([m if m == "may" else f"{m[:3]}(?:{m[3:]})?" for m in MONTHS])


def stated_numbers(docs: DataFrame) -> DataFrame:
    """(doc_id, position, raw, value, is_percent, bound): numbers of each text that are no part of a date and no year.

    bound is lower or upper where the words around say so (over 400, 63,000-plus, at most 5), but not for spans of time.
    """
    each = F.transform("tokens", lambda x, i: F.struct(i.alias("position"), x.alias("raw"), F.array_join(F.slice("tokens", F.greatest(F.lit(1), i - 2), F.least(i, F.lit(3))), " ").alias("before"), F.array_join(F.slice("tokens", i + 2, 3), " ").alias("after")))
    rows = docs.select("doc_id", tokens(F.col("text")).alias("tokens")).select("doc_id", F.inline(F.filter(each, lambda x: x["raw"].rlike(f"^{_NUMBER}$"))))
    before, after, raw = F.col("before"), F.col("after"), F.col("raw")
    in_date = before.rlike(rf"(^| ){_MONTH}( \d+(st|nd|rd|th)? [-–])?$") | (raw.rlike(r"^\d{1,2}$") & after.rlike(rf"^{_MONTH}( |$)"))
    year = raw.rlike(r"^(19|20)\d{2}$")
    span = after.rlike(f"^{_any(SPANS)}s?( |$)")
    lower = before.rlike(f"(^| ){_any(AT_LEAST)}$") | after.rlike(f"^{_any(OR_MORE)}( |$)")
    upper = before.rlike(f"(^| ){_any(AT_MOST)}$")
    value = F.replace(F.replace(raw, F.lit("%"), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    rows = rows.where(~in_date & ~year).withColumns({"value": value, "is_percent": raw.endswith("%"), "bound": F.when(~span, F.when(upper, "upper").when(lower, "lower"))})
    return rows.where("value IS NOT NULL").drop("before", "after")


def bounded_numbers(docs: DataFrame) -> DataFrame:
    """The rows of stated_numbers that are bounds."""
    return stated_numbers(docs).where("bound IS NOT NULL")


def ungrounded_bounds(stated: DataFrame, facts: DataFrame, slack: float = 0.1) -> DataFrame:
    """Rows of stated (doc_id, raw, value, bound) with no fact (value) on the stated side within slack of the bound.

    Both sides meet on rounded logarithms, a fact on its own bucket and its neighbours: an anti join by equality.
    """
    size = lambda v: F.floor(F.log1p(F.abs(v)) * 5)
    known = facts.select(F.abs("value").alias("c")).distinct()
    known = known.withColumn("bucket", F.explode(F.array(size(F.col("c")) - 1, size(F.col("c")), size(F.col("c")) + 1)))
    at = stated.withColumn("at", size(F.col("value")))
    v, c = F.abs(at["value"]), known["c"]
    good = F.when(at["bound"] == "lower", (c >= v) & (c <= v * (1 + slack))).otherwise((c >= v * (1 - slack)) & (c <= v))
    return at.join(known, (at["at"] == known["bucket"]) & good, "left_anti").drop("at")


def ungrounded(stated: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of stated_numbers that no fact (value) bears out: as they stand, or as the bound they are stated as."""
    far = X.ungrounded(stated, facts)
    return far.where("bound IS NULL").unionByName(ungrounded_bounds(far.where("bound IS NOT NULL"), facts))


def written_dates(text: Column, year: Column) -> Column:
    """Structs (raw, day) of the dates of a text: 2024-01-06, January 6, 2024, Jan. 6-8 and 6 January; year stands in where
    none is written. day is null for dates that no calendar has."""
    name = _any([m if m == "may" else f"{m[:3]}(?:{m[3:]}|\\.)?" for m in MONTHS])
    first = rf"\b{name}\s+\d{{1,2}}(?!\d)(?:st|nd|rd|th)?(?:\s*[-–]\s*\d{{1,2}}(?!\d))?(?:,?\s+\d{{4}}\b)?"
    last = rf"\b\d{{1,2}}\s+{name}(?![a-z])(?:\s+\d{{4}}\b)?"
    low = F.lower(F.coalesce(text, F.lit("")))
    number = F.create_map(*(x for i, m in enumerate(MONTHS) for x in (F.lit(m[:3]), F.lit(f"{i + 1:02d}"))))

    def days(raw: Column) -> Column:
        own_year = F.coalesce(F.nullif(F.regexp_extract(raw, r"(\d{4})$", 1), F.lit("")), year.cast("string"))
        month = number[F.regexp_extract(raw, "([a-z]{3})", 1)]
        each = F.regexp_extract_all(F.regexp_replace(raw, r"\d{4}$", ""), F.lit(r"\d{1,2}"), 0)
        return F.transform(each, lambda d: F.struct(raw.alias("raw"), F.try_to_date(F.concat_ws("-", own_year, month, F.lpad(d, 2, "0")), "yyyy-MM-dd").alias("day")))

    iso = F.transform(F.regexp_extract_all(low, F.lit(rf"\b{_ISO}\b"), 0), lambda d: F.struct(d.alias("raw"), F.try_to_date(d, "yyyy-MM-dd").alias("day")))
    # a month that has its day after it is not read again with a number before it
    by_month = F.regexp_extract_all(low, F.lit(first), 0)
    by_day = F.regexp_extract_all(F.regexp_replace(low, first, " ; "), F.lit(last), 0)
    return F.concat(iso, F.flatten(F.transform(by_day, days)), F.flatten(F.transform(by_month, days)))


def dates_outside(docs: DataFrame, start: str, end: str) -> DataFrame:
    """(doc_id, raw, day) of the written dates of each text outside start to end; impossible ones (day null) are outside, too.
    A date without a year is one of start's year."""
    each = F.inline(F.array_distinct(written_dates(F.col("text"), F.lit(start[:4]))))
    rows = docs.select("doc_id", each)
    return rows.where(F.col("day").isNull() | ~F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _steps() -> Column:
    return F.coalesce("steps", F.array().cast("array<string>"))


def _some_of(names: list[str]) -> Column:
    return F.arrays_overlap(_steps(), F.array(*map(F.lit, names)))


def claims(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, steps array<string>) with totals and trends: how many sentences state a total, and a change in
    percent, although the steps only took a sample and counted nothing."""
    words = tokens(F.col("sentence"))
    number = F.exists(words, lambda w: w.rlike(f"^{_NUMBER}$"))
    there = _holds(words, [f"(?:there|which) were {_NUMBER}"]) & _holds(words, RECORDS)
    total = number & (F.arrays_overlap(words, F.array(*map(F.lit, TOTALS))) | there)
    trend = F.exists(words, lambda w: w.endswith("%")) & _begins(words, RISES + FALLS)
    sampled = docs.where(_some_of(SAMPLE_STEPS) & ~_some_of(COUNT_STEPS))
    found = X.sentences(sampled).groupBy("doc_id").agg(F.count_if(total).alias("totals"), F.count_if(trend).alias("trends"))
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("totals", F.lit(0)).alias("totals"), F.coalesce("trends", F.lit(0)).alias("trends"))


def stated_trends(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sentence) that claim change over time from steps that only took a sample and compared no periods;
    hedged or negated sentences are none, nor is what fell on a day."""
    rows = X.sentences(docs.where(_some_of(SAMPLE_STEPS) & ~F.array_contains(_steps(), "compare_periods")))
    words = tokens(F.col("sentence"))
    plain = F.split(F.replace(F.array_join(words, " "), F.lit("fell on"), F.lit("")), " ")
    return rows.where(_begins(plain, RISES + FALLS) & _begins(words, SUBJECTS) & ~F.arrays_overlap(words, F.array(*map(F.lit, HEDGES))))


def causal_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sentence) that may state a cause: one of its words stands before anything that says what the data cannot
    tell, so that a limit after a claim does not take it back. For a judge, not for pass or fail."""
    said = F.array_join(tokens(F.col("sentence")), " ")
    limits = rf"\b(?:data|records?|coverage|sources?|we)\b[^;]{{0,30}}\b(?:cannot|can't|(?:do|does|did|can) not|don't|doesn't|didn't)\b.*"
    return X.sentences(docs).where(F.regexp_replace(said, limits, "").rlike("(^| )" + _any(CAUSES) + "( |$)"))


def record_claims(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sentence, claimed, quoted, days, articles): sentences that say a number of records, in words or digits,
    and name dates or an article count of each. days and articles are ranges (low, high): one date or count, or two that
    stand between ... and ... or on the two sides of to. What stands in parentheses belongs to neither.

    Sentences without a digit or without any of the words for records are left out first: they have no date or count of
    each, or no claim. Dates and counts of each are looked for in sentences that hold a claim only."""
    count = rf"(?:{'|'.join(K.COUNT_WORDS)}|\d{{1,2}})"
    masked = F.regexp_replace(F.lower(F.regexp_replace("sentence", rf"(?i)\b{_ISO}\b|\b{_MONTH}\.?\s+\d{{1,2}}(?!\d)(?:st|nd|rd|th)?|\b\d{{1,2}}\s+{_MONTH}\b", "#")), r"[^a-z0-9#%/.-]+", " ")
    said = F.regexp_extract_all(masked, F.lit(rf"(?<![\d/.#-])(?:\b([a-z]+) )?(?<![\w.-]){count} (?:of the )?(?:[a-z-]+ ){{0,2}}?{_any(RECORDS)}\b"), 0)
    claim = F.transform(said, lambda x: F.struct(F.regexp_extract(x, rf"^([a-z]+) {count}\b", 1).alias("before"), F.regexp_extract(x, rf"(?:^|^[a-z]+ )({count})\b", 1).alias("count")))
    claim = F.filter(claim, lambda x: ~x["before"].isin(LIST_SIZES))
    words = F.create_map(*(x for i, k in enumerate(K.COUNT_WORDS) for x in (F.lit(k), F.lit(i))))
    counts = F.transform(claim, lambda x: F.struct(F.coalesce(words[x["count"]], x["count"].try_cast("int")).alias("n"), x["count"].rlike("^[0-9]").alias("digits"), F.col("sentence").alias("sentence")))

    outside = F.col("outside")
    dated = F.array_sort(F.array_distinct(F.filter(F.transform(written_dates(outside, F.year("year")), lambda x: x["day"]), lambda d: d.isNotNull())))
    # a date's own hyphens are no range
    ranged = F.regexp_replace(outside, rf"{_ISO}|{_MONTH}\.?\s+\d{{1,2}}(?!\d)|\b\d{{1,2}}\s+{_MONTH}", "#").rlike(r"between[^#]*#[^#]{0,8}\band\b[^#]*#|#[^#]{0,8}(?:\bto\b|\bthrough\b|–)[^#]*#|#\s*[-–]\s*\d{1,2}\b")
    span = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    days = F.when(ranged & (F.size("dated") > 1), F.array(span(F.array_min("dated"), F.array_max("dated")))).otherwise(F.transform("dated", lambda d: span(d, d)))
    number = lambda x: F.replace(x, F.lit(","), F.lit("")).cast("int")
    each = F.concat(
        F.regexp_extract_all(outside, F.lit(r"\beach\s+(?:[a-z]+\s+){0,2}?((?:between\s+)?\d[\d,]*(?:\s+(?:and|to|or)\s+\d[\d,]*)?)\s+articles"), 1),
        F.regexp_extract_all(outside, F.lit(r"\b((?:between\s+)?\d[\d,]*(?:\s+(?:and|to|or)\s+\d[\d,]*)?)\s+articles\s+each\b"), 1),
    )

    def ranges(x: Column) -> Column:
        both = F.transform(F.regexp_extract_all(x, F.lit(r"\d[\d,]*"), 0), number)
        return F.when(x.rlike("between| to "), F.array(span(F.array_min(both), F.array_max(both)))).otherwise(F.transform(both, lambda n: span(n, n)))

    able = F.col("sentence").rlike("[0-9]") & F.lower("sentence").rlike("record|event|entr|incident")
    # each claim carries its sentence: Catalyst would take what is asked of the sentence itself to those without a claim
    rows = X.sentences(docs).where(able).select("doc_id", "n", F.explode(counts).alias("c")).select("doc_id", "n", "c.sentence", F.col("c.n").alias("claimed"), F.col("c.digits").alias("digits"))
    # and these are worked out once: a condition on them would be asked of the sentence again
    once = lambda df, **made: df.select("*", F.explode(F.array(F.struct(*(c.alias(name) for name, c in made.items())))).alias("made")).select(*df.columns, "made.*")
    rows = once(rows.withColumn("year", F.lit("2024-01-01").cast("date")), outside=F.lower(F.regexp_replace("sentence", r"\([^()]*\)", " ")))
    rows = once(rows, dated=dated, each=each).where("claimed IS NOT NULL AND (size(dated) > 0 OR size(each) > 0)")
    return rows.select("doc_id", "n", "sentence", "claimed", "digits", days.alias("days"), F.flatten(F.transform("each", ranges)).alias("articles"))


def count_overclaims(docs: DataFrame, shown: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(doc_id, n, sentence, claimed, available): sentences of record_claims that name more records than shown (doc_id, day,
    articles) has in their ranges; of several claims of a sentence the largest. Documents of which nothing is shown are not
    judged, and a count in digits that is a fact (value) quotes it. Equality joins by document and value, then a count."""
    said = record_claims(docs)
    if facts is not None:
        quotes = facts.select(F.col("value").cast("int").alias("claimed"), F.lit(True).alias("digits")).where(F.col("value") == F.floor("value")).distinct()
        said = said.join(quotes, ["claimed", "digits"], "left_anti")
    rows = said.join(shown.select("doc_id", F.col("day").alias("shown_day"), F.col("articles").alias("shown_articles")), "doc_id")
    inside = lambda ranges, x: (F.size(ranges) == 0) | F.coalesce(F.exists(ranges, lambda r: (r["low"] <= F.col(x)) & (F.col(x) <= r["high"])), F.lit(False))
    counted = rows.groupBy("doc_id", "n", "sentence", "claimed").agg(F.count_if(inside("days", "shown_day") & inside("articles", "shown_articles")).alias("available"))
    over = counted.where(F.col("claimed") > F.col("available"))
    return over.groupBy("doc_id", "n", "sentence").agg(F.max(F.struct("claimed", "available")).alias("most")).select("doc_id", "n", "sentence", "most.*")


def direction_stated(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, direction) with ok: whether the text has a word for the computed direction; null where there is
    no comparison or no word to ask for."""
    words, direction = tokens(F.col("text")), F.col("direction")
    has = lambda stems, whole: _begins(words, stems) | _holds(words, whole)
    ok = F.when(direction == "increase", has(RISES, MORE_OF)).when(direction == "decrease", has(FALLS, LESS_OF))
    ok = ok.when(direction == "flat", _holds(words, [*EVEN, "little change", "(?:about|roughly) (?:the )?same"]))
    ok = ok.when(direction == "inconclusive_low_volume", _holds(words, [*TOO_LITTLE, "too few", "not enough", "low volume", "small number"]))
    return docs.select("doc_id", ok.alias("ok"))


def report_checks(docs: DataFrame, facts: DataFrame, shown: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each report (doc_id, text, steps, direction): findings of each check, and whether it passes them all.

    Causal sentences are counted but left to a judge; dates are not judged after steps that show other dates.
    """

    def found(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.count("*").alias(name))

    parts = {
        "ungrounded_numbers": ungrounded(stated_numbers(docs), facts),
        "stated_trends": stated_trends(docs),
        "dates_outside": dates_outside(docs.where(~_some_of(OPEN_STEPS)), start, end),
        "count_overclaims": count_overclaims(docs, shown, facts),
        "causal_sentences": causal_candidates(docs),
    }
    out = claims(docs).select("doc_id", (F.col("totals") + F.col("trends")).alias("sample_as_total")).join(direction_stated(docs).withColumnRenamed("ok", "direction_ok"), "doc_id")
    for name, rows in parts.items():
        out = out.join(found(rows, name), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    judged = ["sample_as_total", *(name for name in parts if name != "causal_sentences")]
    clean = F.coalesce("direction_ok", F.lit(True))
    for name in judged:
        clean = clean & (F.col(name) == 0)
    return out.select("doc_id", *judged, "causal_sentences", "direction_ok", clean.alias("pass"))
