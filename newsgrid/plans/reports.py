"""Checks of reports. The reports are the last turns of conversations and texts of documents, with figures of events put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.operators import reports as P
from newsgrid.registry import query

#: Sentences by report number; the figures in braces come from the event of that id.
FORMS = [
    "Coverage rose toward the end of the month.",
    "We cannot say whether activity rose. Closures were due to storms.",
    "A total of {n} events. Protests increased by 12% in March.",
    "More than {low} articles, under {high} in all, for over 31 days.",
    "Three records on {day} each with {n} articles.",
    "One event on {day} was stable and small.",
    "Fewer events than before, and lower.",
    "The talks of {written} drew {n} people, and none met on February 30, 2024.",
    "One event between {day} and {next} drew between {low} and {high} articles each.",
]
#: What a plan's comparison computed for each form.
DIRECTIONS = ["increase", "flat", "increase", "no_data", "no_data", "flat", "decrease", "increase", "no_data"]
REPORTS = f"SELECT event_id AS doc_id, CAST(ts AS DATE) AS day, CAST(FLOOR(value) AS INT) AS articles, event_id % {len(FORMS)} AS form FROM events"
WINDOW = "BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"
SAID = f"SELECT doc_id, 'lower' AS bound, greatest(articles - 1, 1) AS v FROM ({REPORTS}) WHERE form = 3 UNION ALL SELECT doc_id, 'upper', articles * 2 FROM ({REPORTS}) WHERE form = 3"


def _reports(spark, sf_dir):
    spark_events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.sql(REPORTS.replace("events", "{events}"), events=spark_events)
    text = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("form") + 1).cast("int"))
    figures = {"n": F.col("articles"), "low": F.greatest(F.col("articles") - 1, F.lit(1)), "high": F.col("articles") * 2, "day": F.col("day"), "next": F.date_add("day", 1), "written": F.date_format("day", "MMMM d, yyyy")}
    for name, value in figures.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    steps = F.when(F.col("form") == 6, F.array(F.lit("top_events"), F.lit("compare_periods"))).otherwise(F.array(F.lit("top_events")))
    direction = F.element_at(F.array(*map(F.lit, DIRECTIONS)), (F.col("form") + 1).cast("int"))
    return rows.select("doc_id", text.alias("text"), steps.alias("steps"), direction.alias("direction"), "day", "articles")


@query("k09_causal_candidates", f"SELECT doc_id, CAST(1 AS INTEGER) AS n, 'Closures were due to storms.' AS sentence FROM ({REPORTS}) WHERE form = 1")
def _causal(spark, sf_dir):
    return P.causal_candidates(_reports(spark, sf_dir))


@query(
    "k10_dates_outside",
    f"""SELECT doc_id, CAST(day AS VARCHAR) AS raw, day FROM ({REPORTS}) WHERE form IN (4, 5, 8) AND NOT day {WINDOW}
UNION ALL SELECT doc_id, CAST(day + 1 AS VARCHAR), day + 1 FROM ({REPORTS}) WHERE form = 8 AND NOT day + 1 {WINDOW}
UNION ALL SELECT doc_id, lower(strftime(day, '%B %-d, %Y')), day FROM ({REPORTS}) WHERE form = 7 AND NOT day {WINDOW}
UNION ALL SELECT doc_id, 'february 30, 2024', NULL FROM ({REPORTS}) WHERE form = 7""",
)
def _dates(spark, sf_dir):
    return P.dates_outside(_reports(spark, sf_dir), "2024-01-05", "2024-01-20")


@query("k05_bounds", f"SELECT doc_id, bound, CAST(v AS DOUBLE) AS value FROM ({SAID})")
def _bounds(spark, sf_dir):
    return P.bounded_numbers(_reports(spark, sf_dir)).select("doc_id", "bound", "value")


@query(
    "k06_ungrounded_bounds",
    f"""WITH said AS ({SAID}), known AS (SELECT DISTINCT articles AS c FROM ({REPORTS}))
SELECT doc_id, bound, CAST(v AS DOUBLE) AS value FROM said WHERE NOT EXISTS (SELECT 1 FROM known WHERE CASE WHEN bound = 'lower' THEN c >= v AND c <= v * 1.1 ELSE c >= v * 0.9 AND c <= v END)""",
)
def _ungrounded(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    facts = reports.select(F.col("articles").cast("double").alias("value"))
    return P.ungrounded_bounds(P.bounded_numbers(reports), facts).select("doc_id", "bound", "value")


@query("k07_sample_as_total", f"SELECT doc_id, CAST(form = 2 AS BIGINT) AS totals, CAST(form = 2 AS BIGINT) AS trends FROM ({REPORTS})")
def _claims(spark, sf_dir):
    return P.claims(_reports(spark, sf_dir))


@query("k07_stated_trends", f"SELECT doc_id, CASE WHEN form = 0 THEN 'Coverage rose toward the end of the month.' ELSE 'Protests increased by 12% in March.' END AS sentence FROM ({REPORTS}) WHERE form IN (0, 2)")
def _trends(spark, sf_dir):
    return P.stated_trends(_reports(spark, sf_dir)).select("doc_id", "sentence")


@query("k11_count_overclaims", f"SELECT doc_id, 3 AS claimed, 1 AS available FROM ({REPORTS}) WHERE form = 4")
def _overclaims(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    return P.count_overclaims(reports, reports.select("doc_id", "day", "articles")).select("doc_id", "claimed", F.col("available").cast("int").alias("available"))


@query("k13_directions", f"SELECT doc_id, form NOT IN (1, 7) AS ok FROM ({REPORTS}) WHERE form NOT IN (3, 4, 8)")
def _directions(spark, sf_dir):
    return P.direction_stated(_reports(spark, sf_dir)).where("ok IS NOT NULL")


@query("k14_report_checks", f"SELECT doc_id, form IN (3, 5, 6, 8) AS pass, CAST(form = 1 AS BIGINT) AS causal_sentences FROM ({REPORTS})")
def _all(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    values = F.array("articles", F.greatest(F.col("articles") - 1, F.lit(1)), F.col("articles") * 2, F.lit(12), F.lit(31))
    facts = reports.select(F.explode(values.cast("array<double>")).alias("value"))
    checked = P.report_checks(reports, facts, reports.select("doc_id", "day", "articles"), "2023-01-01", "2025-12-31")
    return checked.select("doc_id", "pass", "causal_sentences")
