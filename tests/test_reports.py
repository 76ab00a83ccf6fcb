"""Checks of reports on sentences of their own: bounds, written and impossible dates, ranges, causes, and whole reports."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from newsgrid.operators import reports as P


def docs(spark, *texts, steps=("top_events",), direction=None):
    return spark.createDataFrame([(i, t, list(steps), direction) for i, t in enumerate(texts)], "doc_id long, text string, steps array<string>, direction string")


def test_numbers_and_their_bounds(spark):
    texts = ["Above 40 reports, 63,000-plus readers, 7+ towns, up to 9 days, no more than 15% of 2,500.5 in 2024.", "On 2024-01-05, March 3-5, 2024 and 14 June it was 88.", None, "x1 and 3rd, over 31 days, beyond 5 or more"]
    got = [(r.doc_id, r.raw, r.bound) for r in P.stated_numbers(docs(spark, *texts)).orderBy("doc_id", "position").collect()]
    assert got == [(0, "40", "lower"), (0, "63,000", "lower"), (0, "7", "lower"), (0, "9", None), (0, "15%", "upper"), (0, "2,500.5", None), (1, "88", None), (3, "31", None), (3, "5", "lower")]


def test_grounded_numbers(spark):
    facts = spark.createDataFrame([(20942.0,), (480.0,), (0.301,)], "value double")
    texts = ["More than 20,000 articles.", "20,000 articles.", "More than 25,000 articles.", "Under 500 calls, 30.1% of them late.", "Under 700 calls.", "Over 480 calls.", "Only 9 of them."]
    assert sorted(r.doc_id for r in P.ungrounded(P.stated_numbers(docs(spark, *texts)), facts).collect()) == [1, 2, 4]


def test_dates_in_and_outside_a_window(spark):
    texts = ["It was January 6, 2020.", "It was January 6.", "On Jan. 9-12, 2024 and 6 January 2024.", "February 30, 2024 never came, nor did 2024-13-01.", "May 5 may pass, March 2024 too.", None, "31 June 2024, December 31st, 2023"]
    got = sorted((r.doc_id, r.raw, r.day and r.day.isoformat()) for r in P.dates_outside(docs(spark, *texts), "2024-01-05", "2024-01-10").collect())
    assert got == [
        (0, "january 6, 2020", "2020-01-06"),
        (2, "jan. 9-12, 2024", "2024-01-12"),
        (3, "2024-13-01", None),
        (3, "february 30, 2024", None),
        (4, "may 5", "2024-05-05"),
        (6, "31 june 2024", None),
        (6, "december 31st, 2023", "2023-12-31"),
    ]


SHOWN = [(0, date(2024, 1, 2), 5), (0, date(2024, 1, 3), 70), (0, date(2024, 1, 4), 70), (0, date(2024, 2, 9), 8)]


@pytest.mark.parametrize(
    "text, over",
    [
        ("Three records each with 70 articles.", (3, 2)),
        ("Two records each with 70 articles.", None),
        ("Four events between January 2 and January 4 stand out.", (4, 3)),
        ("Three events between January 2 and January 4 stand out.", None),
        ("Three events on January 2 and January 4 stand out.", (3, 2)),
        ("Three events from 2024-01-02 to 2024-01-04 stand out.", None),
        ("Three entries had between 5 and 8 articles each.", (3, 2)),
        ("Two further entries, each with 5 to 8 articles.", None),
        ("The top ten events on 2024-01-02 matter.", None),
        ("Two events (2024-01-02) stand out.", None),
        ("12 events on 2024-01-02 stand out.", None),
        ("13 events on 2024-01-02 stand out.", (13, 1)),
        ("Several events on 2024-01-02.", None),
    ],
)
def test_claimed_records(spark, text, over):
    facts = spark.createDataFrame([(12.0,)], "value double")
    got = P.count_overclaims(docs(spark, text), spark.createDataFrame(SHOWN, "doc_id long, day date, articles int"), facts).collect()
    assert [(r.claimed, r.available) for r in got] == ([over] if over else [])


def test_nothing_shown_is_not_judged(spark):
    none = spark.createDataFrame([], "doc_id long, day date, articles int")
    assert P.count_overclaims(docs(spark, "Three records on 2024-01-02."), none).count() == 0


def test_totals_trends_and_causes(spark):
    texts = ["Altogether 45 events were seen. Nothing else.", "There were 30 incidents.", "Attacks climbed by 8%. Calls dropped 3%.", "A total picture.", None]
    got = {r.doc_id: (r.totals, r.trends) for r in P.claims(docs(spark, *texts)).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 0), 4: (0, 0)}
    assert {(r.totals, r.trends) for r in P.claims(docs(spark, *texts, steps=("top_events", "daily_brief"))).collect()} == {(0, 0)}
    texts = ["Tensions eased in spring.", "It is unclear whether protests grew.", "The events fell on a Monday.", "Easter events drew crowds.", "Prices rose."]
    assert sorted(r.doc_id for r in P.stated_trends(docs(spark, *texts)).collect()) == [0]
    texts = ["Roads closed because of snow.", "The data cannot show what led to it.", "The raid suggests a feud, though the data does not confirm it.", "All was calm."]
    assert sorted(r.doc_id for r in P.causal_candidates(docs(spark, *texts)).collect()) == [0, 2]


@pytest.mark.parametrize("direction, yes, no", [("increase", "More calls came.", "Nothing new."), ("decrease", "Calls declined.", "Calls grew."), ("flat", "About the same as before.", "Calls grew."), ("inconclusive_low_volume", "Too few to tell.", "Calls grew.")])
def test_directions(spark, direction, yes, no):
    assert [r.ok for r in P.direction_stated(docs(spark, yes, no, direction=direction)).orderBy("doc_id").collect()] == [True, False]
    assert [r.ok for r in P.direction_stated(docs(spark, yes, direction="no_data")).collect()] == [None]


def test_whole_reports(spark):
    texts = ["More than 20,000 articles.", "20,000 articles.", "It was on May 5, 2031.", "Roads closed because of snow.", None]
    facts = spark.createDataFrame([(20942.0,)], "value double")
    shown = spark.createDataFrame(SHOWN, "doc_id long, day date, articles int")
    got = {r.doc_id: (r["pass"], r.causal_sentences) for r in P.report_checks(docs(spark, *texts), facts, shown, "2024-01-01", "2024-12-31").collect()}
    assert got == {0: (True, 0), 1: (False, 0), 2: (False, 0), 3: (True, 1), 4: (True, 0)}
    other = P.report_checks(docs(spark, texts[2], steps=("similar_events",)), facts, shown, "2024-01-01", "2024-12-31")
    assert [r["pass"] for r in other.select(F.col("pass")).collect()] == [True]
