"""Text templates, names and comparisons with known results."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from newsgrid.functions import scalars as S
from newsgrid.operators import analysis as A
from newsgrid.operators import events as E

EVENT = "GlobalEventID long, SQLDATE date, Actor1Name string, Actor2Name string, EventCode string, EventRootCode string, GoldsteinScale double, NumArticles int, ActionGeo_FullName string, ActionGeo_CountryCode string, SOURCEURL string"


def test_fingerprints(spark):
    rows = [
        (1150442224, date(2024, 1, 9), "AUTHORITIES", None, "020", "02", 3.0, 5, "Fort Worth, Texas, United States", "US", "https://example.org/News/Fort-Worth_1.html"),
        (2, date(2024, 1, 9), "", "POLICE", "130", "13", -4.26, 101, "", "", None),
        (3, date(2024, 1, 9), "A", "B", "999", "99", None, None, "Montréal, Quebec, Canada", "CA", "x"),
    ]
    got = {r.global_event_id: r for r in E.fingerprints(spark.createDataFrame(rows, EVENT)).collect()}
    a, b, c = got[1150442224], got[2], got[3]
    assert (a.fingerprint, a.headline) == ("US-20240109-FOR-APPEAL-1150442224", "AUTHORITIES appeals (Fort Worth, Texas, United States)")
    assert a.summary == "Appeal involving AUTHORITIES in Fort Worth, Texas, United States, Goldstein 3.0, 5 articles." and a.source_text == "news fort worth 1 html"
    assert (b.fingerprint, b.headline, b.severity_score, b.key_actors) == ("XX-20240109-UNK-THREATEN-2", "Unidentified actor threatens POLICE", 9.52, ["POLICE"])
    assert (c.fingerprint, c.headline, c.severity_score, c.event_type_label) == ("CA-20240109-MON-EVENT-3", "A interacts with B (Montréal, Quebec, Canada)", 1.0, "Other event")


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "code"), [("St. Louis, Missouri, United States", "STL"), ("", "UNK"), ("12, 3", "UNK")])
def test_location_codes(spark, text, code):
    assert one(spark, S.location_code(F.col("t")), t=text) == code


def test_names(spark):
    assert one(spark, S.fold(F.col("t")), t="Querétaro ") == "QUERETARO"
    assert one(spark, S.division(F.col("t")), t="Mérida, YucatáMX, Mexico") == "Yucatán"
    assert one(spark, S.division(F.col("t")), t="Mexico") is None
    assert one(spark, S.actor_name(F.col("t")), t=" united  states government ") == "UNITED STATES"
    assert one(spark, S.actor_name(F.col("t")), t="u.s.") == "UNITED STATES"
    assert one(spark, S.keyword_terms(F.col("t")), t="find news articles about the Uvalde school shooting response") == ["uvalde", "school", "shooting", "response"]


def test_distance(spark):
    assert one(spark, S.kilometres(F.lit(40.7128), F.lit(-74.006), F.lit(51.5074), F.lit(-0.1278)), t="") == pytest.approx(5570, abs=5)


@pytest.mark.parametrize(
    ("n1", "d1", "n2", "d2", "direction", "pct"),
    [(2900, 29, 4650, 31, "increase", 50.0), (2900, 29, 2930, 31, "decrease", None), (3000, 30, 3060, 30, "flat", 2.0), (29, 30, 100, 30, "inconclusive_low_volume", None), (0, 30, 0, 30, "no_data", None), (0, 30, 120, 30, "new_activity", None)],
)
def test_comparisons(spark, n1, d1, n2, d2, direction, pct):
    r = A.compare_periods(spark.createDataFrame([(n1, d1, n2, d2)], "n1 long, days1 int, n2 long, days2 int")).first()
    assert r.direction == direction and r.absolute_change == n2 - n1
    assert pct is None or r.percent_change_per_day == pct
    assert (r.caveat is None) == (d1 == d2)


def test_dates_are_needed(spark):
    with pytest.raises(ValueError):
        E.between_dates(spark.createDataFrame([], EVENT), None, "2024-01-01")
