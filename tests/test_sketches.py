"""Distinct counts from sketches of days."""

from pyspark.sql import functions as F

from newsgrid.operators import lookup as L


def test_within_the_stated_error_and_over_any_range(spark):
    n = 60_000
    rows = spark.range(n).select(F.expr("date_add(DATE '2024-01-01', cast(id % 40 AS int))").alias("SQLDATE"), (F.col("id") % 25_013).cast("string").alias("many"), F.when(F.col("id") % 3 > 0, (F.col("id") % 7).cast("string")).alias("few"), F.lit(None).cast("string").alias("none"))
    sketches = L.day_sketches(rows, ["many", "few", "none"])
    assert sketches.count() == 40
    got = {r.period.isoformat(): r for r in L.distincts_over(sketches, F.to_date(F.date_trunc("month", "SQLDATE")), ["many", "few", "none"]).collect()}
    want = {r.period.isoformat(): r for r in rows.groupBy(F.to_date(F.date_trunc("month", "SQLDATE")).alias("period")).agg(F.count("*").alias("events"), F.count_distinct("many").alias("many"), F.count_distinct("few").alias("few")).collect()}
    assert got.keys() == want.keys() and len(got) == 2
    for k, r in got.items():
        assert (r.events, r.few, r.none) == (want[k].events, want[k].few, 0)
        assert abs(r.many - want[k].many) <= 4 * 0.0081 * want[k].many


def test_no_events(spark):
    none = spark.createDataFrame([], "SQLDATE date, a string")
    assert L.distincts_over(L.day_sketches(none, ["a"]), F.col("SQLDATE"), ["a"]).count() == 0
