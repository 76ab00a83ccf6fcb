"""Mentions of events: rows as the SQL text has them, met by equality."""

import shutil

from pyspark.sql import functions as F

from newsgrid.sources import adapter

FOLDER = "/root/testdata/sf0.001"


def test_rows_of_odd_ids(spark, tmp_path):
    """Ids that name a page twice or three times, negative ones and nulls; pages that no event can name, and negative pages."""
    for name in ("customer", "nation", "region"):
        shutil.copy(f"{FOLDER}/{name}.parquet", tmp_path)
    events = spark.read.parquet(f"{FOLDER}/events.parquet").limit(400)
    odd = F.when(F.col("event_id") % 9 == 0, F.lit(None)).when(F.col("event_id") % 2 == 0, -F.col("event_id")).otherwise(F.col("event_id") * 25)
    events.withColumn("event_id", odd).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(-150, 300).select(F.col("id").alias("page_id"), F.concat(F.lit("https://s"), F.col("id") % 4, F.lit(".org/"), "id").alias("url"), F.lit("").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    got = adapter.mentions(spark, str(tmp_path))
    want = spark.sql(adapter.FACT + adapter.MENTIONS + " SELECT * FROM mentions", **adapter._tables(spark, str(tmp_path), adapter.TABLES))
    assert got.columns == want.columns and got.count() > 400
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_event_is_compared_with_every_page(spark):
    plan = adapter.mentions(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
