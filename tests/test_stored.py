"""Stored tables of many rows are not broadcast because their files are small."""

from pyspark.sql import functions as F

from newsgrid.sources import adapter
from newsgrid.sources.stored import FEW_ROWS, counted


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_files_of_many_rows_are_not_broadcast(spark):
    many, n = counted(spark.range(FEW_ROWS + 1).select((F.col("id") % 7).alias("k"), F.lit("x").alias("x")))
    few, _ = counted(spark.range(FEW_ROWS).select((F.col("id") % 7).alias("k"), F.lit("y").alias("y")))
    left, _ = counted(spark.range(FEW_ROWS + 1).select(F.col("id").alias("k")))
    assert n == FEW_ROWS + 1
    assert "Broadcast" not in plan(left.join(many.where("k > 3").distinct(), "k"))
    assert "Broadcast" in plan(few.join(spark.range(FEW_ROWS).toDF("k"), "k"))
    assert "Broadcast" in plan(left.join(F.broadcast(few), "k"))


def test_customers_are_not_broadcast_where_they_are_many(spark, tmp_path):
    day = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts")
    n = FEW_ROWS + 1
    tables = {
        "events": spark.range(20).select(F.col("id").alias("event_id"), day, F.col("id").alias("user_id"), F.lit("t").alias("event_type"), F.lit(2.0).alias("value"), F.lit('{"k": 3}').alias("props")),
        "customer": spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey")),
        "nation": spark.sql("SELECT 1 AS n_nationkey, 'N' AS n_name, 1 AS n_regionkey"),
        "region": spark.sql("SELECT 1 AS r_regionkey, 'R' AS r_name"),
        "pages": spark.sql("SELECT CAST(5 AS BIGINT) AS page_id, 'http://a/b' AS url, '' AS html"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    facts = adapter.fact(spark, str(tmp_path))
    told = plan(facts.select("GlobalEventID", "ActionGeo_FullName"))
    assert "SortMergeJoin" in told and facts.count() == 20 and facts.where("ActionGeo_FullName = 'N, R'").count() == 20
