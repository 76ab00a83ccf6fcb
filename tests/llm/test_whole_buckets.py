"""Buckets of any size: every pair that could join two components is compared."""

from pyspark.sql import functions as F

from newsgrid.llm.common import bucket_components


def test_large_bucket_without_help_of_further_ones(spark):
    """One bucket of 120 members in 40 groups of 3; further buckets tell nothing, so only its own pairs can."""
    members = spark.range(120).select(F.lit(7).cast("long").alias("bucket"), "id")
    listed = []

    def verify(pairs):
        listed.append(pairs.count())
        return pairs.where("a % 40 = b % 40").select("a", "b")

    def further(ids):
        return ids.select(F.col("id").alias("bucket"), "id")

    found = bucket_components(members, verify, further)
    assert {r.node: r.component for r in found.collect()} == {i: i % 40 for i in range(120)}
    # no pair twice
    assert sum(listed) <= 120 * 119 / 2


def test_pairs_of_one_component_are_not_listed(spark):
    """Two groups of 60 near copies in one bucket: centres join each; after that only pairs across are listed, each once."""
    members = spark.range(120).select(F.lit(7).cast("long").alias("bucket"), "id")
    listed = []

    def verify(pairs):
        listed.append(pairs.count())
        return pairs.where("a % 2 = b % 2").select("a", "b")

    found = bucket_components(members, verify, lambda ids: ids.select(F.col("id").alias("bucket"), "id"))
    assert {r.component for r in found.collect()} == {0, 1} and sum(listed) <= 119 + 59 + 60 * 60
