"""Quantiles by refined histograms against percentile and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from newsgrid.operators import quantiles as Q


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [("even", float(i)) for i in range(1000)] + [("one", 4.25)] + [("two", -1.0), ("two", 3.0)]
    out += [("wild", r.choice([-1, 1]) * 10.0 ** r.uniform(-20, 20)) for _ in range(400)]
    out += [("ties", r.choice([0.0, 0.0, 1.0, 1e-9])) for _ in range(700)] + [("close", 1.0 + i * 2.0**-52) for i in range(50)]
    out += [("tiny", i * 5e-324) for i in range(9)] + [("ends", -1.7e308), ("ends", 1.7e308), ("ends", 1.0)]
    out += [("nulls", None), ("even", None), (None, 1.0)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("buckets, small", [(100, 1), (4096, 20), (4096, 1 << 20)])
def test_as_percentile(spark, rows, buckets, small, monkeypatch):
    refine = Q.first_reaching
    monkeypatch.setattr(Q, "first_reaching", lambda *a: refine(*a, buckets=buckets, small=small))
    frame = spark.createDataFrame(rows, "kind string, x double")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.kind: (r.n, r.q) for r in Q.quantiles(frame, ["kind"], "x", shares).collect()}
    want = {r.kind: (r.n, r.q) for r in frame.where("kind IS NOT NULL AND x IS NOT NULL").groupBy("kind").agg(F.count("x").alias("n"), F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got == want


def test_weighted_medians(spark):
    r = random.Random(5)
    rows = [(f"g{i % 3}", round(r.uniform(0, 5), 2), float(r.randint(1, 9))) for i in range(500)] + [("lone", 7.0, 2.0), ("lone", None, 2.0)]
    got = {x.g: x.value for x in Q.weighted_medians(spark.createDataFrame(rows, "g string, value double, weight double"), ["g"]).collect()}
    for g in ("g0", "g1", "g2", "lone"):
        own = sorted((v, w) for k, v, w in rows if k == g and v is not None)
        run, half = 0.0, sum(w for _, w in own) / 2
        for v, w in own:
            run += w
            if run >= half - 1e-9:
                assert got[g] == v
                break


def test_nothing(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert Q.quantiles(none, ["g"], "x", [0.5]).count() == 0


def test_no_task_sees_a_whole_group(spark):
    """What is shuffled of one group of 200,000 values is buckets, not values."""
    rows = spark.range(200_000, numPartitions=8).select(F.lit("all").alias("g"), (F.col("id") * 7919 % 200_003).cast("double").alias("value"), F.lit(1.0).alias("weight"))
    (found,) = Q.first_reaching(rows, spark.createDataFrame([("all", 100_000.0)], "g string, target double"), ["g"], buckets=100, small=50).collect()
    values = sorted(i * 7919 % 200_003 for i in range(200_000))
    assert found.value == values[99_999]
