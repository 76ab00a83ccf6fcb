"""Exact quantiles of few large groups: histograms are refined until one value is left, no group meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrid.sources.stored import stored


def usable(rows: DataFrame, by: list[str], value: Column, weight: Column) -> DataFrame:
    """(by, value, weight) as doubles, written once. Values have to be finite; rows with a null key, value or weight go."""
    return stored(rows.select(*by, value.cast("double").alias("value"), weight.cast("double").alias("weight")).dropna())


def first_reaching(rows: DataFrame, targets: DataFrame, by: list[str], buckets: int = 4096, small: int = 1 << 20, rounds: int = 400) -> DataFrame:
    """targets (by, target) with value: the smallest of the group's values at which the running weight reaches the target,
    the largest if none does. rows: of usable, read several times.

    Each round cuts the span that holds a target into `buckets` equal parts and sums the weights of each, in part before
    the shuffle, so a group costs at most `buckets` rows a task however large it is. The part that reaches the target,
    from its smallest to its largest value, is the next span. Both ends of a span fall in different parts, so it shrinks
    until it is one value, or holds at most `small` rows: these are sorted. No task ever sorts more than that.
    """
    ends = rows.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    state = stored(targets.select(*by, F.col("target").cast("double")).distinct().join(ends, by).withColumn("below", F.lit(0.0)))
    span = [*by, "low", "high"]
    upward = Window.partitionBy(*span, "target").orderBy("part")
    every = upward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for _ in range(rounds):
        open_ = state.where((F.col("low") < F.col("high")) & (F.col("n") > small))
        if open_.isEmpty():
            break
        within = rows.join(open_.select(*span).distinct(), by).where("value BETWEEN low AND high")
        # halves: the difference of two doubles may be beyond the largest
        share = F.try_divide(F.col("value") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
        # where halves are equal although the values differ, only the largest value leaves the first part
        part = F.when(F.col("value") == F.col("high"), buckets - 1).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(buckets - 2)))
        parts = within.groupBy(*span, part.alias("part")).agg(F.sum("weight").alias("weight"), F.min("value").alias("first"), F.max("value").alias("last"), F.count("*").alias("of"))
        run = open_.join(parts, span).withColumn("run", F.col("below") + F.sum("weight").over(upward)).withColumn("end", F.max("part").over(every))
        reached = run.where((F.col("run") >= F.col("target")) | (F.col("part") == F.col("end")))
        best = reached.groupBy(*span, "target").agg(F.min_by(F.struct(F.col("first").alias("low"), F.col("last").alias("high"), F.col("of").alias("n"), (F.col("run") - F.col("weight")).alias("below")), "part").alias("best"))
        closed = state.where((F.col("low") == F.col("high")) | (F.col("n") <= small))
        state = stored(closed.unionByName(best.select(*by, "target", "best.*")))
    else:
        raise RuntimeError(f"spans are left after {rounds} rounds")
    few = state.where("low < high")
    sums = rows.join(few.select(*span, "below").distinct(), by).where("value BETWEEN low AND high").groupBy(*span, "below", "value").agg(F.sum("weight").alias("weight"))
    run = sums.withColumn("run", F.col("below") + F.sum("weight").over(Window.partitionBy(*span).orderBy("value"))).drop("below")
    last = few.join(run, span).groupBy(*by, "target").agg(F.coalesce(F.min(F.when(F.col("run") >= F.col("target"), F.col("value"))), F.max("value")).alias("value"))
    return state.where("low = high").select(*by, "target", F.col("low").alias("value")).unionByName(last)


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, n, q array<double>): number of values and their quantiles at these shares, between neighbours as percentile has
    them. Nulls do not count; groups of nulls only, and of a null key, have no row."""
    values = usable(rows, by, F.col(value), F.lit(1))
    counts = values.groupBy(*by).agg(F.count("*").alias("n"))
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.col("n") - 1)).alias("at")) for i, s in enumerate(shares))))
    places = counts.select(*by, "n", at.alias("s")).select(*by, "n", "s.*").withColumns({"lower": F.floor("at") + 1.0, "upper": F.ceil("at") + 1.0})
    wanted = places.select(*by, F.explode(F.array("lower", "upper")).alias("target"))
    found = stored(first_reaching(values, wanted, by))
    of = lambda name, as_: found.select(*by, F.col("target").alias(name), F.col("value").alias(as_))
    met = places.join(of("lower", "low"), [*by, "lower"]).join(of("upper", "high"), [*by, "upper"])
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.col("upper") - 1 - F.col("at")) * F.col("low") + (F.col("at") - (F.col("lower") - 1)) * F.col("high"))
    return met.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("q")))), lambda x: x["q"]).alias("q"))


def weighted_medians(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, value): the first value at which the running weight reaches half of the group's, within 1e-9. rows: (by, value,
    weight)."""
    rows = usable(rows, by, F.col("value"), F.col("weight"))
    halves = rows.groupBy(*by).agg((F.sum("weight") / 2 - 1e-9).alias("target"))
    return first_reaching(rows, halves, by).select(*by, "value")
