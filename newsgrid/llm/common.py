"""Shared helpers: scratch tables in the cluster's shared folder, tables by name, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that setting is absent, a local folder serves a local master only,
    as in tests: on a cluster executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="newsgrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/newsgrid-{uuid.uuid4().hex}"


def saved(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: later steps start from those files."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores after it as keep it apart from the columns of df, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_among(rows: DataFrame, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """rows (id, ...) without most of those whose id is not in wanted, before they are shuffled.

    A bitmap of 2 ** bits hashes of wanted, 2 MB whatever its size, goes to all tasks; the join that follows is exact.
    """
    slot = lambda c: F.pmod(F.col(c), F.lit(1 << bits)) + 1
    maps = wanted.select(slot("id").alias("slot")).distinct().groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
    placed = rows.withColumn("slot", slot("id")).withColumn("part", F.bitmap_bucket_number("slot"))
    met = placed.join(F.broadcast(maps), "part")
    at = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def bucket_components(members: DataFrame, verify: Callable[[DataFrame], DataFrame], further: Callable[[DataFrame], DataFrame] | None, rounds: int = 3, small: int = 32, parts: int = 16, list_last: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the members that are alike to others of a bucket. members: (bucket, id), distinct.

    verify takes distinct pairs (a, b) and returns those that are alike; further takes members (id) and returns further
    buckets of theirs (bucket, id), distinct; without it, large buckets go to the last step at once. list_last lists that
    step's pairs from members of large buckets (bucket, id, component, open).

    In each round, each bucket's smallest member is a centre that the others are compared with; those alike to it are
    done, the others go on to the next round. A group of near copies so costs one comparison a member, whoever else is in
    its bucket. Then components of all links so far are found; from here on only pairs of different components matter.
    A member that is still apart from a centre of its bucket is compared with all others in buckets of up to `small`.
    What fills a larger one is mostly one common run in texts that are otherwise different: its members are dealt to
    further buckets, many more than before, and compared in the small ones of these first, since alike texts have the rest
    in common, too. Last, what is still apart in a large bucket is compared with all others of it, so no pair of a bucket
    that could join two components is left out; this costs the square of what no earlier step has joined. No bucket is
    gathered in one task: large ones are dealt over `parts`.
    """
    crowded = lambda df: df.join(df.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").drop("last"), "bucket")
    left, edges, apart = members, [], []
    for _ in range(rounds):
        told = saved(crowded(left).where("id <> centre"))
        pairs = saved(told.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
        if not pairs.head(1):
            break
        edges.append(saved(verify(pairs)))
        near = edges[-1].select(F.col("a").alias("centre"), F.col("b").alias("id"))
        left = saved(told.join(near, ["centre", "id"], "left_anti"))
        apart.append(left)
        left = left.select("bucket", "id")
    if not edges:
        return members.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    found = saved(connected_components(union(edges)))
    of = lambda df, col, name: df.join(found.select(F.col("node").alias(col), F.col("component").alias(name)), col, "left").withColumn(name, F.coalesce(name, col))
    open_ = of(of(union(apart), "id", "component"), "centre", "other").where("component <> other").select("bucket", "id", "component").distinct()
    open_ = saved(open_)
    if not open_.head(1):
        return found
    sized = lambda df: df.join(df.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    others = saved(of(sized(members.join(open_.select("bucket").distinct(), "bucket", "left_semi")), "id", "component"))

    def pairs_of(one: DataFrame, two: DataFrame) -> DataFrame:
        two = two.select("bucket", F.col("id").alias("y"), F.col("component").alias("of_y"))
        return one.join(two, "bucket").where("component <> of_y").select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b"))

    more = pairs_of(open_, others.where(F.col("n") <= small))
    large = others.where(F.col("n") > small).select("id").distinct()
    if further and large.head(1):
        again = saved(of(sized(saved(further(large))).where((F.col("n") > 1) & (F.col("n") <= small)), "id", "component"))
        more = more.unionByName(pairs_of(again.join(open_.select("id").distinct(), "id", "left_semi").select("bucket", "id", "component"), again))
    more = saved(more.distinct())
    edges_of = lambda df: df.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if more.head(1):
        found = saved(connected_components(edges_of(found).unionByName(saved(verify(more)))))
    if not large.head(1):
        return found
    # exact for the rest: pairs of different components in large buckets that no step has compared
    rest = of(others.where(F.col("n") > small).drop("component"), "id", "component").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    asks = of(open_.select("bucket", "id").distinct(), "id", "component")
    if list_last:
        last = list_last(saved(rest.select("bucket", "id", "component").join(asks.select("bucket", "id", F.lit(True).alias("open")), ["bucket", "id"], "left").withColumn("open", F.coalesce("open", F.lit(False)))))
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    two = rest.select("bucket", "part", F.col("id").alias("y"), F.col("component").alias("of_y"))
    if not list_last:
        last = asks.join(two, ["bucket", "part"]).where("component <> of_y").select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")).distinct()
    compared = union([more, *(df.select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")) for df in apart)])
    last = saved(last.join(compared, ["a", "b"], "left_anti"))
    if not last.head(1):
        return found
    return connected_components(edges_of(found).unionByName(saved(verify(last))))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps: each only re-points edges at the smallest neighbour, so the number of
    edges never grows, and minima are combined before they are shuffled. Node ids are longs; self-loops are allowed and
    keep lone nodes. The edge table is written to the shared folder after each round, which also cuts the lineage.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            out = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        else:
            out = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = out.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = out.join(low, "u")
        if large:
            joined = joined.where("v > u")
            kept = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            kept = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        return kept.where("a <> b").distinct()

    def digest(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    nodes = saved(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = digest(e)
    for _ in range(max_rounds if before[0] else 0):
        e = saved(star(star(e, True), False))
        now = digest(e)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    low = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    return nodes.join(low, "node", "left").select("node", F.coalesce("m", "node").alias("component"))
