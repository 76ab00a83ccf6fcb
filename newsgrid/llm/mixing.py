"""Mixing sources to target weights (operator 6): entropy balancing with token constraints, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgrid.llm.common import saved, table, unused

#: A word, as the sizes count it.
WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of one step of the rounding search, and its steps: thresholds are told apart to 4 / 64 ** 4.
BUCKETS, STEPS = 64, 4


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sources (source, source_size) with source_key, numbered from 0 by code point (null last), and target.

    Weights repeat along source_key. All targets together are share of all sizes; a target stops at cap times its
    source's size, and what is above is shared again by weight until none is. Only sums come to the driver.
    """
    order = F.col("source").asc_nulls_last()
    placed = saved(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()))
    part, nth = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One row for each partition.
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("source_key", F.col("before") + nth)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_key") % len(weights) + 1).cast("int"))
    rows = saved(numbered.select("source", "source_key", "source_size", weight.alias("weight")))
    total = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    unit, last = 0.0, -1
    most = F.col("source_size") * F.lit(cap)
    while True:
        above = F.col("weight") * F.lit(unit) >= most
        capped, free, n = rows.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight"))), F.sum(above.cast("long"))).first()
        if n == last or not free:
            break
        unit, last = max(0.0, total - (capped or 0.0)) / free, n
    target = F.least(F.col("weight") * F.lit(unit), most) if total else F.lit(0.0)
    return saved(rows.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(target)))


def _rate(cap: float, share: float):
    """The tilted rate of a document: from the base rate `share`, by exp(tilt * words), kept below cap."""
    odds = share / (cap - share)
    return F.lit(cap) / (F.lit(1.0) + F.exp(-F.col("tilt") * F.col("words")) / F.lit(odds))


def solve_tilts(classes: DataFrame, targets: DataFrame, share: float, cap: float, close: float = 1e-9, most: int = 60) -> DataFrame:
    """(source_key, scale, tilt): Newton steps on the dual, one unknown a source, all sources at once.

    classes: (source_key, size, n), documents counted by size, since rates depend on nothing else. The dual's derivative
    is the words taken less the target; it rises with the tilt, so a bracket guards the steps. Each round is one
    aggregation over classes; the driver sees only the largest error.
    """
    scale = classes.groupBy("source_key").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    inside = targets.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(cap) * F.lit(1 - 1e-12)))
    state = saved(inside.join(scale, "source_key").select("source_key", "target", "scale", *(F.lit(x).alias(c) for c, x in (("tilt", 0.0), ("low", -1e7), ("high", 1e7)))))
    if not state.head(1):
        return state.select("source_key", "scale", "tilt")
    for _ in range(most):
        rows = classes.join(state, "source_key").withColumn("words", F.col("size") / F.col("scale")).withColumn("rate", _rate(cap, share))
        taken = F.sum(F.col("n") * F.col("size") * F.col("rate"))
        slope = F.sum(F.col("n") * F.col("size") * F.col("words") * F.col("rate") * (1 - F.col("rate") / F.lit(cap)))
        sums = rows.groupBy("source_key", "target", "scale", "tilt", "low", "high").agg(taken.alias("taken"), slope.alias("slope"))
        low = F.when(F.col("taken") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("taken") < F.col("target"), F.col("high")).otherwise(F.col("tilt"))
        step = F.col("tilt") - F.try_divide(F.col("taken") - F.col("target"), F.col("slope"))
        newton = (step > low) & (step < high) & (F.abs(step - F.col("tilt")) <= 8 * F.greatest(F.abs("tilt"), F.lit(1.0)))
        error = F.abs(F.col("taken") / F.col("target") - 1)
        next_tilt = F.when(error <= close, F.col("tilt")).when(newton, step).otherwise((low + high) / 2)
        state = saved(sums.select("source_key", "target", "scale", next_tilt.alias("tilt"), low.alias("low"), high.alias("high"), error.alias("error")))
        if state.agg(F.max("error")).first()[0] <= close:
            break
        state = state.drop("error")
    return state.select("source_key", "scale", F.round("tilt", 8).alias("tilt"))


def _thresholds(rated: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """(source_key, shift, taken): the shift of all rates of a source before rounding whose words come closest to the target.

    A document takes its k-th copy at shift k - 1 + u - rate. A source's words by shift are a step function; it is
    searched by histograms of BUCKETS rows a source, each step inside the bucket where the one before crossed the target.
    """
    copies = F.explode(F.array(*(F.lit(k) for k in range(cap))))
    points = rated.where("size > 0").select("source_key", "size", "u", "rate", copies.alias("k")).withColumn("x", F.col("k") + F.col("u") - F.col("rate"))
    width = 2.0 * (cap + 1)
    state = saved(targets.where("target > 0").select("source_key", "target", F.lit(-width / 2).alias("low"), F.lit(0).cast("decimal(38,0)").alias("base")))
    by_source = Window.partitionBy("source_key").orderBy("bucket")
    for _ in range(STEPS):
        narrow = width / BUCKETS
        # below the bracket all is counted in bucket -1, above it nothing
        bucket = F.when(F.col("x") < F.col("low"), -1).otherwise(F.floor((F.col("x") - F.col("low")) / narrow))
        sums = points.join(state, "source_key").withColumn("bucket", bucket.cast("long")).where(F.col("bucket") < BUCKETS)
        sums = sums.groupBy("source_key", "target", "low", "bucket").agg(F.sum("size").alias("n"))
        running = sums.withColumn("upto", F.sum("n").over(by_source)).withColumn("before", F.col("upto") - F.col("n"))
        crossed = running.withColumn("ok", (F.col("upto") > F.col("target")) & (F.col("bucket") >= 0))
        # the first bucket that passes the target, else the last one
        choice = F.min_by(F.struct("bucket", "before", "upto"), F.struct(~F.col("ok"), F.when(F.col("ok"), F.col("bucket")).otherwise(-F.col("bucket"))))
        found = crossed.groupBy("source_key", "target", "low").agg(choice.alias("c"))
        at = F.greatest(F.col("c.bucket"), F.lit(0))
        state = saved(found.select("source_key", "target", (F.col("low") + at * narrow).alias("low"), F.col("c.before").alias("before"), F.col("c.upto").alias("upto")))
        width = narrow
        last, state = state, state.select("source_key", "target", "low")
    nearer = F.abs(F.col("upto") - F.col("target")) <= F.abs(F.col("before") - F.col("target"))
    return last.select("source_key", F.when(nearer, F.col("low") + width).otherwise(F.col("low")).alias("shift"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, repairs: int = 6) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate, source, text_hash) for every row of docs (doc_id, text, source).

    size: the words of the text (null: 0). Sources stand by code point, null last, and weights repeat along them;
    together they take share of all words, at most cap times a source's own. Within a source the rates are those
    nearest to `share`, in relative entropy between 0 and cap, that take the target's words: an exponential tilt in the
    document's words, found by Newton steps on the convex dual. A capped source takes all documents cap times. Rates
    become whole copies by a hash of the doc_id; one shift a source, then up to `repairs` single documents a source,
    bring the sum next to the target, ties by a hash of id and text. taken = copies * size. Tilts are rounded, so that sums
    in another order give the same copies; rows with equal ids and texts may differ in copies only through the repairs. Empty texts take no words; an empty table gives no rows; other columns are ignored.

    No source meets in one task: all is sums by source, combined before the shuffle, and joins of the narrow table with
    the sources' table.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    u = (F.xxhash64(F.lit("copies"), "doc_id").bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    sizes = saved(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), u.alias("u"), F.xxhash64("text").alias("text_hash")).withColumn("row", F.monotonically_increasing_id()))
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    keyed = sizes.join(targets.select(F.col("source").alias("s"), "source_key"), sizes["source"].eqNullSafe(F.col("s"))).drop("s")
    classes = saved(keyed.where("size > 0").groupBy("source_key", "size").agg(F.count("*").alias("n")))
    tilts = solve_tilts(classes, targets, share, cap)
    full = F.col("target") >= F.col("source_size") * F.lit(cap) * F.lit(1 - 1e-12)
    by_key = saved(targets.join(tilts, "source_key", "left"))
    rated = keyed.join(by_key.drop("source"), "source_key").withColumn("words", F.col("size") / F.col("scale"))
    rate = F.when(F.col("tilt").isNotNull(), _rate(cap, share)).when(full & (F.col("source_size") > 0), F.lit(float(cap))).otherwise(F.lit(0.0))
    rated = saved(rated.withColumn("rate", rate).select("row", "doc_id", "text_hash", "source_key", "size", "u", "rate"))
    shifts = _thresholds(rated, targets, cap)
    rounded = rated.join(shifts, "source_key", "left")
    copies = F.floor(F.col("rate") + F.coalesce("shift", F.lit(0.0)) + 1 - F.col("u"))
    copies = F.when(F.col("rate") >= cap, F.lit(cap)).otherwise(F.greatest(F.lit(0), F.least(F.lit(cap), copies)))
    chosen = saved(rounded.withColumn("copies", copies.cast("long")).select("row", F.xxhash64("doc_id", "text_hash").alias("tie"), "source_key", "size", "copies"))

    flips = None
    for _ in range(repairs):
        now = chosen
        if flips is not None:
            now = now.join(flips, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")
        gap = now.groupBy("source_key").agg(F.sum(F.col("copies") * F.col("size")).alias("got")).join(targets, "source_key")
        gap = gap.select("source_key", (F.col("target") - F.col("got")).alias("gap")).where(F.abs("gap") >= 1)
        change = F.when(F.col("gap") > 0, 1).otherwise(-1)
        left = F.abs(F.col("gap") - change * F.col("size"))
        able = now.where("size > 0").join(gap, "source_key").withColumn("change", change).withColumn("left", left)
        able = able.where((F.col("left") < F.abs("gap")) & (F.col("copies") + F.col("change")).between(0, cap))
        best = able.groupBy("source_key").agg(F.min(F.struct("left", "tie", "row", "change")).alias("b")).select(F.col("b.row").alias("row"), F.col("b.change").alias("change"))
        new = saved(best)
        if not new.head(1):
            break
        flips = new if flips is None else saved(flips.unionByName(new).groupBy("row").agg(F.sum("change").alias("change")))
    final = chosen
    if flips is not None:
        final = final.join(flips, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    out = rated.join(final.select("row", "copies"), "row").join(targets, "source_key")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", "source", "text_hash")


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, all columns, each as often as the mix takes it; equal rows are taken equally often, those that a
    repair took once more or less as often as the others."""
    doc, text, source, copies = (unused(docs, f"mix_{x}") for x in ("doc", "text", "source", "copies"))
    n = mix(docs, **options).groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), F.col("source").alias(source)).agg(F.min("copies").alias(copies))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text)) & F.col("source").eqNullSafe(F.col(source))
    taken = docs.join(n.where(F.col(copies) > 0), same)
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
