"""Streams of export batches: ingest, deduplication, rollups, gaps and enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrid.functions import scalars as S
from newsgrid.operators.events import fingerprints
from newsgrid.sources import exports


def read_batches(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of typed events from a folder that batch files arrive in. Absent batches are no error; the checkpoint of
    the query that reads this stream is the ledger of files, so each is read once."""
    return exports.parsed(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def first_only(events: DataFrame, late: str = "7 days") -> DataFrame:
    """The first row of each event id; ids are remembered for `late` after their arrival time."""
    return events.withWatermark("DATEADDED", late).dropDuplicatesWithinWatermark(["GlobalEventID"])


def counts_by_window(events: DataFrame, width: str = "15 minutes", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events and conflicts by tumbling, or with slide sliding, windows of arrival time. Works on a table and on a stream;
    with late, windows close that long after their end."""
    rows = events if late is None else events.withWatermark("DATEADDED", late)
    window = F.window("DATEADDED", width, slide) if slide else F.window("DATEADDED", width)
    out = rows.groupBy(window.alias("w")).agg(F.count("*").alias("n"), S.share(S.conflict()).alias("conflicts"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "conflicts")


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "EventRootCode", late: str | None = None) -> DataFrame:
    """Stretches of arrivals by key, ended by a gap: between two of them the source was silent."""
    rows = events if late is None else events.withWatermark("DATEADDED", late)
    out = rows.groupBy(F.session_window("DATEADDED", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def missing_days(events: DataFrame, start: str, end: str) -> DataFrame:
    """Days from start to end without an event."""
    spark = events.sparkSession
    days = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}')) AS day")
    return days.join(events.select(F.col("SQLDATE").alias("day")).distinct(), "day", "left_anti")


def enriched(events: DataFrame) -> DataFrame:
    """A stream or table of derived rows: only column expressions, no join."""
    return fingerprints(events)


def refresh_days(events: DataFrame, table: str, rollup: Callable[[DataFrame], DataFrame], day: str = "date") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: recompute the days that a micro-batch touches, over the whole event table, and overwrite
    just those partitions of `table`. Replayed batches give the same table."""

    def run(batch: DataFrame, _: int) -> None:
        touched = batch.select("SQLDATE").distinct()
        rows = rollup(events.join(F.broadcast(touched), "SQLDATE", "left_semi"))  # one row a day
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(table)

    return run


def kept_history(series: DataFrame, days: int = 30) -> DataFrame:
    """Keyed state of a stream of daily counts (series_id, event_date, total_events): each series keeps its last `days` days,
    later rows of a day in place of earlier ones, for the next forecast. Whenever a series changes it gives one row
    (series_id, last_day, counts: an array by day, oldest first)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        for frame in frames:
            held.update(zip(frame.event_date.astype(str), frame.total_events.astype("int64").tolist()))
        last = sorted(held)[-days:]
        state.update((last, [held[d] for d in last]))
        yield pd.DataFrame({"series_id": [key[0]], "last_day": [last[-1]], "counts": [[held[d] for d in last]]})

    out = "series_id string, last_day string, counts array<bigint>"
    return series.groupBy("series_id").applyInPandasWithState(run, out, "days array<string>, counts array<bigint>", "update", GroupStateTimeout.NoTimeout)
