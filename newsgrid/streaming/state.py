"""Keyed state of streams that ends: the last days of each series, kept until the series is silent for long."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where state lives on disk, with snapshots in the checkpoint; the class that keyed state with timers asks for.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "series_id string, last_day string, counts array<bigint>, ended boolean"


class _LastDays(StatefulProcessor):
    """One entry a day and series; one timer a series, moved on whenever a later day arrives."""

    def __init__(self, days: int, silent_days: int):
        self.most, self.silent = days, silent_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "day string", "n bigint")

    def _row(self, key: tuple, held: dict[str, int], ended: bool) -> Row:
        return Row(series_id=key[0], last_day=max(held), counts=[held[d] for d in sorted(held)], ended=ended)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.counts.updateValue((str(r.event_date),), (int(r.total_events),))
        held = {day[0]: n[0] for day, n in self.counts.iterator()}
        for day in sorted(held)[: -self.most]:
            self.counts.removeKey((day,))
            del held[day]
        ends = datetime.fromisoformat(max(held)).replace(tzinfo=timezone.utc) + timedelta(days=self.silent)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(ends.timestamp() * 1000))
        yield self._row(key, held, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = {day[0]: n[0] for day, n in self.counts.iterator()}
        self.counts.clear()
        if held:
            yield self._row(key, held, True)

    def close(self) -> None:
        pass


def expiring_history(series: DataFrame, days: int = 30, silent_days: int = 60, late: str = "3 days") -> DataFrame:
    """Keyed state of a stream of daily counts (series_id, event_date, total_events): each series keeps its last `days` days.

    Whenever a series changes it gives a row (series_id, last_day, counts: oldest first, ended: false). A later row of a
    day takes the place of an earlier one; rows more than `late` behind the newest day of all are dropped. Once the newest
    day of all, less `late`, is silent_days beyond a series' last day, the series gives a last row with ended: true and its
    state goes; a new day starts it afresh. So state is bounded by the series of the last months. The session has to have
    STATE_STORE set before the query starts.
    """
    rows = series.select("series_id", "event_date", "total_events", F.col("event_date").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("series_id").transformWithState(_LastDays(days, silent_days), OUT, "Update", "EventTime")
