"""Keyed state over restarts: late days, days that are replaced, and series that fall silent."""

from datetime import date

import pytest

pytest.importorskip("google.protobuf")

from newsgrid.streaming import state as T  # noqa: E402

SCHEMA = "series_id string, event_date date, total_events long"


def test_restarts_late_days_and_expiry(spark, tmp_path):
    source, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "checkpoint"), []
    before = {k: spark.conf.get(k, None) for k in T.STATE_STORE}

    def arrive(*rows):
        """Each call is a new run of the query from its checkpoint; what it gives is returned."""
        frame = spark.createDataFrame([(s, date(2024, m, d), n) for s, m, d, n in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(source)
        seen.clear()
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = T.expiring_history(stream, days=3, silent_days=10, late="3 days").writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query.foreachBatch(lambda batch, _: seen.extend(tuple(r) for r in batch.collect())).start().awaitTermination(100)
        return sorted((s, d, list(n), e) for s, d, n, e in seen)

    try:
        for k, v in T.STATE_STORE.items():
            spark.conf.set(k, v)
        assert arrive(("a", 1, 1, 5), ("a", 1, 2, 6), ("b", 1, 2, 1)) == [("a", "2024-01-02", [5, 6], False), ("b", "2024-01-02", [1], False)]
        # a restart goes on from the state; a day that comes again replaces itself, a late one takes its place
        assert arrive(("a", 1, 4, 8), ("a", 1, 2, 7)) == [("a", "2024-01-04", [5, 7, 8], False)]
        assert arrive(("a", 1, 3, 9)) == [("a", "2024-01-04", [7, 9, 8], False)]
        # 20 January less three days is more than ten days after both series' last days
        got = arrive(("c", 1, 20, 2))
        assert ("c", "2024-01-20", [2], False) in got
        assert [r for r in got if r[3]] == [("a", "2024-01-04", [7, 9, 8], True), ("b", "2024-01-02", [1], True)]
        # what is behind the watermark is dropped; an ended series starts afresh
        assert arrive(("b", 1, 5, 1), ("a", 1, 19, 4)) == [("a", "2024-01-19", [4], False)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
