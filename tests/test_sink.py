"""Batches that are replayed, or that stop between rows and ledger, are in the table once."""

import pytest
from pyspark.sql import functions as F

from newsgrid.streaming import sink as K

SCHEMA = "id long, name string"


def rows(spark, path):
    return sorted((r.id, r.stream, r.batch) for r in K.read_committed(spark, path, spark.createDataFrame([], SCHEMA).schema).collect())


def test_replays_append_nothing(spark, tmp_path):
    path, one, two = str(tmp_path / "table"), spark.range(3).select("id", F.lit("x").alias("name")), spark.range(2).select("id", F.lit("y").alias("name"))
    assert rows(spark, path) == [] and K.ledger(spark, path).count() == 0
    first, other = K.append_once(path, "a"), K.append_once(path, "b", lambda batch: batch.where("id > 0"))
    for _ in range(3):
        first(one, 0)
    first(two, 1)
    other(two, 0)
    first(two.limit(0), 2)
    assert rows(spark, path) == [(0, "a", 0), (0, "a", 1), (1, "a", 0), (1, "a", 1), (1, "b", 0), (2, "a", 0)]
    assert sorted((r.stream, r.batch, r.n_rows) for r in K.ledger(spark, path).collect()) == [("a", 0, 3), ("a", 1, 2), ("a", 2, 0), ("b", 0, 1)]


def test_a_crash_between_rows_and_ledger(spark, tmp_path, monkeypatch):
    """The stream stops after the rows of its second batch; readers do not see them, and a restart writes them once."""
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    frame = lambda a, z: spark.range(a, z).select("id", F.lit("x").alias("name"))
    place, crash = K._place, [False]

    def failing(path, kind, stream, batch):
        if crash[0] and kind == "ledger" and "rows" in seen:
            raise OSError("the driver is lost")
        seen.append(kind)
        return place(path, kind, stream, batch)

    seen: list[str] = []

    def run():
        seen.clear()
        query = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(K.append_once(path, "s")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(60)

    frame(0, 4).coalesce(1).write.mode("append").parquet(source)
    run()
    frame(4, 7).coalesce(1).write.mode("append").parquet(source)
    monkeypatch.setattr(K, "_place", failing)
    crash[0] = True
    with pytest.raises(Exception, match="the driver is lost"):
        run()
    assert "rows" in seen and [r[0] for r in rows(spark, path)] == [0, 1, 2, 3]
    crash[0] = False
    run()
    assert rows(spark, path) == [*((i, "s", 0) for i in range(4)), *((i, "s", 1) for i in range(4, 7))]
    assert spark.read.parquet(f"{path}/rows").count() == 7
