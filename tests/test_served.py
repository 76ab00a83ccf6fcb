"""Operators that SQL does not tell: keyed state, context forecasts, re-ranking, series keys, decisions, texts for vectors."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from test_nearest_texts import brute

from newsgrid.operators import lookup as L
from newsgrid.operators import reports as P
from newsgrid.operators import served as V
from newsgrid.operators import series as T
from newsgrid.streaming import events as E


def test_keyed_state_keeps_the_last_days(spark, tmp_path):
    schema = "series_id string, event_date date, total_events long"
    day = lambda i: date(2024, 1, 1) + timedelta(i)
    for k, rows in enumerate([[("a", day(i), i) for i in range(4)] + [("b", day(0), 7)], [("a", day(3), 30), ("a", day(4), 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in*"))
    q = E.kept_history(stream, 3).writeStream.outputMode("update").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in sorted(spark.table("kept").collect(), key=lambda r: r.last_day):
        last[r.series_id] = (r.last_day, r.counts)
    assert last["a"] == ("2024-01-05", [2, 30, 4]) and last["b"] == ("2024-01-01", [7])


def test_context_takes_the_place_of_the_recent_mean(spark):
    rows = [("s", "total", date(2024, 1, 1) + timedelta(i), float(i % 5 + 1)) for i in range(40)]
    long = spark.createDataFrame(rows, "series_id string, measure string, event_date date, y double")
    plain = {r.h: r.p for r in T.excitation_forecast(long, 3).collect()}
    got = {r.h: r.p for r in V.with_context(long, spark.createDataFrame([("s", 50.0)], "series_id string, context double"), 3).collect()}
    recent = sum(r[3] for r in rows[-7:]) / 7
    base = 0.65 * 3 + 0.35 * 3
    ys = [r[3] for r in rows]
    m = sum(ys) / len(ys)
    ac = sum((a - m) * (b - m) for a, b in zip(ys[1:], ys)) / sum((y - m) ** 2 for y in ys)
    alpha = min(0.85, max(0.05, ac))
    for h in (1, 2, 3):
        lift = (max(0, 50 - base) - max(0, recent - base)) * alpha * math.exp(-h * math.log(2) / 7)
        assert math.isclose(got[h] - plain[h], lift, rel_tol=1e-6)
    with pytest.raises(ValueError):
        V.with_context(long, None, 61)


def test_reranked_by_phase(spark):
    rows = [("x", phase, i, date(2024, 1, d), 1.0 if i < 3 else 2.0) for phase in ("preceding", "following", "reactions") for i, d in ((1, 5), (2, 3), (3, 4))]
    line = spark.createDataFrame(rows, "seed_id string, phase string, GlobalEventID long, SQLDATE date, score double")
    scores = line.select("seed_id", "GlobalEventID", "score").distinct()
    got = {}
    for r in L.reranked(line.drop("score"), scores).orderBy("phase", "rank").collect():
        got.setdefault(r.phase, []).append(r.GlobalEventID)
    assert got == {"preceding": [3, 1, 2], "following": [3, 2, 1], "reactions": [3, 1, 2]}


def test_series_keys(spark):
    rows = spark.createDataFrame([(None, "  united states "), ("United States and Mexico", None), ("ACTOR_PAIR: Zed/Abe", None), ("us", None), ("", None), (None, None), ("Abe vs Abe", None)], "region string, actor string")
    got = [r[0] for r in rows.select(L.series_key(F.col("region"), F.col("actor"))).collect()]
    assert got[0] == "actor:UNITED STATES" and got[1].startswith("country_pair:") and got[2] == "actor_pair:ABE :: ZED"
    assert got[3:] == ["country:US", "global:ALL", "global:ALL", "global:ALL"]


def test_decisions(spark):
    cases = [(5.0, 0.8, 4.0, 0.8, 0.5, 2.0, "b"), (3.0, 0.8, 4.0, 0.8, -2.0, -0.5, "a"), (3.0, 0.8, 4.0, 0.8, -2.0, 0.5, "b"), (3.0, 0.7, 4.0, 0.8, 0.0, 0.0, "b"), (3.0, 0.8, 4.0, 0.1, 0.0, 0.0, "a"), (3.0, 0.1, 4.0, 0.1, 0.0, 0.0, "none")]
    rows = spark.createDataFrame(cases, "a_mae double, a_coverage double, b_mae double, b_coverage double, lo double, hi double, want string")
    assert all(r.decision == r.want for r in V.decision(rows).collect())


def test_texts_and_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 200), (1, "w" * 200), (2, "short"), (3, None), (4, "y" * 9000)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in V.prepared_texts(docs).collect()} == {1: "w" * 200, 4: "y" * 8000}
    parts = list(V.chunks(docs.select("doc_id"), 2, 5, lambda r: {"d": r["doc_id"] * 10}))
    assert [len(p) for p in parts] == [2, 2, 1] and sum(r["d"] for p in parts for r in p) == 110
    with pytest.raises(ValueError):
        L.guarded_range(docs, "2024-01-01", "2024-01-08", 7)


def test_coverage_prefers_the_own_page(spark):
    texts = {10: ("u1", "Alpha meets Beta in Paris"), 11: ("u2", ""), 12: ("u4", "Beta talks, Paris listens: Alpha gone"), 13: ("u5", "nothing alike"), 14: ("u1", "a later page"), 15: ("u6", None), 16: ("u7", "Paris Paris")}
    pages = spark.createDataFrame([(i, u, t) for i, (u, t) in texts.items()], "page_id long, url string, text string")
    told = [(1, "u1", "whatever"), (2, "u2", "ALPHA meets Beta"), (3, "u3", "unknown words"), (4, None, "Paris"), (5, "u2", "ALPHA meets Beta"), (6, "u2", None), (7, "u6", "Paris")]
    got = {r.GlobalEventID: r for r in V.with_coverage(spark.createDataFrame(told, "GlobalEventID long, SOURCEURL string, headline string"), pages, 2).collect()}
    want = {i: [(r[2], r[3]) for r in brute([(i, t) for i, (_, t) in texts.items()], [(0, h)], 2)] for i, _, h in told}
    assert len(got) == len(told) and (got[1].source, got[1].page_id, got[1].text, got[1].near) == ("page", 10, texts[10][1], None)
    for i in (2, 4, 5, 7):
        assert (got[i].source, got[i].page_id, got[i].text) == ("nearest", want[i][0][0], texts[want[i][0][0]][1])
        assert [tuple(x) for x in got[i].near] == want[i]
    assert [(got[i].source, got[i].page_id, got[i].text) for i in (3, 6)] == [("none", None, None)] * 2


def test_feature_paths_agree_and_differences_show(spark):
    one = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0)], "k string, d int, x double")
    two = spark.createDataFrame([("a", 1, 2.5), ("c", 1, 3.0)], "k string, d int, x double")
    assert tuple(V.largest_difference(one, one, ["k", "d"], ["x"]).first()) == (2, 0, 0.0)
    assert tuple(V.largest_difference(one, two, ["k", "d"], ["x"]).first()) == (1, 2, 0.5)


def test_record_claims_in_parentheses_and_lists(spark):
    docs = spark.createDataFrame([(1, "Four records on 2024-01-02. The top ten events on 2024-01-02 matter. Two events (2024-01-02) stand out."), (2, "Two entries each with 70 articles.")], "doc_id long, text string")
    shown = spark.createDataFrame([(1, date(2024, 1, 2), 5), (2, date(2024, 1, 3), 70), (2, date(2024, 1, 4), 70)], "doc_id long, day date, articles int")
    assert {(r.doc_id, r.claimed, r.available) for r in P.count_overclaims(docs, shown).collect()} == {(1, 4, 1)}
