"""Export files and streams: parsing, late rows, and batch results equal to streamed ones."""

from datetime import date

from pyspark.sql import functions as F

from newsgrid.operators import rollups as R
from newsgrid.sources import exports
from newsgrid.streaming import events as V


def line(i, day="20240109", added="20240109101500", country="US", n=exports.N_FIELDS, **values):
    fields = [""] * n
    for name, v in {"GlobalEventID": str(i), "SQLDATE": day, "DATEADDED": added, "ActionGeo_CountryCode": country, "EventCode": "020", "EventRootCode": "02", **values}.items():
        fields[exports.POSITIONS[name]] = v
    return "\t".join(fields)


def test_export_lines(spark, tmp_path):
    rows = [line(1, GoldsteinScale="-5.5", NumArticles="7", ActionGeo_Lat="", Actor1Name='A "quoted" name'), line(2, GoldsteinScale="x", country="FR"), line(3)[:-5].rstrip("\t"), line(4, day="20241399")]
    (tmp_path / "20240109101500.export.CSV").write_text("\n".join(rows))
    (tmp_path / "20240109101500.translation.export.CSV").write_text(line(9, country="CA"))
    got = {r.GlobalEventID: r for r in exports.read_exports(spark, [str(tmp_path)]).collect()}
    assert set(got) == {1, 2, 4, 9}
    assert (got[1].SQLDATE, got[1].GoldsteinScale, got[1].NumArticles, got[1].ActionGeo_Lat, got[1].Actor1Name) == (date(2024, 1, 9), -5.5, 7, None, 'A "quoted" name')
    assert got[1].EventCode == "020" and got[2].GoldsteinScale is None and got[4].SQLDATE is None
    assert [r.GlobalEventID for r in exports.read_exports(spark, [str(tmp_path)], ["CA"]).collect()] == [9]


def test_cleaning(spark):
    rows = spark.createDataFrame([("1", "91", "10", "20240101"), ("2", "abc", "-181", "bad"), ("3", "45.5", None, "20240229")], "id string, ActionGeo_Lat string, ActionGeo_Long string, SQLDATE string")
    got = {r.id: r for r in exports.cleaned(rows).collect()}
    assert (got["1"].ActionGeo_Lat, got["1"].ActionGeo_Long) == (0.0, 10.0) and got["2"].SQLDATE is None
    assert got["3"].ActionGeo_Point_WKT == "POINT(45.5 0.0)" and got["3"].SQLDATE == date(2024, 2, 29)


def test_ledger(spark):
    files = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "name string, mtime long, size long")
    first = exports.new_files(files, spark.createDataFrame([], "signature string"))
    assert first.count() == 2
    assert exports.new_files(files, first.where("name = 'a'")).select("name").first()[0] == "b"


def test_append_and_report(spark, tmp_path):
    events = spark.createDataFrame([(1, date(2024, 1, 31)), (2, date(2024, 2, 1))], "GlobalEventID long, SQLDATE date")
    exports.append(events, str(tmp_path / "t"), 1)
    exports.append(events, str(tmp_path / "t"), 1)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 4 and {r.month for r in back.collect()} == {202401, 202402}
    exports.export_report(events, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2


def stream(spark, tmp_path, transform, mode, name):
    query = transform(V.read_batches(spark, str(tmp_path), 1)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def batches(tmp_path):
    for k in range(4):
        rows = [line(10 * k + i, added=f"2024010910{15 * k:02d}{i:02d}", GoldsteinScale="-7" if i % 2 else "3") for i in range(5)]
        rows += [line(10 * (k - 1), added=f"2024010910{15 * k:02d}59")] if k else []
        (tmp_path / f"2024010910{15 * k:02d}00.export.CSV").write_text("\n".join(rows))


def test_streamed_counts_are_the_batch_ones(spark, tmp_path):
    batches(tmp_path)
    want = {(r.start, r.n, r.conflicts) for r in V.counts_by_window(exports.read_exports(spark, [str(tmp_path)])).collect()}
    got = {(r.start, r.n, r.conflicts) for r in stream(spark, tmp_path, V.counts_by_window, "complete", "counts").collect()}
    assert got == want and len(got) == 4


def test_first_only(spark, tmp_path):
    batches(tmp_path)
    ids = [r.GlobalEventID for r in stream(spark, tmp_path, V.first_only, "append", "firsts").collect()]
    assert sorted(ids) == sorted(10 * k + i for k in range(4) for i in range(5))


def test_enriched_stream(spark, tmp_path):
    batches(tmp_path)
    assert stream(spark, tmp_path, V.enriched, "append", "prints").where("fingerprint LIKE 'US-20240109-UNK-APPEAL-%'").count() == 23


def test_refreshed_days(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches(tmp_path / "in")
    events = exports.read_exports(spark, [str(tmp_path / "in")])
    daily = lambda e: e.groupBy(F.col("SQLDATE").alias("date")).agg(F.count("*").alias("n"))
    run = V.refresh_days(events, str(tmp_path / "t"), daily)
    run(events.limit(3), 0)
    run(events.limit(3), 1)
    assert [(r.date, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [(date(2024, 1, 9), 23)]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    once = R.upsert(old, new, ["k"])
    assert {tuple(r) for r in R.upsert(once, new, ["k"]).collect()} == {tuple(r) for r in once.collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_the_ledger_records_rows(spark, tmp_path):
    batches(tmp_path)
    names = sorted(p.name for p in tmp_path.glob("*.CSV"))
    files = spark.createDataFrame([(n, 1, 2) for n in names] + [("absent", 1, 2)], "name string, mtime long, size long")
    exports.record_files(files, exports.read_exports(spark, [str(tmp_path)]), f"file://{tmp_path}/ledger")
    ledger = spark.read.parquet(f"file://{tmp_path}/ledger")
    assert {r.name: r.n_rows for r in ledger.collect()} == {**dict(zip(names, [5, 6, 6, 6])), "absent": 0}
    more = files.union(spark.createDataFrame([("late", 1, 2)], files.schema))
    assert [r.name for r in exports.new_files(more, ledger).collect()] == ["late"]
