"""Raw export files: schema, scan, cleaning, batch calendar and import ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values. Fields of an export line, their number, and the positions (from 0) of those that are kept.
N_FIELDS = 61
POSITIONS = {
    "GlobalEventID": 0,
    "SQLDATE": 1,
    "MonthYear": 2,
    "Actor1Name": 6,
    "Actor1CountryCode": 7,
    "Actor1Type1Code": 12,
    "Actor2Name": 16,
    "Actor2CountryCode": 17,
    "Actor2Type1Code": 22,
    "EventCode": 26,
    "EventRootCode": 28,
    "QuadClass": 29,
    "GoldsteinScale": 30,
    "NumMentions": 31,
    "NumSources": 32,
    "NumArticles": 33,
    "AvgTone": 34,
    "ActionGeo_Type": 51,
    "ActionGeo_FullName": 52,
    "ActionGeo_CountryCode": 53,
    "ActionGeo_Lat": 56,
    "ActionGeo_Long": 57,
    "DATEADDED": 59,
    "SOURCEURL": 60,
}
_KINDS = {"GlobalEventID": "bigint", "MonthYear": "int", "QuadClass": "int", "NumMentions": "int", "NumSources": "int", "NumArticles": "int", "ActionGeo_Type": "int", "GoldsteinScale": "double", "AvgTone": "double", "ActionGeo_Lat": "double", "ActionGeo_Long": "double"}

#: One more field than a line has, so that longer lines can be told.
SCHEMA = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(N_FIELDS + 1)])


def parsed(lines: DataFrame) -> DataFrame:
    """Kept columns, typed, of lines (value): lines with another number of fields are dropped, empty numbers are null. Other
    columns of lines stay."""
    others = [c for c in lines.columns if c != "value"]
    fields = lines.select(F.split("value", "\t", -1).alias("f"), *others).where(F.size("f") == N_FIELDS)

    def column(name: str, i: int) -> Column:
        raw = F.col("f")[i]
        if name == "SQLDATE":
            return F.to_date(F.expr(f"try_to_timestamp(f[{i}], 'yyyyMMdd')"))
        if name == "DATEADDED":
            return F.expr(f"try_to_timestamp(f[{i}], 'yyyyMMddHHmmss')")
        return F.expr(f"try_cast(nullif(f[{i}], '') AS {_KINDS[name]})") if name in _KINDS else raw

    return fields.select(*(column(n, i).alias(n) for n, i in POSITIONS.items()), *others)


def read_exports(spark: SparkSession, paths: list[str], countries: list[str] | None = None) -> DataFrame:
    """Events of headerless tab-separated files, of one or several streams, with the file each row came from."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file"))
    events = parsed(lines)
    return events if countries is None else events.where(F.col("ActionGeo_CountryCode").isin(countries))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header; all columns as text, so that codes keep their zeros, then cleaned."""
    return cleaned(spark.read.option("header", True).csv(path))


def cleaned(rows: DataFrame) -> DataFrame:
    """Coordinates: text or out of range becomes unknown, which is (0, 0); dates from yyyyMMdd; a WKT point."""
    lat, long = F.expr("try_cast(ActionGeo_Lat AS double)"), F.expr("try_cast(ActionGeo_Long AS double)")
    known = rows.withColumns({"ActionGeo_Lat": F.coalesce(F.when(lat.between(-90, 90), lat), F.lit(0.0)), "ActionGeo_Long": F.coalesce(F.when(long.between(-180, 180), long), F.lit(0.0))})
    point = F.concat(F.lit("POINT("), F.col("ActionGeo_Lat").cast("string"), F.lit(" "), F.col("ActionGeo_Long").cast("string"), F.lit(")"))
    return known.withColumns({"SQLDATE": F.to_date(F.expr("try_to_timestamp(cast(SQLDATE AS string), 'yyyyMMdd')")), "ActionGeo_Point_WKT": point})


def batch_stamps(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(stamp) of the 15-minute batches from start, aligned down, to end."""
    first = f"to_timestamp_ntz('{start}') - make_dt_interval(0, 0, minute(to_timestamp_ntz('{start}')) % 15, second(to_timestamp_ntz('{start}')))"
    return spark.sql(f"SELECT date_format(t, 'yyyyMMddHHmmss') AS stamp FROM (SELECT explode(sequence({first}, to_timestamp_ntz('{end}'), INTERVAL 15 MINUTES)) AS t)")


def stamps_between(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """(stamp) of the 15-minute batches of ranges (start, end: timestamps), both aligned down, each once."""
    aligned = lambda c: F.timestamp_seconds(F.floor(F.unix_timestamp(c) / 900) * 900)
    times = F.sequence(aligned(start), aligned(end), F.expr("INTERVAL 15 MINUTES"))
    return ranges.select(F.explode(times).alias("t")).select(F.date_format("t", "yyyyMMddHHmmss").alias("stamp")).distinct()


def _signature() -> Column:
    return F.md5(F.concat_ws("|", "name", F.col("mtime").cast("string"), F.col("size").cast("string"))).alias("signature")


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files (name, mtime, size) whose signature the ledger (signature) does not have."""
    return files.select("*", _signature()).join(ledger.select("signature"), "signature", "left_anti")


def record_files(loaded: DataFrame, rows: DataFrame, path: str) -> None:
    """Add to the ledger at path one row for each loaded file (name, mtime, size): its signature, name, the number of rows
    that came from it (rows: read_exports, with file), and when. Files without rows are recorded, too."""
    counts = rows.groupBy(F.col("file").alias("name")).agg(F.count("*").alias("n_rows"))
    entries = loaded.select("*", _signature()).join(counts, "name", "left")
    entries.select("signature", "name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.current_timestamp().alias("loaded_at")).write.mode("append").parquet(path)


def period(events: DataFrame, start: str, end: str, added_until: str) -> DataFrame:
    """Rows of event days start to end that were added by the end of added_until: late ones included."""
    return events.where(F.col("SQLDATE").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.to_date("DATEADDED") <= F.lit(added_until).cast("date")))


def append(events: DataFrame, path: str, rows_in_file: int = 1_000_000) -> None:
    """Add rows to a table laid out by month, in files of at most rows_in_file rows."""
    events.withColumn("month", F.date_format("SQLDATE", "yyyyMM")).write.mode("append").option("maxRecordsPerFile", rows_in_file).partitionBy("month").parquet(path)


def export_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A result as CSV with a header, or as JSON lines."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
