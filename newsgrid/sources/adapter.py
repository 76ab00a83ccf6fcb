"""Event records, daily series, packed rows and mentions derived from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrid.sources.stored import of_rows

#: Both engines run this text; table names are filled in.
FACT = """WITH raw AS (
  SELECT e.event_id, e.ts, e.user_id, e.value, CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) AS k,
         n.n_nationkey, n.n_name, r.r_name, p.url
  FROM {events} e
  LEFT JOIN {customer} c ON c.c_custkey = e.user_id
  LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN {region} r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN {pages} p ON p.page_id = e.event_id % 100
), fact AS (
  SELECT event_id AS GlobalEventID, CAST(ts AS DATE) AS SQLDATE, ts AS DATEADDED,
    CASE WHEN k % 11 = 0 THEN NULL ELSE 'ACTOR ' || CAST(user_id % 20 AS STRING) END AS Actor1Name,
    'C' || lpad(CAST(n_nationkey % 7 AS STRING), 2, '0') AS Actor1CountryCode,
    CASE WHEN k % 5 = 0 THEN NULL ELSE 'ACTOR ' || CAST(k % 20 AS STRING) END AS Actor2Name,
    'C' || lpad(CAST(k % 7 AS STRING), 2, '0') AS Actor2CountryCode,
    lpad(CAST(k % 20 + 1 AS STRING), 2, '0') || CAST(event_id % 4 AS STRING) AS EventCode,
    lpad(CAST(k % 20 + 1 AS STRING), 2, '0') AS EventRootCode,
    CAST(FLOOR(k % 20 / 5) AS INT) + 1 AS QuadClass,
    CAST((event_id * 7 + k) % 201 - 100 AS DOUBLE) / 10 AS GoldsteinScale,
    CAST((event_id * 13 + k * 3) % 201 - 100 AS DOUBLE) / 10 AS AvgTone,
    CAST(FLOOR(value) AS INT) AS NumArticles, CAST(FLOOR(value) + k AS INT) AS NumMentions, CAST(k % 5 + 1 AS INT) AS NumSources,
    CASE WHEN k % 10 = 0 THEN 1 WHEN k % 10 < 4 THEN 2 ELSE 3 END AS ActionGeo_Type,
    CASE WHEN k % 10 = 0 THEN r_name WHEN k % 10 < 4 THEN n_name || ', ' || r_name
         ELSE 'CITY ' || CAST(user_id % 7 AS STRING) || ', ' || n_name || ', ' || r_name END AS ActionGeo_FullName,
    substr(r_name, 1, 2) AS ActionGeo_CountryCode,
    CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(user_id * 37 % 1700 - 850 AS DOUBLE) / 10 END AS ActionGeo_Lat,
    CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(user_id * 53 % 3500 - 1750 AS DOUBLE) / 10 END AS ActionGeo_Long,
    url AS SOURCEURL
  FROM raw
)"""
TABLES = ("events", "customer", "nation", "region", "pages")

PACKED = """, packed AS (
  SELECT SQLDATE AS event_day,
    'T' || CAST(NumSources AS STRING) || ',1;T' || CAST(GlobalEventID % 7 AS STRING) || ',2' AS V2Themes,
    COALESCE(Actor1Name, '') || ',1;' || COALESCE(Actor2Name, '') || ',2' AS V2Persons,
    COALESCE(ActionGeo_FullName, '') AS V2Organizations, CAST(AvgTone AS STRING) || ',0,0' AS V2Tone
  FROM fact
)"""

#: DuckDB's text; mentions() below has the same rows by an equality join.
MENTIONS = """, mentions AS (
  SELECT f.GlobalEventID AS GLOBALEVENTID, regexp_extract(p.url, 'https?://([^/]+)', 1) AS MentionSourceName,
    p.url AS MentionIdentifier, f.SQLDATE AS event_day
  FROM fact f JOIN {pages} p ON p.page_id IN (f.GlobalEventID % 100, f.GlobalEventID * 3 % 100, f.GlobalEventID * 7 % 100)
)"""

SERIES = """SELECT 'priority:' || o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS event_date, COUNT(*) AS total_events,
  SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS conflict_events,
  SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS cooperation_events,
  SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS protest_events,
  ROUND(AVG(o_totalprice) / 100000, 4) AS avg_goldstein, ROUND(-AVG(o_totalprice) / 100000, 4) AS avg_tone,
  SUM(o_custkey % 10) AS total_articles
FROM {orders} GROUP BY 1, 2"""


def _tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    out = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    if "customer" in out:
        # the one table beside events that grows without bound; its rows are counted from the files' footers
        out["customer"] = of_rows(out["customer"], out["customer"].count())
    return out


#: Folders whose event records have been written with store_fact, and where to.
STORED: dict[str, str] = {}


def store_fact(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the event records of a folder once, sorted by day within files; from then on queries of this process read them."""
    fact(spark, sf_dir).sortWithinPartitions("SQLDATE").write.mode("overwrite").parquet(path)
    STORED[sf_dir] = path


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    if sf_dir in STORED:
        return spark.read.parquet(STORED[sf_dir])
    return spark.sql(FACT + " SELECT * FROM fact", **_tables(spark, sf_dir, TABLES))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FACT + PACKED + " SELECT * FROM packed", **_tables(spark, sf_dir, TABLES))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages each event names. An event lists its page ids, each once, and meets pages by equality: an IN over pages would
    compare every event with every page. Lists hold ids below a hundred in size: only pages with such ids are broadcast."""
    e = F.col("GlobalEventID")
    events = fact(spark, sf_dir).select(e.alias("GLOBALEVENTID"), F.col("SQLDATE").alias("event_day"), F.explode(F.array_distinct(F.array(e % 100, e * 3 % 100, e * 7 % 100))).alias("page_id"))
    pages = _tables(spark, sf_dir, ("pages",))["pages"].where(F.col("page_id").between(-99, 99))
    met = events.join(F.broadcast(pages.select("page_id", "url")), "page_id")
    return met.select("GLOBALEVENTID", F.regexp_extract("url", "https?://([^/]+)", 1).alias("MentionSourceName"), F.col("url").alias("MentionIdentifier"), "event_day")


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SERIES, **_tables(spark, sf_dir, ("orders",)))
