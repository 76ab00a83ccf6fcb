"""Names under a collation, over divisions whose spellings vary by case, accents and known damage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgrid.functions import constants as K
from newsgrid.operators import names as N
from newsgrid.registry import query

_DAMAGED = list(K.DAMAGED_DIVISIONS)
_PAIRS = ", ".join(f"('{raw}', '{right}')" for raw, right in K.DAMAGED_DIVISIONS.items())
_RAW = ", ".join(f"'{raw}'" for raw in _DAMAGED)
#: Nations spelled in lower case with acute accents, in upper case, or as one of the damaged names, by id; the rest as given.
SPELLED = f""", spelled AS (SELECT f.GlobalEventID, CASE CAST(f.GlobalEventID % 4 AS INTEGER) WHEN 0 THEN f.ActionGeo_FullName WHEN 1 THEN translate(lower(f.ActionGeo_FullName), 'aeiou', 'áéíóú')
  WHEN 2 THEN upper(f.ActionGeo_FullName) ELSE 'CITY, ' || list_extract([{_RAW}], CAST(f.GlobalEventID // 4 % {len(_DAMAGED)} AS INTEGER) + 1) || ', MX' END AS place FROM fact f WHERE f.ActionGeo_FullName IS NOT NULL),
divided AS (SELECT GlobalEventID, trim(list_extract(string_split(place, ','), len(string_split(place, ',')) - 1)) AS spelling FROM spelled WHERE contains(place, ',')),
damage AS (SELECT * FROM (VALUES {_PAIRS}) d(raw, good)),
spellings AS (SELECT spelling, good, COUNT(*) AS n FROM divided LEFT JOIN damage ON raw = spelling WHERE spelling <> '' GROUP BY 1, 2),
called AS (SELECT spelling, lower(strip_accents(spelling)) AS key FROM spellings UNION SELECT spelling, lower(strip_accents(good)) FROM spellings WHERE good IS NOT NULL
  UNION SELECT spelling, lower(strip_accents(split_part(good, ' de ', 1))) FROM spellings WHERE good IS NOT NULL AND split_part(good, ' de ', 1) <> 'Estado'),
terms AS (SELECT DISTINCT lower(strip_accents(spelling)) AS term FROM spellings UNION SELECT lower(strip_accents(good)) FROM damage UNION SELECT upper(split_part(good, ' de ', 1)) FROM damage),
met AS (SELECT DISTINCT term, spelling FROM terms JOIN called ON lower(strip_accents(term)) = key)"""


def _spelled(fact: DataFrame) -> DataFrame:
    place, id_ = F.col("ActionGeo_FullName"), F.col("GlobalEventID")
    damaged = F.array(*(F.lit(raw) for raw in _DAMAGED))[F.pmod(F.floor(id_ / 4), F.lit(len(_DAMAGED))).cast("int")]
    kind = id_ % 4
    varied = F.when(kind == 0, place).when(kind == 1, F.translate(F.lower(place), "aeiou", "áéíóú")).when(kind == 2, F.upper(place)).otherwise(F.concat(F.lit("CITY, "), damaged, F.lit(", MX")))
    return fact.where(place.isNotNull()).select("GlobalEventID", varied.alias("ActionGeo_FullName"))


def _terms(spelled: DataFrame) -> DataFrame:
    """Every stored division in plain lower-case letters, and the right names of the damaged ones, whole and short."""
    plain = lambda c: F.translate(F.lower(c), "áéíóúñ", "aeioun")
    own = spelled.select(plain(N.raw_division(F.col("ActionGeo_FullName"))).alias("term"))
    right = spelled.sparkSession.createDataFrame([(name,) for name in K.DAMAGED_DIVISIONS.values()], "good string")
    return own.union(right.select(plain("good"))).union(right.select(F.upper(F.split_part("good", F.lit(" de "), F.lit(1)))))


@query("j11_stored_spellings", SPELLED + " SELECT term, spelling FROM met", "fact")
def _spellings(fact):
    rows = _spelled(fact)
    return N.stored_spellings(_terms(rows), rows)


@query("b04_events_by_any_spelling", SPELLED + " SELECT term, COUNT(*) AS events, min(GlobalEventID) AS first_id FROM met JOIN divided USING (spelling) GROUP BY 1", "fact")
def _events(fact):
    rows = _spelled(fact)
    return N.events_named(_terms(rows), rows).groupBy("term").agg(F.count("*").alias("events"), F.min("GlobalEventID").alias("first_id"))


@query(
    "j10_merged_divisions",
    SPELLED
    + """, good AS (SELECT coalesce(good, spelling) AS name, CAST(SUM(n) AS BIGINT) AS n, COUNT(*) AS k FROM spellings GROUP BY 1)
SELECT arg_min(name, (-n, name)) AS name, CAST(SUM(k) AS BIGINT) AS spellings, CAST(SUM(n) AS BIGINT) AS events FROM good GROUP BY lower(strip_accents(name))""",
    "fact",
)
def _merged(fact):
    return N.merged_divisions(_spelled(fact))
