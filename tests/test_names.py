"""Spellings that mean one place, and their join plan."""

from newsgrid.operators import names as N

PLACES = ["Mérida, YucatáMX, Mexico", "MERIDA, yucatan, MX", "Toluca, Méco, Mexico", "Austin, Texas, US", "austin,  TÉXAS , US", "Texas", None, "", "a, , b", "Z, Queréro de Arteaga, Mexico"]


def places(spark):
    return spark.createDataFrame([(i, p) for i, p in enumerate(PLACES)], "GlobalEventID long, ActionGeo_FullName string")


def terms(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "term string")


def found(spark, *names):
    rows = N.stored_spellings(terms(spark, *names), places(spark)).collect()
    assert len(rows) == len(set(rows))
    return {n: {r.spelling for r in rows if r.term == n} for n in names}


def test_case_accents_and_damage(spark):
    assert found(spark, "YUCATAN", "yucatán", "Yucatan") == {n: {"YucatáMX", "yucatan"} for n in ("YUCATAN", "yucatán", "Yucatan")}
    assert found(spark, "téxas") == {"téxas": {"Texas", "TÉXAS"}}
    assert found(spark, "queretaro", "QUERÉTARO DE ARTEAGA") == {n: {"Queréro de Arteaga"} for n in ("queretaro", "QUERÉTARO DE ARTEAGA")}
    assert found(spark, "estado de mexico") == {"estado de mexico": {"Méco"}}


def test_country_bare_words_and_unknown_names_mean_no_division(spark):
    assert found(spark, "Mexico", "Estado", "Nowhere", "", "  ") == {n: set() for n in ("Mexico", "Estado", "Nowhere", "", "  ")}
    assert N.stored_spellings(terms(spark, None, None), places(spark)).isEmpty()
    assert N.stored_spellings(terms(spark, "Texas"), places(spark).limit(0)).isEmpty()


def test_repeated_terms_and_events(spark):
    rows = N.events_named(terms(spark, "texas", "texas", "Yucatan"), places(spark)).collect()
    assert sorted((r.term, r.GlobalEventID) for r in rows) == [("Yucatan", 0), ("Yucatan", 1), ("texas", 3), ("texas", 4)]


def test_events_meet_spellings_without_collation(spark):
    plan = N.events_named(terms(spark, "texas"), places(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_divisions_are_merged(spark):
    got = {r.name: (r.spellings, r.events) for r in N.merged_divisions(places(spark)).collect()}
    # of equally frequent spellings the smallest
    assert got == {"Yucatán": (2, 2), "Texas": (2, 2), "Estado de México": (1, 1), "Querétaro de Arteaga": (1, 1)}
