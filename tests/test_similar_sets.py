"""The prefix-filtered join of sets, and relevance by themes and articles, against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from newsgrid.operators import events as E
from newsgrid.operators import scores as C
from newsgrid.operators import set_similarity as J


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    names = [f"n{i}" for i in range(40)]
    out = [(i, [r.choice(names[: r.choice([3, 10, 40])]) for _ in range(r.randint(0, 12))]) for i in range(400)]
    return out + [(1000 + i, ["n1", None, "n2"]) for i in range(30)] + [(None, ["n1"]), (2000, None), (2001, [None]), (2002, [])]


@pytest.mark.parametrize("least", [0.05, 0.15, 0.5, 0.8, 1.0])
def test_all_similar_sets_are_found(spark, rows, least):
    frame = spark.createDataFrame(rows, "id long, names array<string>")
    sets = J.distinct_sets(frame, "id", F.col("names"), F.col("id") % 5 == 0)
    got = {(r.query_set, r.other_set): (r.overlap, round(r.jaccard, 9)) for r in J.similar_sets(sets, least, salts=3).collect()}
    classes = {}
    for i, names in rows:
        key = frozenset(x for x in names or [] if x is not None)
        if i is not None and key:
            classes.setdefault(key, []).append(i)
    want = {}
    for q, ids in classes.items():
        if any(i % 5 == 0 for i in ids):
            for x, others in classes.items():
                if (q != x or len(ids) > 1) and len(q & x) / len(q | x) >= least - 1e-12:
                    want[min(ids), min(others)] = (len(q & x), round(len(q & x) / len(q | x), 9))
    assert got == want and len(want) > 10
    assert J.similar_sets(sets, least).count() == len(want)  # each pair once


def test_no_sets_and_no_threshold(spark, rows):
    frame = spark.createDataFrame(rows, "id long, names array<string>")
    assert J.similar_sets(J.distinct_sets(frame.limit(0), "id", F.col("names"), F.lit(True)), 0.5).count() == 0
    with pytest.raises(ValueError):
        J.similar_sets(frame, 0.0)


def test_prefixes_leave_frequent_names_out(spark):
    sets = spark.createDataFrame([(i, ["all", f"own{i}"], 1, 1) for i in range(20)], "set_id long, items array<string>, members long, queries long")
    assert all(r["items"][-1] == "all" for r in J.rare_first(sets).collect())


def test_terms_of_themes_and_articles(spark):
    day = datetime.date(2024, 1, 5)
    rows = [(0.5, 1, 1), (0.0, 0, 2), (None, None, None), (1.0, 9, 3), (0.0, 0, 5)]
    frame = spark.createDataFrame(rows, "theme_overlap double, shared_articles long, shared_sources long")
    import math

    want = [10 + 7 + 8 * math.log(2) / math.log(6), 2 + 6, 2 + 1, 20 + 15, 2 + 7]
    assert [r[0] for r in frame.select(C.context_relevance()).collect()] == pytest.approx(want)

    packed = spark.createDataFrame([(day, "T1,1;T2,5;T1,9", "A,1;B,2;A,7"), (day, "T3,1;,2", "A,1"), (day + datetime.timedelta(2), "T1,1", "A,4"), (day, "", "C,1")], "event_day date, V2Themes string, V2Persons string")
    sets = C.actor_themes(packed)
    assert {(r.actor, r.day.day): r.themes for r in sets.collect()} == {("A", 5): ["T1", "T2", "T3"], ("B", 5): ["T1", "T2"], ("A", 7): ["T1"]}
    assert [r.themes for r in C.actor_themes(packed, 1).where("actor = 'A' AND day = '2024-01-05'").collect()] == [["T1"]]
    seeds = spark.createDataFrame([("A", day), ("A", day), (None, day), ("Z", day)], "Actor1Name string, SQLDATE date")
    assert sorted((r.actor, r.day.day, r.theme_overlap) for r in C.theme_overlaps(sets, seeds, 2).collect()) == [("A", 5, 1.0), ("A", 7, 0.333)]
    assert [r.day.day for r in C.theme_overlaps(sets, seeds, 1).collect()] == [5]


def test_classes_of_articles(spark):
    mentions = [(1, "s", "u"), (1, "s", "v"), (2, "s", "v"), (2, "s", "u"), (2, "s", "u"), (3, "t", "v"), (4, "s", "u"), (4, "t", "v"), (None, "s", "u")]
    frame = spark.createDataFrame(mentions, "GLOBALEVENTID long, MentionSourceName string, MentionIdentifier string")
    of_event, pairs = E.article_classes(frame, spark.createDataFrame([(1,), (4,)], "GlobalEventID long"))
    classes = {r.GlobalEventID: r.articles for r in of_event.collect()}
    assert len(classes) == 4 and len(set(classes.values())) == 3 and classes[1] == classes[2]
    got = {(r.seed_articles, r.articles): (r.shared_articles, r.shared_sources) for r in pairs.collect()}
    one, three, four = classes[1], classes[3], classes[4]
    assert got == {(one, one): (2, 1), (one, four): (1, 1), (four, one): (1, 1), (four, three): (1, 1), (four, four): (2, 2)}


def test_items_beyond_the_masks(spark):
    """Sets of frequent items, which are bits, and of rare ones, which stay arrays: 300 items with ids, all pairs by force."""
    every = {i: {f"n{i % 300}", f"n{i * 7 % 300}", f"n{i * i % 300}", f"rare{i // 2}"} for i in range(600)}
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in every.items()], "id long, names array<string>")
    found = J.similar_sets(J.distinct_sets(frame, "id", F.col("names"), F.lit(True)), 0.15).collect()
    got = {(r.query_set, r.other_set): r.overlap for r in found}
    sets = {frozenset(s): i for i, s in reversed(every.items())}
    want = {(i, j): len(a & b) for a, i in sets.items() for b, j in sets.items() if i != j and len(a & b) >= 0.15 * len(a | b)}
    assert got == want and len(got) == len(found)


def test_pairs_are_compared_as_bits(spark):
    """Up to 252 items no arrays go through the join."""
    frame = spark.createDataFrame([(i, [f"n{i % 20}", f"n{i % 7}"]) for i in range(50)], "id long, names array<string>")
    sets = J.distinct_sets(frame, "id", F.col("names"), F.lit(True))
    assert "array_intersect(items" not in J.similar_sets(sets, 0.15)._jdf.queryExecution().optimizedPlan().toString()
