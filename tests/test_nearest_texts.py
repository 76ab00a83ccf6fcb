"""Nearest texts by words against brute force."""

import math
import random
import re

import pytest

from newsgrid.operators import nearest_texts as N


@pytest.fixture(scope="module")
def case():
    r = random.Random(12)
    vocabulary = ["the"] * 30 + ["in", "of"] * 10 + [f"w{i}" for i in range(80)]
    texts = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40)))) for i in range(250)]
    texts += [(1000 + i, "The same words, w1 w2!") for i in range(12)] + [(2000, None), (2001, "..."), (None, "w1"), (2002, "only_here")]
    queries = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 6)))) for i in range(40)]
    return texts, [*queries, (100, "the"), (101, "absent words w3"), (102, None), (103, "absent"), (104, "only here"), (105, "w1 w2 w1 the same")]


def brute(texts, queries, k):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    own = {i: words(t) for i, t in texts if i is not None and words(t)}
    df = {}
    for t in own.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1

    def vector(t):
        raw = {w: math.floor(1000 * (1 + math.log(t.count(w))) * math.log(1 + len(own) / df[w]) + 0.5) for w in set(t) if w in df}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: math.floor(N.UNIT * x / norm) for w, x in raw.items()}

    vectors, out = {i: vector(t) for i, t in own.items()}, []
    for q, text in queries:
        v = vector(words(text))
        scores = {i: sum(x * y[w] for w, x in v.items() if w in y) for i, y in vectors.items()}
        best = sorted((-s, i) for i, s in scores.items() if s > 0)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_every_nearest_text_is_found(spark, case, k):
    texts, queries = case
    weights, stats = N.lists(spark.createDataFrame(texts, "id long, text string"))
    got = N.nearest_texts(spark.createDataFrame(queries, "query_id long, text string"), weights, stats, k)
    assert sorted(map(tuple, got.collect())) == brute(texts, queries, k)


def test_nothing(spark, case):
    texts, queries = spark.createDataFrame(case[0], "id long, text string"), spark.createDataFrame(case[1], "query_id long, text string")
    for t, q in ((texts.limit(0), queries), (texts, queries.limit(0))):
        assert N.nearest_texts(q, *N.lists(t), 3).count() == 0
