"""Names of a dictionary in texts against a search by plain Python."""

import random
import re

import pytest

from newsgrid.operators import places as P

NAMES = ["New York", "New York City", "York", "Ohio", "São Paulo", "O'Hare, Gate 1", "X_1", "X", " padded ", "(odd)", "ohio", "", None, "New", "a.b"]


def brute(text, names):
    low, best = (text or "").lower(), None
    for name in {n.strip() for n in names if n}:
        if re.match(r"\w", name) and re.match(r"\w", name[::-1]):
            found = re.search(rf"(?<!\w){re.escape(name.lower())}(?!\w)", low)
            if found and (best is None or (found.start(), -len(name), name) < best):
                best = (found.start(), -len(name), name)
    return best and best[2]


@pytest.fixture(scope="module")
def docs():
    r = random.Random(2)
    words = ["new", "New", "York", "City", "OHIO", "são", "SÃO", "Paulo", "O'Hare", "Gate", "1", "X_1", "x", "X_12", "padded", "(odd)", "a", "b", "Yorks", "newer"]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", ", ", ".", "-", "  "]) for _ in range(r.randint(0, 8))) for _ in range(400)]
    return list(enumerate([*texts, None, "", "...", "New York", "in New  York", "x" * 5000 + " Ohio"]))


def test_first_and_longest(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    names = spark.createDataFrame([(n, 1) for n in NAMES], "name string, at int")
    got = {r.id: r.place for r in P.first_place(frame, names).collect()}
    assert got == {i: brute(t, NAMES) for i, t in docs} and len({p for p in got.values()}) > 7


def test_no_names_and_no_texts(spark, docs):
    frame, names = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert {r.place for r in P.first_place(frame, names.limit(0)).collect()} == {None}
    assert P.first_place(frame.limit(0), names).count() == 0


def test_all_mentions(spark):
    frame = spark.createDataFrame([(1, "New York City, york")], "doc_id long, text string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert sorted((r.at, r.name) for r in P.mentions(frame, P.name_index(names)).collect()) == [(0, "New"), (0, "New York"), (0, "New York City"), (2, "York"), (6, "York")]
