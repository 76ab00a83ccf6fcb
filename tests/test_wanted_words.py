"""Lists of nearest texts that hold wanted words only, where few words are known to all tasks."""

import random

import pytest

from newsgrid.operators import nearest_texts as N


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = [(i, " ".join(r.choice(["the"] * 9 + [f"w{j}" for j in range(60)]) for _ in range(r.randint(1, 30)))) for i in range(120)]
    return [*texts, (7, "W1 once more, w1"), (7, None), (500, None), (501, "?!"), (None, "w2")]


@pytest.mark.parametrize("frequent", [1, 8, 1000])
def test_wanted_words_weigh_as_in_full_lists(spark, rows, frequent):
    texts = spark.createDataFrame(rows, "id long, text string")
    wanted = N.words(spark.createDataFrame([("The W1 w3",), ("w3 absent",)], "text string"))
    assert sorted(r.term for r in wanted.collect()) == ["absent", "the", "w1", "w3"]
    full, stats = N.lists(texts)
    some, few = N.lists(texts, wanted=wanted, frequent=frequent)
    of = lambda df: sorted(map(tuple, df.where("term IN ('the', 'w1', 'w3')").collect()))
    assert sorted(map(tuple, some.collect())) == of(full) and sorted(map(tuple, few.collect())) == of(stats)
