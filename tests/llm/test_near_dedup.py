"""Operator 1: alignment against dynamic programming, candidates against all pairs."""

import numpy as np
import pytest

from newsgrid.llm.near_dedup import banded_distance, edit_similar, keep_first, labelled_kmers, near_duplicates, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bands string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash") for i, t in rows], SCHEMA)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance():
    rng = np.random.default_rng(2)
    for _ in range(1500):
        a = rng.integers(0, 4, rng.integers(0, 14)).tolist()
        b = rng.integers(0, 4, rng.integers(0, 14)).tolist() if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        d = distance(a, b)
        for most in (0, 1, 2, 3, 5, 9, 20):
            assert banded_distance(a, b, most) == min(d, most + 1), (a, b, most)


def test_edit_similar():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = [f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 120))]
        b = [x for x in a if rng.random() > 0.12]
        for _ in range(rng.integers(0, 9)):
            b.insert(int(rng.integers(0, len(b) + 1)), "new")
        longer = max(len(a), len(b))
        assert edit_similar(a, b, 0.8) == (distance(a, b) <= int(0.2 * longer + 1e-9))


def test_occurrences_are_labelled():
    same = labelled_kmers(np.array([7] * 9, np.uint64), 5)
    assert len(same) == len(set(same.tolist())) == 5


def corpus():
    rng = np.random.default_rng(8)
    vocab = [f"word{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocab, 150)) for _ in range(60)]

    def edited(t, n):
        w = t.split(" ")
        for _ in range(n):
            w[int(rng.integers(0, len(w)))] = "changed" + str(rng.integers(0, 99))
        return " ".join(w)

    rows = list(enumerate(texts))
    rows += [(100 + i, edited(texts[0], 3)) for i in range(40)]  # a large group of near copies
    rows += [(200 + i, texts[1]) for i in range(20)]  # exact copies
    rows += [(300 + i, edited(texts[2 + i], 2).upper()) for i in range(10)]
    passage = " ".join(rng.choice(vocab, 60))
    rows += [(400 + i, passage + " " + " ".join(rng.choice(vocab, 120))) for i in range(30)]  # they share a passage only
    return rows


def test_groups(spark):
    rows = corpus()
    got = {r.doc_id: r for r in near_duplicates(frame(spark, rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    want = {i: i for i, _ in rows}
    want |= {100 + i: 0 for i in range(40)} | {200 + i: 1 for i in range(20)} | {300 + i: 2 + i for i in range(10)}
    words = {i: words_of(t) for i, t in rows}
    for i, r in got.items():
        assert r.component_id == want[i] and r.kept == (want[i] == i), i
        assert i == want[i] or edit_similar(words[i], words[want[i]], 0.8)


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "..."), (6, "!!!"), (7, "one two"), (8, "one two"), (9, "ONE, two!"), (None, "one two"), (7, "one two"), (10, "a " * 30000), (11, "a " * 29990)]
    got = near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7), (8, 7), (9, 7), (None, None), (10, 10), (11, 10)}
    assert near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = corpus()
    out = keep_first(frame(spark, [*rows, (0, rows[0][1]), (None, "x"), (None, "x")]))
    assert out.columns == frame(spark, rows).columns
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert ids == [*range(60), *range(400, 430)]
    assert out.where("doc_id is null").count() == 2


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_recall_on_the_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    words = {r.doc_id: words_of(r.text) for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    low = {i: i for i in words}
    ids = sorted(words)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if low[j] == j and 0.8 <= (len(words[i]) + 1) / (len(words[j]) + 1) <= 1.25 and edit_similar(words[i], words[j], 0.8):
                low[j] = low[i]
    pairs = [j for j in ids if low[j] != j]
    assert sum(got[j] == got[low[j]] for j in pairs) >= 0.9 * len(pairs)
    assert all(got[j] == j for j in ids if low[j] == j)
