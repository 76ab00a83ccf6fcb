"""Operator 13 against brute force over plain dictionaries."""

import math
import random
import re

import pytest

from newsgrid.llm.lexical_search import top_documents, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n long, terms string, item_id long"


def terms(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    number, words = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        ranked = []
        for i, t in own:
            m = 75 + (25 * len(t) * number) // words
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[w] + 1))) * ((1000000000 * t.count(w)) // (1000 * t.count(w) + 12 * m)) for w in terms(text) if w in t)
            if score > 0 and i is not None:
                ranked.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case():
    r = random.Random(4)
    words = ["Alpha", "beta", "İx", "ÉTÉ", "été", "x1", "y", "z", "日本", "w0", "w1", "w2", "w3", "w4", "common"]
    docs = [(i, " ,\n"[i % 3].join(r.choices(words, [1 + j for j in range(len(words))], k=r.randint(1, 12)))) for i in range(300)]
    docs += [(1000 + i, "common y z w1") for i in range(120)]  # one bag many times
    docs += [(2000 + i, f"z y w1 common{'!' * i}") for i in range(5)]  # the same bag, other texts
    docs += [(3000, None), (3001, ""), (3002, "... --"), (None, "alpha beta y"), (5, "common y"), (5, "common y"), (3003, "A" * 50 + " a_b\x00c")]
    items = [(1, "common y Z"), (2, "alpha Alpha BETA nothing"), (3, None), (4, ""), (5, "absent"), (None, "été ÉTÉ 日本"), (2, "w0"), (7, "a b c " + "a" * 50)]
    return docs, items


@pytest.mark.parametrize("slice_bytes", [1 << 22, 20])
def test_all_rows(spark, case, slice_bytes):
    docs, items = case
    frame = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in docs], DOCS).repartition(7)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score long")
    got = sorted((tuple(r) for r in top_documents(frame, asked, 20, slice_bytes).collect()), key=repr)
    assert got == brute(docs, items, 20)


def test_small_blocks_of_scores_and_small_k(spark, case, monkeypatch):
    from newsgrid.llm import lexical_search as L

    whole = L.best_of_classes
    monkeypatch.setattr(L, "best_of_classes", lambda c, i, w, k: whole(c, i, w, k, cells=30))
    docs, items = case
    frame = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in docs], DOCS)
    got = sorted((tuple(r) for r in L.top_documents(frame, spark.createDataFrame(items, "item_id long, text string"), 3).collect()), key=repr)
    assert got == brute(docs, items, 3)


def test_nothing(spark, case):
    docs = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in case[0]], DOCS)
    items = spark.createDataFrame(case[1], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text IS NULL"), items), (docs, items.where("text = ''"))):
        assert top_documents(d, i).count() == 0


def test_long_texts_are_counted_in_pieces():
    text = " ".join(random.Random(1).choices(["aa", "Bb", "c-d", "é"], k=5000)).encode()
    assert words_of(text, 100) == words_of(text) and words_of(b"x" * 1000, 10) == {b"x" * 1000: 1}
    assert sum(words_of(text).values()) == len(terms(text.decode()))
