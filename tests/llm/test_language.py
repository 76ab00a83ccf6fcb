"""Operators 4 and 7: held-out accuracy, and code lengths and probabilities against direct computation."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsgrid.llm import language_model as lm
from newsgrid.llm.language_id import ContextTrees, _fold, _Scorer, identify, keep_known, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, language string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1, "clash", "clash") for i, t, g in rows], SCHEMA)


def bits(texts, text, order):
    """Code length of text after counting texts, by the definition."""
    pad = "\n" * order
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        t = pad + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[k][t[i - k : i], t[i]] += 1
    out = 0.0
    t = pad + text
    for i in range(order, len(t)):
        for k in range(order, -1, -1):
            own = {s: n for (c, s), n in counts[k].items() if c == t[i - k : i]}
            if own:
                whole = sum(own.values()) + len(own)
                if t[i] in own:
                    out -= math.log2(own[t[i]] / whole)
                    break
                out -= math.log2(len(own) / whole)
        else:
            out += 8
    return out


def test_code_lengths(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("banana band", "x"), ("bandana", "x"), ("cabbage", "y"), ("abacus cab", "y")] * 2)]
    docs = frame(spark, rows)
    trees = train(docs, order=3, folds=1000)
    assert trees.languages == ["x", "y"]
    texts = ["banana", "abba zebra", "c"]
    got = _Scorer(trees).lengths([_fold(t) for t in texts], group=4)
    for n, t in enumerate(texts):
        for l, g in enumerate("xy"):
            assert got[n, l] == pytest.approx(bits([x for _, x, h in rows if h == g], t, 3)), (t, g)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in identify(docs, train(docs)).collect()}
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(want) and all(got[i].held_out == (i in set(held)) for i in want)
    assert sum(got[i].lang_pred == want[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_texts_and_no_training(spark):
    rows = [(0, None, "en"), (1, "", "en"), (2, "12 34 !", None), (3, "the cat", "en"), (3, "the cat", "en"), (4, "le chat", "fr"), (None, "the", None), (6, "the " * 2000, "en"), (7, "un chat", "fr")]
    got = identify(frame(spark, rows), train(frame(spark, rows), folds=1000)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (0, 1, 2, 3, 4, 6)} == {0: "und", 1: "und", 2: "und", 3: "en", 4: "fr", 6: "en"}
    assert {r.lang_pred for r in identify(frame(spark, rows), ContextTrees(3, [], pd.DataFrame({"language": [], "gram": [], "n": []}))).collect()} == {"und"}
    assert identify(frame(spark, rows).limit(0), train(frame(spark, rows).limit(0))).count() == 0
    kept = keep_known(frame(spark, rows), folds=1000)
    assert kept.columns == frame(spark, rows).columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [3, 3, 4, 6, 7]


def test_base_scores_and_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    toks = {i: lm.tokens(t) for i, t in texts.items()}
    trained = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in trained for w in toks[i])
    n, v = sum(counts.values()), len(counts)
    model = lm.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 10 != 0), tokens_in_shard=5000)
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    assert len(got) == len(texts) and model.shards > 3
    for i, ws in toks.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in counts for w in ws), n, i not in trained)
        assert r.base_score == pytest.approx(base, abs=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    """Over all words, the unseen one included, after each context; and each is the formula's."""
    rng = np.random.default_rng(9)
    sentences = [" ".join(rng.choice(list("abcdefgh"), int(n), p=[0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) for n in rng.integers(1, 12, 60)]
    docs = frame(spark, [(i, s, None) for i, s in enumerate(sentences)])
    model = lm.train(docs, tokens_in_shard=40)
    pairs = Counter()
    for s in sentences:
        before = None
        for w in lm.tokens(s):
            pairs[before, w] += 1
            before = w
    words = sorted({w for _, w in pairs})
    scorer = lm.Scorer(model)
    of_counts = Counter(pairs.values())
    d = [0.0, *lm._discounts(*(of_counts[k] for k in (1, 2, 3, 4)))]
    follow = Counter(w for _, w in pairs)
    of_follow = Counter(follow.values())
    low = [0.0, *lm._discounts(*(of_follow[k] for k in (1, 2, 3, 4)))]
    rest = sum(low[min(c, 3)] for c in follow.values()) / len(pairs) / (len(follow) + 1)

    def p(before, w):
        lower = (follow[w] - low[min(follow[w], 3)]) / len(pairs) + rest
        own = {x: c for (b, x), c in pairs.items() if b == before}
        total = sum(own.values())
        if not total:
            return lower
        c = own.get(w, 0)
        return (c - d[min(c, 3)]) / total + sum(d[min(x, 3)] for x in own.values()) / total * lower

    for before in [None, *words[:4], b"never"]:
        total = 0.0
        for w in [*words, b"unseen"]:
            sentence = [w] if before is None else [before, w]
            _, _, whole = scorer.score(sentence, np.array([len(sentence)]))
            first = 0.0 if before is None else scorer.score([before], np.array([1]))[2][0]
            own = 10 ** (whole[0] - first)
            assert own == pytest.approx(p(before, w), rel=1e-9), (before, w)
            total += own
        assert total == pytest.approx(1, abs=1e-9)


def test_odd_texts_of_the_model(spark):
    rows = [(1, None, None), (2, "", None), (3, "A b\x0bC", None), (None, "a", None), (3, "A b\x0bC", None), (4, "z " * 50000, None)]
    model = lm.train(frame(spark, rows[:3]))
    got = {(r.doc_id, r.n_tokens, r.n_known) for r in lm.score(frame(spark, rows), model).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 4, 4), (None, 2, 2), (4, 50001, 1)}
    empty = lm.train(frame(spark, rows).limit(0))
    scores = lm.score(frame(spark, rows), empty).collect()
    assert {(r.train_tokens, r.base_score, r.score) for r in scores} == {(0, 0.0, 0.0)}


def test_unknown_languages_go(spark):
    from newsgrid.llm.language_id import keep_known

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    other = "这是一段没有人学过的语言写成的文字，用来看看模型会不会把它留下。" * 10
    planted = spark.createDataFrame([(900001, other, None), (900002, "ok", None), (900003, None, None)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in keep_known(docs.unionByName(planted)).collect()}
    clean = {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}
    assert 900001 not in kept and 900003 not in kept and clean <= kept
