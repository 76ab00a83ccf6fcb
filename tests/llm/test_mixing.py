"""Operator 6 against its definition."""

import re

import numpy as np
import pytest

from newsgrid.llm.mixing import mix, take_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "clash", "clash") for i, t, s in rows], SCHEMA)


def targets(sizes):
    """By source, from its definition: weights 3, 1, 2 by code point, null last; capped at twice the size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        unit = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * unit > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over


def check(rows, got, slack=0.02):
    assert len(got) == len(rows)
    size_of = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    source_of, sums = {i: s for i, _, s in rows}, {}
    for i, _, s in rows:
        sums[s] = sums.get(s, 0) + size_of[i]
    want, taken = targets(sums), dict.fromkeys(sums, 0)
    for r in got:
        s = source_of[r.doc_id]
        assert (r.size, r.source_size, r.source) == (size_of[r.doc_id], sums[s], s)
        assert r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size and 0 <= r.rate <= 2
        taken[s] += r.taken
    for s in sums:
        assert abs(taken[s] - want[s]) <= max(slack * want[s], 20), s


def test_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    first = mix(docs)
    check(rows, first.collect(), slack=0.05)
    again = {(r.doc_id, r.copies) for r in mix(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.copies) for r in first.collect()}


def test_hot_source_long_texts_and_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(n), "hot" if i % 3 else f"s{i % 7}") for i, n in enumerate(rng.lognormal(3, 1.5, 600))]
    rows += [(1000, None, "hot"), (1001, "", None), (1002, "a\tb\x0bc d e", None), (1003, "x " * 20000, "s1"), (1004, " \n", "empty")]
    check(rows, mix(frame(spark, rows)).collect())


def test_tilt_is_exponential(spark):
    rows = [(i, "w " * (1 + i % 40), "abc"[i % 3]) for i in range(600)]
    got = mix(frame(spark, rows)).collect()
    for s in "abc":
        odds = sorted({(r.size, round(float(np.log(r.rate / (2 - r.rate))), 9)) for r in got if r.source == s and 0 < r.rate < 2})
        if len(odds) > 2:
            slopes = {round((b[1] - a[1]) / (b[0] - a[0]), 6) for a, b in zip(odds, odds[1:])}
            assert len(slopes) == 1
            assert sum(r.rate * r.size for r in got if r.source == s) == pytest.approx(next(r.target for r in got if r.source == s), rel=1e-6)


def test_empty_table_and_empty_texts(spark):
    assert mix(frame(spark, [(1, "a", "s")]).limit(0)).count() == 0
    got = mix(frame(spark, [(1, "", "s"), (2, None, None)])).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_rows_are_taken_as_often_as_said(spark):
    rows = [(i, f"w{i} " * (i % 30), "ab"[i % 2]) for i in range(200)]
    docs = frame(spark, rows)
    copies = {r.doc_id: r.copies for r in mix(docs).collect()}
    out = take_mix(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in copies.items() if c}
