"""Operator 12 against brute force; its bounds hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgrid.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, v string, near string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", "clash", 1) for i, v, label in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 20))
    out = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=20) * (0.3 if i % 3 else 1.0)], int(rng.integers(0, 3))) for i in range(260)]
    out += [(300 + i, out[1][1], i % 2) for i in range(60)]  # one vector many times, under two labels
    out += [(400, None, 1), (401, [], 1), (410, [float("nan")] * 20, 1), (420, [None] * 20, 1), (430, [1.0] * 20, None), (440, [0.0] * 20, 1), (450, [-1.0, 2.0], 2), (460, [1.0] * 20, 77)]
    return out


def brute(rows, step, positives, negatives, percent):
    good = [(i, v, k) for i, v, k in rows if i is not None and v and k is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = {i: np.floor(256 * np.array([*v, *[0.0] * (20 - len(v))])) for i, v, _ in good}
    label = {i: k for i, _, k in good}
    out = set()
    for a in (i for i in x if i % step == 0):
        score = {i: int(x[a] @ x[i]) for i in x if i != a}
        near = sorted((i for i in score if label[i] == label[a]), key=lambda i: (-score[i], i))[:positives]
        for p in near:
            far = [i for i in score if label[i] != label[a] and percent * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(sorted(far, key=lambda i: (-score[i], i))[:negatives])}
    return out


@pytest.mark.parametrize("sizes", [{}, {"rows_in_block": 9, "anchors_in_tile": 3, "tiles_in_task": 2, "blocks_in_task": 3, "n_pivots": 4}])
def test_against_brute_force(spark, rows, sizes):
    got = [tuple(r) for r in H.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, positives=4, negatives=3, **sizes).collect()]
    want = brute(rows, 10, 4, 3, 80)
    assert len(want) > 200 and set(got) == want and len(got) == len(want)


def test_few_and_none(spark, rows):
    assert H.mine(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert H.mine(frame(spark, rows), F.col("vec_id") < 0).count() == 0
    assert H.mine(frame(spark, [(0, [1.0], 1), (1, [1.0], 2)]), F.col("vec_id") == 0).count() == 0
    few = [(0, [1.0], 1), (1, [0.5], 1), (2, [0.5], 2), (2, [0.5], 2), (3, [0.41], 2), (4, [0.3], 2), (5, [-1.0], 1), (6, [-1.0], 2)]
    got = H.mine(frame(spark, few), F.col("vec_id") == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 2, 32768, 32768), (0, 1, 2, 3, 32768, 26624)]


@pytest.mark.parametrize("dim", [1, 3, 16, 37, 64])
def test_bounds_hold_at_every_level(dim):
    rng = np.random.default_rng(dim)
    x, y = np.floor(rng.normal(size=(40, dim)) * 200), np.floor(rng.normal(size=(60, dim)) * 200)
    y[:30] = x[:30] + rng.integers(-3, 3, size=(30, dim))
    exact, last = x @ y.T, None
    for (mean_x, dev_x), (mean_y, dev_y) in zip(H.summaries(x), H.summaries(y)):
        gap, reach = np.abs(exact - mean_x @ mean_y.T), dev_x @ dev_y.T + H._slack(x, y)
        assert (gap <= reach).all()
        assert last is None or (reach <= last + 1).all()
        last = reach


def test_rows_that_cannot_matter_are_not_scored():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(5, 64)) + 100)
    y = np.concatenate([x + 1, -x])
    left, scores = H.open_scores(x, H.summaries(x), y, H.summaries(y), lambda lower, upper: upper >= 0)
    assert left.tolist() == [0, 1, 2, 3, 4] and (scores == x @ y[:5].T).all()


def test_query(spark):
    import duckdb

    from newsgrid.llm.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = sorted(map(tuple, con.execute(H.ORACLE_SQL).fetchdf()[columns].values.tolist()))
    assert sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, folder).toPandas()[columns].values.tolist())) == want
