"""Operators 8 and 9 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgrid.llm.vector_dedup import linked_pairs, near_duplicates, quantised
from newsgrid.llm.vector_search import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, v string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    centres = rng.normal(size=(4, 8))
    for i in range(160):
        v = centres[i % 4] + rng.normal(size=8) * (0.05 if i % 3 else 1.0)
        out.append((i, [float(np.float32(x)) for x in v]))
    out += [(200 + i, out[0][1]) for i in range(40)]  # one vector many times
    out += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] + [1.0] * 7), (304, [None] + [1.0] * 7), (305, [float("inf")] * 8), (306, [1.0, 2.0])]
    return out


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def padded(v):
    return np.array([*v, *[0.0] * (8 - len(v))])


def test_top_k_is_exact(spark, rows):
    got = top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, n_pivots=6, rows_in_block=16, blocks_in_task=3, queries_in_task=4)
    usable = {i: np.floor(256 * padded(v)) for i, v in rows if good(v)}
    want = set()
    for q in (i for i in usable if i % 50 == 0):
        ranked = sorted((-int(usable[q] @ x), i) for i, x in usable.items() if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_top_k_of_few_or_none(spark, rows):
    few = top_k(frame(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None)]), F.col("vec_id") % 50 == 0)
    assert [tuple(r) for r in few.collect()] == [(0, 1, 1, 128 * 256 + 128 * 512)]
    assert top_k(frame(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k(frame(spark, [(1, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("tile", [7, 2048])
def test_near_duplicates_are_exact(spark, rows, tile):
    got = {r.vec_id: r for r in near_duplicates(frame(spark, rows), n_pivots=5, tile=tile).collect()}
    usable = {i: padded(v) for i, v in rows if good(v) and any(v)}
    links = {i: set() for i, _ in rows}
    for i, a in usable.items():
        for j, b in usable.items():
            if i != j and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95:
                links[i].add(j)
    low = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            m = min([low[i], *(low[j] for j in js)])
            changed, low[i] = changed or m < low[i], m
    assert len(got) == len(rows)
    for i in links:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), low[i], low[i] == i), i


def test_near_duplicates_of_nothing_and_repeats(spark, rows):
    assert near_duplicates(frame(spark, rows).limit(0)).count() == 0
    got = near_duplicates(frame(spark, [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0])])).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.kept) for r in got) == [(-1, 0, True), (3, 0, True), (5, 1, True), (5, 1, True)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(60, 16)), np.eye(16), rng.normal(size=(20, 16)) * 1e-6])
    v = np.concatenate([v, v + rng.normal(size=v.shape) * 0.2 * np.linalg.norm(v, axis=1)[:, None] / 4])
    q, scale, lost = quantised(v)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert np.allclose(np.linalg.norm(unit - q * scale[:, None], axis=1), lost)
    one = (q, scale, lost, v, np.linalg.norm(v, axis=1))
    found = {(a, b) for i, j in linked_pairs(one, one, True, 0.9, rows=13, most=5) for a, b in zip(i.tolist(), j.tolist())}
    cosine = unit @ unit.T
    assert found == {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if cosine[a, b] >= 0.9}
