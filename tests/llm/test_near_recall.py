"""Operator 1: share of alike pairs that are found, by share of words replaced and in crowded buckets."""

import numpy as np
import pytest

from newsgrid.llm.near_dedup import near_duplicates

VOCAB = np.array([f"word{i}" for i in range(20000)])


def replaced(rng, words, share):
    out = list(words)
    for i in rng.choice(len(out), int(len(out) * share), replace=False):
        out[i] = f"other{rng.integers(0, 99999)}"
    return out


def found(spark, pairs):
    rows = [(2 * i + j, " ".join(t)) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[2 * i] == 2 * i for i in range(len(pairs)))
    return [got[2 * i + 1] == 2 * i for i in range(len(pairs))]


def test_by_share_of_words_replaced(spark):
    rng = np.random.default_rng(12)
    shares = [0.02, 0.05, 0.10, 0.15]
    pairs, kinds = [], []
    for length in (60, 200, 500):
        for share in shares:
            for _ in range(40):
                a = rng.choice(VOCAB, length).tolist()
                pairs.append((a, replaced(rng, a, share)))
                kinds.append(share)
    hit = np.array(found(spark, pairs))
    for share in shares:
        assert hit[np.array(kinds) == share].mean() >= 0.9, share


@pytest.mark.parametrize("number", [150])
def test_pairs_among_texts_with_a_common_passage(spark, number):
    """Buckets of the passage hold twice as many texts as there are pairs; a text shares two fifths of its words with all."""
    rng = np.random.default_rng(13)
    passage = rng.choice(VOCAB, 80).tolist()
    pairs = []
    for _ in range(number):
        a = passage + rng.choice(VOCAB, 120).tolist()
        pairs.append((a, replaced(rng, a, 0.05)))
    assert np.mean(found(spark, pairs)) >= 0.9
