"""What a worker of operator 4 holds at once."""

import tracemalloc

import numpy as np
import pandas as pd

from newsgrid.llm.language_id import ContextTrees, _grams, _Scorer


def test_scorer_holds_few_arrays_at_once():
    text = b"the quick brown fox jumps over the lazy dog "
    packed, _, _ = _grams([text * 20], 4)
    grams, n = np.unique(packed, return_counts=True)
    trees = ContextTrees(4, ["en"], pd.DataFrame({"language": "en", "gram": grams.astype(np.int64), "n": n}))
    texts = [text * k for k in (20, 200, 2000)] * 60 + [b"", text * 100_000]
    scorer = _Scorer(trees)
    tracemalloc.start()
    try:
        bits = scorer.lengths(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 << 20
    np.testing.assert_allclose(bits, _Scorer(trees).lengths(texts, group=1 << 24), rtol=1e-12)
