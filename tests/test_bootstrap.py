"""Moving-block resamples of many groups against NumPy, draw for draw."""

import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from newsgrid.operators import series as T


def drawn(seed, r, k):
    """Spark's xxhash64 of two ints and a long."""
    h = 42
    for raw in (struct.pack("<i", seed), struct.pack("<i", r), struct.pack("<q", k)):
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >= 1 << 63 else h


def interval(x, block, resamples, seed):
    block = min(block, len(x))
    blocks = -(-len(x) // block)
    starts = np.array([[drawn(seed, r, k) % (len(x) - block + 1) for k in range(blocks)] for r in range(resamples)])
    means = [np.concatenate([x[s : s + block] for s in row])[: len(x)].mean() for row in starts]
    return np.percentile(means, [2.5, 97.5])


def test_groups_match_numpy(spark):
    rng = np.random.default_rng(3)
    sizes = {"a": 30, "b": 30, "c": 47, "short": 4, "one": 1}
    values = {g: rng.normal(0, 3, n).round(3) for g, n in sizes.items()}
    rows = [(g, 10 * i, float(v)) for g, x in values.items() for i, v in enumerate(x)] + [("a", 5, None), ("nothing", 1, None)]
    df = spark.createDataFrame(rows, "g string, position int, value double").orderBy(F.rand(1))
    got = {r.g: r for r in T.block_bootstrap(df, ["g"], 7, 300, 9).collect()}
    assert set(got) == set(sizes)
    for g, x in values.items():
        low, high = interval(x, 7, 300, 9)
        assert np.allclose([got[g].low, got[g].high, got[g].mean], [low, high, x.mean()]), g


def test_one_group_and_none(spark):
    x = np.sin(np.arange(40) / 5)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "position long, value double")
    r = T.block_bootstrap(df, resamples=200).first()
    assert np.allclose([r.low, r.high], interval(x, 7, 200, 1))
    assert T.block_bootstrap(df.limit(0)).count() == 0
    assert T.block_bootstrap(df.withColumn("g", F.lit(1)).limit(0), ["g"]).count() == 0
