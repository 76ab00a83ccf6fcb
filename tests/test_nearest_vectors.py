"""Nearest vectors by products of matrices, against the path by array functions."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsgrid.operators import texts as X


def _ranked(rows, n):
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return sorted(repr(tuple(r)) for r in rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).collect())


def test_same_as_by_arrays(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6)).astype("float32")
    # near and exact copies, one vector many times over, null and short vectors, null and non-finite components
    rows = [(i, (base[i % 40] + (i % 3) * np.float32(1e-7)).tolist()) for i in range(700)] + [(700 + i, base[0].tolist()) for i in range(600)]
    rows += [(2000, None), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2020, [float("inf")] * 6), (2030, [1.0, 2.0]), (None, base[1].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = vectors.where("vec_id % 10 = 0")
    for n in (1, 4):
        want = _ranked(X._nearest_odd(queries, vectors, n, 4), n)
        got = X.nearest(queries, vectors, n, shards=3, most=50)
        assert got.columns == ["query_id", "vec_id", "cosine", "rank"] and sorted(repr(tuple(r)) for r in got.collect()) == want


def test_plain_vectors_meet_no_array_functions(spark, monkeypatch):
    asked, real = [], X._nearest_odd
    monkeypatch.setattr(X, "_nearest_odd", lambda q, v, *more: (asked.append(q.count() * v.count()), real(q, v, *more))[1])
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    got = X.nearest(vectors.where("vec_id % 10 = 0"), vectors, 2)
    assert got.count() == 6 and asked == [0, 0]
