"""Operator 1: what lengths and bags of words rule out before texts are read."""

import random

import numpy as np
from pyspark.sql import functions as F

from newsgrid.llm import near_dedup as D


def _bag(words):
    hashed = D.WordHashes()(words)
    return np.minimum(np.bincount((hashed >> np.uint64(40)).astype(np.int64) % D._BINS, minlength=D._BINS), 255).astype(np.uint8)


def _texts(r, n):
    out = []
    while len(out) < n:
        own = [f"w{r.randint(0, 300)}" for _ in range(r.randint(4, 120))]
        out.append(own)
        for _ in range(2):
            copy = [w if r.random() > 0.12 else "new" for w in own]
            out.append(copy[r.randint(0, 3) :])
    return out[:n]


def test_no_alike_pair_is_ruled_out_and_tiles_miss_none(spark):
    r = random.Random(3)
    texts = _texts(r, 90) + [["x"] * 1000, ["x"] * 800, ["x"] * 799]
    bags, n = np.stack([_bag(t) for t in texts]), np.array([len(t) for t in texts])
    i, j = np.triu_indices(len(texts), 1)
    possible = D.may_align(n[i], n[j], bags[i], bags[j], 0.8, step=100)
    alike = np.array([D.edit_similar(texts[a], texts[b], 0.8) for a, b in zip(i, j)])
    assert alike.sum() > 30 and not (alike & ~possible).any() and possible.sum() < len(i) / 4
    component = [k // 2 for k in range(len(texts))]
    open_ = [r.random() < 0.5 for _ in texts]
    members = spark.createDataFrame([(bucket, k, component[k], open_[k]) for bucket in (1, 2) for k in range(len(texts)) if k % 3 or bucket == 1], "bucket long, id long, component long, open boolean")
    rows = spark.createDataFrame([(k, len(t), bytes(b)) for k, (t, b) in enumerate(zip(texts, bags))], "id long, n long, bag binary")
    want = {(a, b) for a, b, p in zip(i.tolist(), j.tolist(), possible) if p and component[a] != component[b] and (open_[a] or open_[b])}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for tile in (4, 10_000):
            got = D.near_in_buckets(members, rows, 0.8, tile).collect()
            assert len(got) == len(want) and set(map(tuple, got)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_crowd_with_one_passage_is_not_aligned(spark, monkeypatch):
    r = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, passage + " " + " ".join(f"w{r.randint(0, 5000)}" for _ in range(40))) for i in range(80)] + [(100, passage + " only")]
    rows += [(1000, rows[7][1].rsplit(" ", 2)[0])]
    read, compared = [], D._compared

    def counted(pairs, texts, threshold):
        read.append(pairs.count())
        return compared(pairs, texts, threshold)

    monkeypatch.setattr(D, "_compared", counted)
    found = D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.where(~F.col("kept")).collect()} == {1000: 7}
    assert sum(read) < 40
