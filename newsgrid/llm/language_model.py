"""LM scoring (operator 7): interpolated modified Kneser-Ney bigrams, counted in Spark, memory-mapped by workers.

Model files lie in the folder of spark.checkpoint.dir, which all machines see at the same path:
- words: sorted 64-bit hashes of the training tokens, with aligned arrays of their counts and statistics. A word's id is
  its place in that order, over all parts.
- pairs: for each shard, sorted keys (id of the word before << 32 | id of the word) and their counts.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgrid.llm.common import saved, shared_folder, table

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The token after the last word; no word is empty.
END = b""
#: Characters of text handled at once.
_GROUP = 1 << 22


def tokens(text: str | None) -> list[bytes]:
    """Words of the text, A-Z in lower case, then one end. bytes.split() splits at exactly \\x20 and \\x09 to \\x0D."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    words.append(END)
    return words


def _hash(word: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >= 1 << 63 else h


def _put(path: str, array: np.ndarray) -> None:
    """Write an array under its final name in one step, so that a task that runs twice leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{TaskContext.get().taskAttemptId()}"
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, path)


def _mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def local_path(uri: str) -> str:
    """The mounted path of a file: URI. Memory maps need one; other file systems have to be mounted."""
    if "://" in uri and not uri.startswith("file://"):
        raise ValueError(f"language models need a mounted shared folder in spark.checkpoint.dir, not {uri}")
    return uri.removeprefix("file://").removeprefix("file:")


@dataclass
class Model:
    folder: str
    lows: list[int]  # the smallest hash of each part of words
    starts: list[int]  # the id of each part's first word
    n_words: int  # V
    n_tokens: int  # N
    shards: int
    spread: list[int] = field(default_factory=list)  # ids of contexts dealt over all shards
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    rest: float = 1.0  # probability of a word never seen

    def part(self, kind: str, i: int) -> str:
        return f"{self.folder}/{kind}-{i:05d}.npy"

    def shard_of(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Pairs of one context share a shard, but for those contexts that make up more than a shard's part of all tokens."""
        mix = before.astype(np.uint64)
        if self.spread:
            wide = np.isin(before, np.array(self.spread))
            mix = np.where(wide, mix ^ (word.astype(np.uint64) << np.uint64(20)), mix)
        mix = (mix + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mix ^= mix >> np.uint64(31)
        return ((mix * np.uint64(0x94D049BB133111EB) >> np.uint64(33)) % np.uint64(self.shards)).astype(np.int64)


class Lexicon:
    """Ids of tokens by the mapped hash arrays, with a bounded memo; -1 for tokens not in training."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most, self.memo = model, most, {}
        self.parts = [_mapped(model.part("hash", i)) for i in range(len(model.lows))]

    def ids(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.memo))
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = list(set(words))
        if new:
            hashes = np.fromiter(map(_hash, new), np.int64, len(new))
            order = np.argsort(hashes, kind="stable")
            found = np.full(len(new), -1, np.int64)
            ordered = hashes[order]
            edges = np.searchsorted(ordered, np.array(self.model.lows, np.int64)).tolist() + [len(new)]
            for part, start, a, z in zip(self.parts, self.model.starts, edges[:-1], edges[1:]):
                if a < z:
                    at = np.minimum(np.searchsorted(part, ordered[a:z]), len(part) - 1)
                    found[order[a:z]] = np.where(part[at] == ordered[a:z], start + at, -1)
            self.memo.update(zip(new, found.tolist()))
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def values(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """Entries of an array aligned with the hashes, for sorted ids; 0 for id -1."""
        out = np.zeros(len(ids))
        edges = np.searchsorted(ids, np.array(self.model.starts)).tolist() + [len(ids)]
        for i, (start, a, z) in enumerate(zip(self.model.starts, edges[:-1], edges[1:])):
            if a < z:
                out[a:z] = _mapped(self.model.part(kind, i))[ids[a:z] - start]
        return out


def _grouped(texts: Iterable[str | None], group: int = _GROUP) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(first row, tokens, tokens by row) of runs of texts of about `group` characters."""
    at, words, sizes, held = 0, [], [], 0
    for i, t in enumerate(texts):
        own = tokens(t)
        words += own
        sizes.append(len(own))
        held += len(t or "")
        if held >= group:
            yield at, words, np.array(sizes)
            at, words, sizes, held = i + 1, [], [], 0
    if sizes:
        yield at, words, np.array(sizes)


def _before(ids: np.ndarray, sizes: np.ndarray, start_id: int) -> np.ndarray:
    """The id before each token; start_id before the first of a text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(sizes) - sizes] = start_id
    return out


def train(docs: DataFrame, tokens_in_shard: int = 1_000_000) -> Model:
    """Count and write a model of all texts of docs (text); null texts count as empty.

    Tokens are summed by hash, sorted and written; then pairs of ids, summed within each group of texts, go to their
    shards, where they are summed, sorted and written. A shard holds about tokens_in_shard pairs however large the input
    is. Statistics of contexts and of continuations are sums by id. The driver sees one row for each file.
    """
    spark, folder = docs.sparkSession, local_path(shared_folder(docs.sparkSession))
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([_hash(w) for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["hash", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column("text"):
                seen.update(tokens(t.as_py()))
                if len(seen) > 300_000:
                    yield rows()
        if seen:
            yield rows()

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if kept:
            t = pa.Table.from_batches(kept)
            h, n = t.column("hash").to_numpy(), t.column("n").to_numpy()
            _put(f"{folder}/task-{part:05d}-hash.npy", h)
            _put(f"{folder}/task-{part:05d}-count.npy", n)
            large = np.argsort(-n, kind="stable")[:1000]  # only some of these can pass the bar below
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((part, pa.int32()), (int(h[0]), pa.int64()), (len(h), pa.int64()), (int(n.sum()), pa.int64()), (large.tolist(), pa.list_(pa.int64())), (n[large].tolist(), pa.list_(pa.int64())))], ["part", "low", "n_words", "n_tokens", "large", "large_n"])

    words = texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    written = words.repartitionByRange("hash").sortWithinPartitions("hash").mapInArrow(write_words, "part int, low long, n_words long, n_tokens long, large array<long>, large_n array<long>")
    parts = sorted(saved(written).collect(), key=lambda r: r["part"])
    for i, r in enumerate(parts):
        for kind in ("hash", "count"):
            os.replace(f"{folder}/task-{r['part']:05d}-{kind}.npy", f"{folder}/{kind}-{i:05d}.npy")
    sizes = [r["n_words"] for r in parts]
    starts = [sum(sizes[:i]) for i in range(len(parts))]
    total = sum(r["n_tokens"] for r in parts)
    shards = max(1, -(-total // tokens_in_shard))
    model = Model(folder, [r["low"] for r in parts], starts, sum(sizes), total, shards)
    if not total:
        return model
    # a context is followed as often as it occurs: those with over half a shard's pairs are dealt out; fewer than 2 * shards
    model.spread = [s + i for r, s in zip(parts, starts) for i, n in zip(r["large"], r["large_n"]) if n > tokens_in_shard // 2]
    start_id = model.n_words  # the context of first words
    model.spread.append(start_id)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model)
        for b in batches:
            for _, ws, n in _grouped(t.as_py() for t in b.column("text")):
                ids = lexicon.ids(ws)
                key, times = np.unique(_before(ids, n, start_id) << 32 | ids, return_counts=True)
                shard = model.shard_of(key >> 32, key & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(key), pa.array(times.astype(np.int32))], ["shard", "key", "n"])

    stats_kinds = "kind int, id long, n1 long, n2 long, n3 long, n4 long, total long"

    def write_pairs(t: pa.Table) -> pa.Table:
        shard, key, n = t.column("shard")[0].as_py(), t.column("key").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[first], np.add.reduceat(n, first)
        _put(model.part("key", shard), key)
        _put(model.part("times", shard), n.astype(np.min_scalar_type(n.max())))
        context, at = np.unique(key >> 32, return_inverse=True)
        ones = [np.bincount(at, weights=n == k, minlength=len(context)) for k in (1, 2)]
        more = np.bincount(at, weights=n >= 3, minlength=len(context))
        word, times = np.unique(key & 0xFFFFFFFF, return_counts=True)
        of_all = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        z = np.zeros
        columns = [
            np.concatenate([np.zeros(len(context)), np.ones(len(word)), [2]]),
            np.concatenate([context, word, [-1]]),
            np.concatenate([ones[0], times, of_all[:1]]),
            np.concatenate([ones[1], z(len(word)), of_all[1:2]]),
            np.concatenate([more, z(len(word)), of_all[2:3]]),
            np.concatenate([z(len(context)), z(len(word)), of_all[3:]]),
            np.concatenate([np.bincount(at, weights=n), z(len(word)), [len(key)]]),
        ]
        return pa.table([pa.array(c.astype(k)) for c, k in zip(columns, [np.int32] + [np.int64] * 6)], names=[x.split()[0] for x in stats_kinds.split(", ")])

    shard_stats = texts.mapInArrow(pairs, "shard int, key long, n int").groupBy("shard").applyInArrow(write_pairs, stats_kinds)
    sums = saved(shard_stats.groupBy("kind", "id").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "total"))))
    model.discounts = _discounts(*sums.where("kind = 2").select("n1", "n2", "n3", "n4").first())
    follow = sums.where("kind = 1").select("id", F.col("n1").alias("cont"))
    by_cont = {r["cont"]: r["n"] for r in follow.where("cont <= 4").groupBy("cont").agg(F.count("*").alias("n")).collect()}
    n_pairs, n_seen = follow.agg(F.sum("cont"), F.count("*")).first()
    low = _discounts(*(by_cont.get(k, 0) for k in (1, 2, 3, 4)))
    left = low[0] * by_cont.get(1, 0) + low[1] * by_cont.get(2, 0) + low[2] * (n_seen - by_cont.get(1, 0) - by_cont.get(2, 0))
    model.rest = left / n_pairs / (model.n_words + 1) if left > 0 else 1 / (n_pairs + model.n_words + 1)

    off = F.when(F.col("cont") == 1, low[0]).when(F.col("cont") == 2, low[1]).otherwise(low[2])
    p_word = follow.select("id", ((F.col("cont") - off) / n_pairs + model.rest).alias("p"))
    d1, d2, d3 = model.discounts
    context = sums.where("kind = 0").select("id", "total", ((d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")) / F.col("total")).alias("gamma"))
    both = p_word.join(context, "id", "full_outer").select("id", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("p", "total", "gamma")))

    edges = np.array(starts)

    def write_columns(t: pa.Table) -> pa.Table:
        i = t.column("part")[0].as_py()
        size = sizes[i] if i < len(sizes) else 1
        at = t.column("id").to_numpy() - (starts[i] if i < len(sizes) else start_id)
        for kind in ("p", "total", "gamma"):
            values = np.zeros(size)
            values[at] = t.column(kind).to_numpy()
            _put(model.part(kind, i), values)
        return pa.table({"part": pa.array([i], pa.int32())})

    def with_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            part = np.where(ids == start_id, len(sizes), np.searchsorted(edges, ids, side="right") - 1)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *b.columns], ["part", *b.schema.names])

    done = both.mapInArrow(with_part, "part int, id long, p double, total double, gamma double").groupBy("part").applyInArrow(write_columns, "part int")
    saved(done)
    # the start has a part of its own
    model.starts = [*starts, start_id]
    return model


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; half of each where the counts of counts are too few."""
    n1, n2, n3, n4 = (float(n or 0) for n in (n1, n2, n3, n4))
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(x if 0 < x < k else k / 2 for k, x in zip((1, 2, 3), d))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.start = model, model.n_words
        parts = len(model.lows)
        self.lexicon = Lexicon(Model(model.folder, model.lows, model.starts[:parts], model.n_words, model.n_tokens, model.shards))
        # the context of first words has a part of its own, after those of the words
        self.first = [float(_mapped(model.part(kind, parts))[0]) if model.n_tokens else 0.0 for kind in ("total", "gamma")]
        self.shards: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def times(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How often each pair occurred in training; pairs with id -1: 0."""
        out = np.zeros(len(ids))
        usable = np.flatnonzero((before >= 0) & (ids >= 0))
        key, back = np.unique(before[usable] << 32 | ids[usable], return_inverse=True)
        found, shard = np.zeros(len(key)), self.model.shard_of(key >> 32, key & 0xFFFFFFFF)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s in range(self.model.shards):
            own = order[edges[s] : edges[s + 1]]
            if len(own):
                if s not in self.shards:
                    paths = [self.model.part(k, s) for k in ("key", "times")]
                    self.shards[s] = tuple(map(_mapped, paths)) if os.path.exists(paths[0]) else (np.zeros(0, np.int64),) * 2
                keys, times = self.shards[s]
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
                    found[own] = np.where(keys[at] == key[own], times[at], 0)
        out[usable] = found[back]
        return out

    def score(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: tokens with a training count, base score, model score."""
        m, starts = self.model, np.cumsum(sizes) - sizes
        ids = self.lexicon.ids(words)
        distinct, back = np.unique(ids, return_inverse=True)
        of = lambda kind: self.lexicon.values(kind, distinct)[back]
        count = of("count") if m.n_tokens else np.zeros(len(ids))
        base = np.log10((count + 0.1) / (m.n_tokens + 0.1 * (m.n_words + 1)))
        p = np.full(len(ids), m.rest)
        if m.n_tokens:
            known = of("p")
            p = np.where(known > 0, known, p)

            def before(kind: str, first: float) -> np.ndarray:
                own, out = of(kind), np.empty(len(ids))
                out[1:] = own[:-1]
                out[starts] = first
                return out

            total, gamma = before("total", self.first[0]), before("gamma", self.first[1])
            c = self.times(_before(ids, sizes, self.start), ids)
            d = np.array([0.0, *m.discounts])[np.minimum(c, 3).astype(np.int64)]
            p = np.where(total > 0, (c - d) / np.maximum(total, 1) + gamma * p, p)
        return np.add.reduceat(count > 0, starts, dtype=np.int64), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


def score(docs: DataFrame, model: Model, folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    score: the model's log10 probability of the whole text, its end included; perplexity is 10 ** (-score / n_tokens). A
    null text is empty: its end alone. base_score: unigrams with 0.1 added to each count. A null doc_id is not held out.
    Repeated rows give repeated rows; other columns are ignored. No row is moved: workers map the model's files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            for at, words, sizes in _grouped((t.as_py() for t in b.column("text")), _GROUP // 2):
                known, base, own = scorer.score(words, sizes)
                arrays = [pa.array(x) for x in (sizes.astype(np.int64), known.astype(np.int64), np.full(len(sizes), model.n_tokens, np.int64), base, own)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(sizes)), *arrays], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 10 != 0)))
