"""MinHash near-dedup (operator 1): Order MinHash candidates, verified by banded alignment of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrid.llm.common import bucket_components, saved, table, unused
from newsgrid.llm.segments import forget

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Parts of all words by hash; the counts of two texts bound their edit distance from below.
_BINS = 256


def words_of(text: str) -> list[str]:
    """Lower-case words: runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, with a bounded memo."""

    def __init__(self, most: int = 500_000):
        self.memo: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        new = set(words).difference(self.memo)
        if len(self.memo) + len(new) > self.most:
            self.memo.clear()
            new = set(words)
        for w in new:
            self.memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def labelled_kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs in text order, each with the number of its earlier occurrences mixed in."""
    n = max(1, len(hashes) - k + 1)
    runs = np.zeros(n, np.uint64)
    for i in range(min(k, len(hashes))):
        runs = runs * _ODD + hashes[i : i + n]
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if not fresh.all():
        at = np.arange(n)
        label = np.empty(n, np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
        runs = runs + label * np.uint64(0xD6E8FEB86659FD93)
    return _mix(runs)


def order_minhash(kmers: np.ndarray, seeds: np.ndarray, size: int, cells: int = 1 << 20) -> np.ndarray:
    """One hash for each seed: of the `size` k-mers with the smallest seeded hashes, in the order they have in the text."""
    size = min(size, len(kmers))
    out = np.zeros(len(seeds), np.uint64)
    step = max(1, cells // len(kmers))
    for at in range(0, len(seeds), step):
        h = (kmers[None, :] ^ seeds[at : at + step, None]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        row, least = np.arange(len(h)), np.empty((len(h), size), np.int64)
        for i in range(size):
            least[:, i] = h.argmin(1)
            h[row, least[:, i]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least.sort(1)
        for i in range(size):
            out[at : at + step] = out[at : at + step] * _ODD + kmers[least[:, i]]
    return out


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, else most + 1.

    Only the diagonals within `most` of the main one are aligned: a window of 2 * most + 2 cells slides down the longer
    sequence, and one step of integer arithmetic updates all its vertical differences at once.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    if most >= n:
        most = n
    width = 2 * most + 2
    mask, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    plus, minus = (mask << (width - most - 1)) & mask, 0
    score, start, level = most, most + 1 - width, top >> 1
    for j, x in enumerate(b):
        bits = where.get(x, 0)
        match = ((bits >> start) if start >= 0 else (bits << -start)) & mask
        d = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        hp = (minus | ~(d | plus)) & mask
        hm = d & plus
        if j < n - most:
            score += not d & top
        else:
            score += bool(hp & level)
            score -= bool(hm & level)
            level >>= 1
        half = d >> 1
        plus = (hm | ~(half | hp)) & mask
        minus = half & hp
        start += 1
    return score if score <= most else most + 1


def edit_bounds(a: list[str], b: list[str], threshold: float) -> tuple[int | None, int]:
    """(distance, lower): over words, the edit distance if 1 - distance / longer length reaches threshold, else None, and a
    lower bound of the distance. Two empty texts are alike."""
    longer = max(len(a), len(b))
    most = int((1 - threshold) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return None, abs(len(a) - len(b))
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        d = max(len(a), len(b))
        return (d, d) if d <= most else (None, d)
    ids: dict[str, int] = {}
    x, y = ([ids.setdefault(w, len(ids)) for w in t] for t in (a, b))
    counts = np.bincount(x, minlength=len(ids)) - np.bincount(y, minlength=len(ids))
    unmatched = int(max(counts[counts > 0].sum(), -counts[counts < 0].sum()))  # words that no alignment can match
    if unmatched > most:
        return None, unmatched
    band = 16
    while band < most:
        d = banded_distance(x, y, band)
        if d <= band:
            return d, d
        band *= 4
    d = banded_distance(x, y, most)
    return (d, d) if d <= most else (None, most + 1)


def edit_similar(a: list[str], b: list[str], threshold: float) -> bool:
    return edit_bounds(a, b, threshold)[0] is not None


def sketch(docs: DataFrame, k: int, size: int, bands: int, rows: int, seed: int = 0) -> DataFrame:
    """(doc_id, key, bands array<long>, n, bag): key is the md5 of the text, bands the hashes of `rows` sketch entries each, n the
    number of words, and bag says of each of _BINS parts of all words how many of these there are, up to 255."""
    seeds = np.random.default_rng(20240229 + seed).integers(1, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                out, sizes, bags = [], [], []
                for t in b.column("text").to_pylist():
                    words = words_of(t)
                    sizes.append(len(words))
                    if not words:
                        out.append([])
                        bags.append(None)
                        continue
                    hashed = hashes(words)
                    bags.append(np.minimum(np.bincount((hashed >> np.uint64(40)).astype(np.int64) % _BINS, minlength=_BINS), 255).astype(np.uint8).tobytes())
                    entries = order_minhash(labelled_kmers(hashed, k), seeds, size).reshape(bands, rows)
                    x = np.arange(bands, dtype=np.uint64)
                    for i in range(rows):
                        x = x * _ODD + entries[:, i]
                    out.append(_mix(x).astype(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(out, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], ["doc_id", "key", "bands", "n", "bag"])

    rows_ = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows_ = rows_.select(F.col("doc_id").cast("long"), F.md5(F.col("text")).alias("key"), F.col("text").cast("string"))
    return rows_.mapInArrow(run, "doc_id long, key string, bands array<long>, n long, bag binary")


def _bag_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _BINS)


def may_align(n_a: np.ndarray, n_b: np.ndarray, bags_a: np.ndarray, bags_b: np.ndarray, threshold: float, step: int = 4096) -> np.ndarray:
    """Whether pairs of texts can have an edit similarity of threshold, by their lengths and bags: words of a part that one
    has more of than the other are left out, put in or replaced, each at a distance of 1."""
    most = ((1 - threshold) * np.maximum(n_a, n_b) + 1e-9).astype(np.int64)
    good = np.abs(n_a - n_b) <= most
    at = np.flatnonzero(good)
    for begin in range(0, len(at), step):
        i = at[begin : begin + step]
        d = bags_a[i].astype(np.int16) - bags_b[i]
        over = np.maximum(d, 0).sum(1, dtype=np.int64)
        good[i] = np.maximum(over, over - d.sum(1, dtype=np.int64)) <= most[i]
    return good


def _bounded(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) that may align. bags: (id, n, bag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                good = may_align(b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), _bag_rows(b.column("bag_a")), _bag_rows(b.column("bag_b")), threshold)
                yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda i: bags.select(F.col("id").alias(i), F.col("n").alias("n_" + i), F.col("bag").alias("bag_" + i))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def near_in_buckets(members: DataFrame, bags: DataFrame, threshold: float, tile: int = 512) -> DataFrame:
    """Pairs (a, b), a < b, of members (bucket, id, component, open) of one bucket and different components, one of them open,
    that may align. bags: (id, n, bag).

    Texts that align differ by a factor of 1 / threshold in length at most: members are classed by it, and meet those of their
    own class and the one above. Larger groups are cut to chunks, and all pairs of chunks are tiles of up to 2 * tile rows or
    so, which lie in one task each and whose pairs are compared as arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            rows = [x for x in (held, b) if x is not None and x.num_rows]
            held = None
            if not rows:
                continue
            whole = pa.Table.from_batches(rows).combine_chunks()
            tiles = whole.column("tile").to_numpy()
            if b is not None:  # the last tile may go on in the next batch
                end = int(np.searchsorted(tiles, tiles[-1]))
                held = whole.slice(end).to_batches()[0]
                whole, tiles = whole.slice(0, end), tiles[:end]
            if len(tiles) < 2:
                continue
            id_, of, open_, n, home, chunk, inner = (whole.column(c).to_numpy() for c in ("id", "component", "open", "n", "home", "chunk", "inner"))
            bags_ = _bag_rows(whole.column("bag"))
            at = np.arange(len(tiles) - 1)
            gap = 1
            while len(at):
                at = at[at + gap < len(tiles)]
                at = at[tiles[at] == tiles[at + gap]]
                to = at + gap
                met = (of[at] != of[to]) & (open_[at] | open_[to]) & (home[at] | home[to]) & (inner[at] | (chunk[at] != chunk[to]))
                i, j = at[met], to[met]
                good = may_align(n[i], n[j], bags_[i], bags_[j], threshold)
                if good.any():
                    x, y = id_[i[good]], id_[j[good]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
                gap += 1

    level = F.floor(F.log("n") / float(np.log(1 / threshold + 0.01))).cast("int")
    rows = members.join(bags, "id").withColumn("level", level)
    rows = rows.withColumn("place", F.explode(F.array(F.struct("level", F.lit(True).alias("home")), F.struct((F.col("level") + 1).alias("level"), F.lit(False).alias("home")))))
    rows = rows.select("bucket", "place.level", "place.home", "id", "component", "open", "n", "bag")
    asked = rows.groupBy("bucket", "level").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"), F.max("open").alias("any_open"), F.max("home").alias("any_home"), F.count("*").alias("all")).where("any_open AND any_home AND `all` > 1")
    rows = rows.join(asked.select("bucket", "level", "chunks"), ["bucket", "level"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = F.xxhash64("bucket", "level", F.least("chunk", "other"), F.greatest("chunk", "other"))
    rows = rows.select(key.alias("tile"), "id", "component", "open", "n", "home", "chunk", (F.col("chunk") == F.col("other")).alias("inner"), "bag")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long").distinct()


def _compared(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose texts (id, text) align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last, left, good = None, [], []
            for x, y in zip(b.column("text_a"), b.column("text_b")):
                x = x.as_py()
                if x != last:
                    last, left = x, words_of(x)
                good.append(edit_similar(left, words_of(y.as_py()), threshold))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, size: int = 2, bands: int = 60, rows: int = 1) -> DataFrame:
    """(doc_id, component_id, kept) for every row of docs (doc_id, text).

    Texts are alike when their words, in lower case, align with an edit similarity of at least threshold. component_id
    is the smallest doc_id reachable over exact copies and alike candidates; kept: doc_id = component_id. A null text or
    id matches nothing (a null id is kept); empty texts are exact copies of each other; texts without words match exact
    copies only; a text shorter than k words is one k-mer. Rows that repeat an id with the same text are one document
    and share its row's values. Any length of text is read whole. An empty table gives no rows; other columns are ignored.

    Candidates: each text has bands * rows Order MinHash entries, hashes of its `size` smallest occurrence-labelled
    k-mers in text order, and texts that agree on all `rows` entries of a band meet. With 60 bands of one entry of two k-mers,
    pairs of which 15 % of the words were replaced (edit similarity 0.85) still meet in 98 of 100 cases. Exact copies are one
    class first.
    bucket_components says which of those that meet are aligned; members of large buckets whose texts differ are dealt to
    four times as many further bands.
    """
    rows_ = saved(sketch(docs, k, size, bands, rows))
    classes = saved(rows_.groupBy("key").agg(F.min("doc_id").alias("rep")))
    reps = rows_.join(classes, "key").where(F.col("doc_id") == F.col("rep")).select("rep", "key", "bands", "n", "bag").dropDuplicates(["rep", "key"])
    # a repeated id with several texts stands for all of them
    spread = reps.select("rep", F.posexplode("bands").alias("band", "value"))
    members = spread.select(F.col("rep").alias("id"), F.xxhash64("band", "value").alias("bucket")).distinct()
    busy = members.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket")
    met = saved(members.join(busy, "bucket", "left_semi"))
    # of an id's several texts the one with the smallest key is aligned, whatever the order of rows
    wanted = saved(reps.groupBy(F.col("rep").alias("id")).agg(F.min("key").alias("key")).join(met.select("id").distinct(), "id", "left_semi"))
    bags = saved(reps.select(F.col("rep").alias("id"), "key", "n", "bag").join(wanted, ["id", "key"], "left_semi").drop("key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    texts = texts.withColumn("key", F.md5("text")).join(wanted, ["id", "key"], "left_semi").drop("key")
    texts = saved(texts.dropDuplicates(["id"]))

    def more_bands(ids: DataFrame) -> DataFrame:
        own = texts.join(ids, "id", "left_semi").select(F.col("id").alias("doc_id"), "text")
        found = sketch(own, k, size, 4 * bands, rows, seed=1)
        return found.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "id").distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        return _compared(saved(_bounded(pairs, bags, threshold)), texts, threshold)

    components = bucket_components(met, verify, more_bands, list_last=lambda members: near_in_buckets(members, bags, threshold))
    groups = classes.join(components, classes["rep"] == components["node"], "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    found = rows_.select("doc_id", "key").join(groups, "key").select("doc_id", "component_id")
    alone = docs.where(F.col("doc_id").isNull() | F.col("text").isNull()).select(F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, all columns, of which one document of each group of near-duplicates stays: the smallest doc_id.

    Rows without a doc_id stay. Of rows that repeat an id and text one stays; an id with several texts goes if any of
    them is in the group of a smaller id.
    """
    doc = unused(docs, "near_doc")
    gone = near_duplicates(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias(doc)).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col(doc), "left_anti")
    n, ids = docs.where(F.col("doc_id").isNotNull()).agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        return left
    return left.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"]).unionByName(left.where(F.col("doc_id").isNull()))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
