"""Language ID (operator 4): prediction by partial matching with frozen byte context trees, one for each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgrid.llm.common import saved, table
from newsgrid.llm.segments import forget

#: What a text begins after.
_START = b"\n"


def _fold(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed (order + 1)-grams of the joined texts, and where those of each text begin and end among them."""
    pad = _START * order
    joined = np.frombuffer(pad + pad.join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + order)[:-1]])
    packed = np.zeros(max(0, len(joined) - order), np.uint64)
    for k in range(order + 1):
        packed <<= np.uint64(8)
        packed |= joined[k : k + len(packed)]
    return packed, starts, starts + sizes


class ContextTrees:
    """Counts of byte contexts up to `order` long, by language, as sorted arrays; and code lengths under them."""

    def __init__(self, order: int, languages: list[str], counts: pd.DataFrame):
        """counts: language, gram (order + 1 bytes, the last one the coded symbol), n."""
        self.order, self.languages = order, languages
        self.trees = []
        for lang in languages:
            own = counts[counts.language == lang]
            grams, n = own.gram.to_numpy(np.int64).astype(np.uint64), own.n.to_numpy(np.int64)
            levels = []
            for k in range(order + 1):
                key, at = np.unique(grams & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
                seen = np.bincount(at, weights=n, minlength=len(key))
                context, first = np.unique(key >> np.uint64(8), return_inverse=True)
                levels.append((key, seen, context, np.bincount(first, weights=seen), np.bincount(first)))
            self.trees.append(levels)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each gram given those before it: (grams, languages).

        The longest known context codes the symbol with count / (total + distinct), or else escapes with
        distinct / (total + distinct) to the next shorter one; below the empty context all 256 bytes are equal.
        """
        out = np.empty((len(grams), len(self.languages)))
        for l, levels in enumerate(self.trees):
            cost, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
            for k in range(self.order, -1, -1):
                key, seen, context, total, distinct = levels[k]
                if not len(key) or not open_.any():
                    continue
                at = np.flatnonzero(open_)
                g = grams[at] & np.uint64((1 << 8 * (k + 1)) - 1)
                c = np.minimum(np.searchsorted(context, g >> np.uint64(8)), len(context) - 1)
                known = context[c] == g >> np.uint64(8)
                s = np.minimum(np.searchsorted(key, g), len(key) - 1)
                hit = known & (key[s] == g)
                whole = total[c] + distinct[c]
                cost[at[hit]] -= np.log2(seen[s[hit]] / whole[hit])
                away = known & ~hit
                cost[at[away]] -= np.log2(distinct[c[away]] / whole[away])
                open_[at[hit]] = False
            cost[open_] += 8.0
            out[:, l] = cost
        return out


class _Scorer:
    """Code lengths of whole texts; the bits of grams met before are kept, up to a bound."""

    def __init__(self, trees: ContextTrees, most: int = 1 << 20):
        self.trees, self.most = trees, most
        self.known, self.cost = np.zeros(0, np.uint64), np.zeros((0, len(trees.languages)))

    def lengths(self, texts: list[bytes], group: int = 1 << 20) -> np.ndarray:
        """(texts, languages): total bits. Texts of over `group` bytes are summed over stretches that overlap in context.
        A byte of a group takes some 40 bytes of arrays, in every worker of an executor at once."""
        out = np.zeros((len(texts), len(self.trees.languages)))
        part, at, held = [], [], 0
        order = self.trees.order
        for i, t in enumerate(texts):
            for begin in range(0, len(t), group):
                stretch = t[max(0, begin - order) : begin + group]
                part.append(stretch)
                at.append((i, begin - max(0, begin - order)))
                held += len(stretch)
                if held >= group:
                    self._add(part, at, out)
                    part, at, held = [], [], 0
        if part:
            self._add(part, at, out)
        return out

    def _add(self, texts: list[bytes], at: list[tuple[int, int]], out: np.ndarray) -> None:
        grams, starts, ends = _grams(texts, self.trees.order)
        codes, distinct = pd.factorize(grams)
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        if new.any():
            fresh = distinct[new]
            if len(self.known) + len(fresh) > self.most:
                self.known, self.cost, fresh = self.known[:0], self.cost[:0], distinct
            joined, cost = np.concatenate([self.known, fresh]), np.concatenate([self.cost, self.trees.bits(fresh)])
            order = np.argsort(joined, kind="stable")
            self.known, self.cost = joined[order], cost[order]
            place = np.searchsorted(self.known, distinct)
        edges = np.stack([starts + [skip for _, skip in at], ends], 1)
        filled = edges[:, 0] < edges[:, 1]
        flat, rows = edges[filled].ravel(), np.array([i for i, _ in at])[filled]
        if not len(flat):
            return
        for l in range(out.shape[1]):
            each = np.append(self.cost[place, l][codes], 0.0)
            np.add.at(out[:, l], rows, np.add.reduceat(each, flat)[::2])


def _remainder(doc_id: str, folds: int):
    return F.crc32(F.col(doc_id).cast("string")) % folds


def train(docs: DataFrame, order: int = 4, folds: int = 5, rows_per_language: int = 1200, most_languages: int = 1000) -> ContextTrees:
    """Context trees from a bounded sample of labelled rows.

    Of the rows with text, a lang and crc32(doc_id) mod folds other than 0, at most rows_per_language of each of the
    most_languages most frequent languages are read, chosen by a hash of doc_id (rows that repeat a chosen id come with
    it). Their grams are counted in Spark, and only the counts of distinct grams, bounded by the sample, reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string").alias("language"))
    able = rows.where(F.col("language").isNotNull() & F.col("text").isNotNull() & (_remainder("doc_id", folds) != 0))
    frequent = saved(able.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(most_languages))
    # a bar on the hash leaves a little over rows_per_language rows of each language; only these are ranked
    enough = rows_per_language + 5 * rows_per_language**0.5 + 20
    low = able.select("doc_id", "language", F.xxhash64(F.lit("sample"), "doc_id").alias("place")).join(F.broadcast(frequent), "language")
    low = low.where((F.col("place").bitwiseAND((1 << 52) - 1) / F.lit(float(1 << 52))) * F.col("n") <= enough)
    first = Window.partitionBy("language").orderBy("place", "doc_id")
    ranked = low.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= rows_per_language)
    chosen = saved(ranked.select("doc_id", "language").distinct())
    sample = able.join(F.broadcast(chosen), ["doc_id", "language"], "left_semi").select("language", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_language: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column("language").to_pylist(), b.column("text").to_pylist()):
                by_language.setdefault(lang, []).append(_fold(text))
            for lang, texts in by_language.items():
                packed, starts, ends = _grams(texts, order)
                inside = np.zeros(len(packed) + 1, np.int64)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                grams, n = np.unique(packed[np.cumsum(inside)[:-1] > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["language", "gram", "n"])

    counts = sample.mapInArrow(count, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    found = counts.toPandas() if spark else None
    return ContextTrees(order, sorted(found.language.unique()), found)


def identify(docs: DataFrame, trees: ContextTrees, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) for every row of docs (doc_id, text).

    Each language codes the whole lower-cased text; the shortest code wins, equal ones go to the first by name. score is
    the winner's share when every language weighs 2 ** -bits, so it is 1 / languages where none differ. A text that is
    null or has no letter, or any text when no language was learned, gets `und` and score 0. Only the text is read. A null
    doc_id is not held out. Repeated rows give repeated rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = _Scorer(trees)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                texts = [t if t is not None and trees.languages and next(filter(str.isalpha, t), None) else None for t in b.column("text").to_pylist()]
                folded = [_fold(t) if t else b"" for t in texts]
                bits = scorer.lengths(folded)
                out = []
                for t, f, row in zip(texts, folded, bits):
                    if t is None:
                        out.append(("und", 0.0, None))
                    else:
                        best = int(row.argmin())
                        out.append((trees.languages[best], float(1 / np.exp2(row[best] - row).sum()), float(row[best] / len(f))))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")
    held_out = F.coalesce(_remainder("doc_id", folds) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def keep_known(docs: DataFrame, least_score: float = 0.5, most_bits: float = 12.0, slack_bits: float = 256.0, folds: int = 5) -> DataFrame:
    """Rows of docs, all columns, without those whose language is `und`, scores below least_score, or is none that was
    learned: even the best tree needs over most_bits a byte and slack_bits more. Bytes never seen in training cost over 20
    bits, text of a learned language 3 to 4, and a short one with a license line or the like up to 10.

    The same trees and scores as identify; the decision is taken where the text is, so nothing is joined or shuffled.
    """
    trees = train(docs, folds=folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = _Scorer(trees)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                texts = [t if t is not None and trees.languages and next(filter(str.isalpha, t), None) else "" for t in b.column("text").to_pylist()]
                folded = [_fold(t) for t in texts]
                good = []
                for f, row in zip(folded, scorer.lengths(folded)):
                    known = bool(f) and row.min() <= most_bits * len(f) + slack_bits
                    good.append(known and float(1 / np.exp2(row.min() - row).sum()) >= least_score)
                yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
