"""Operators over texts, web pages and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements whose content is no article text, and names of months.
_NOISE = "script|style|nav|footer|header|aside|noscript"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_DATE = rf"\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b(?:{_MONTHS})\s+\d{{1,2}}(?:,\s*\d{{4}})?\b|\b(?:19|20)\d{{2}}\b"


def _plain(html: Column) -> Column:
    """Without tags and with single blanks."""
    text = F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"&nbsp;", " ")
    return F.trim(F.regexp_replace(F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")), r"\s+", " "))


def article(pages: DataFrame, least: int = 20) -> DataFrame:
    """pages (page_id, url, html) with title and text: noise elements dropped, article or main preferred, paragraphs of over
    `least` characters joined by blanks. The title is the title element's, else the first h1's."""
    clean = F.regexp_replace(F.coalesce("html", F.lit("")), rf"(?is)<({_NOISE})\b[^>]*>.*?</\1>", " ")
    body = F.coalesce(F.nullif(F.regexp_extract(clean, r"(?is)<(article|main)\b[^>]*>(.*?)</\1>", 2), F.lit("")), clean)
    paragraphs = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), _plain), lambda p: F.length(p) > least)
    title = F.coalesce(F.nullif(_plain(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit("")), F.nullif(_plain(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), F.lit("")))
    return pages.select("page_id", "url", title.alias("title"), F.array_join(paragraphs, " ").alias("text"))


def gated(articles: DataFrame, least: int = 150, most: int = 12000) -> DataFrame:
    """articles with status: too short, cut, or ok; texts over `most` characters are cut there."""
    n = F.length("text")
    return articles.withColumns({"status": F.when(n < least, "short").when(n > most, "cut").otherwise("ok"), "text": F.left("text", F.lit(most))})


def numbers(docs: DataFrame) -> DataFrame:
    """(doc_id, position, raw, value, is_percent): numbers of each text that are no part of a date or year."""
    undated = F.regexp_replace(F.coalesce("text", F.lit("")), _DATE, " ")
    raws = F.regexp_extract_all(undated, F.lit(r"(?<![\w.])-?\d[\d,]*(?:\.\d+)?%?"), 0)
    rows = docs.select("doc_id", F.posexplode(raws).alias("position", "raw"))
    value = F.expr("try_cast(replace(replace(raw, '%', ''), ',', '') AS double)")
    return rows.withColumns({"value": value, "is_percent": F.col("raw").endswith("%")})


def ungrounded(stated: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of stated (doc_id, position, value, is_percent) with no fact (value) within max(0.051, 0.5 %) of them.

    Plain numbers below 10 are not judged; a percentage also matches a fact that is a fraction. Both sides meet on
    rounded logarithms, a value on its own bucket and its neighbours, so the tolerance join is one by equality.
    """
    size = lambda v: F.floor(F.log1p(F.abs(v)) * 10)
    judged = stated.where(F.col("is_percent") | (F.abs("value") >= 10))
    plain = facts.select(F.abs("value").alias("c"), F.lit(False).alias("scaled")).unionByName(facts.select((F.abs("value") * 100).alias("c"), F.lit(True).alias("scaled"))).distinct()
    near = plain.withColumn("bucket", F.explode(F.array(size(F.col("c")) - 1, size(F.col("c")), size(F.col("c")) + 1)))
    stated_at = judged.withColumn("at", size(F.col("value")))
    v = F.abs(stated_at["value"])
    close = (F.abs(v - near["c"]) <= F.greatest(F.lit(0.051), near["c"] * 0.005)) & (~near["scaled"] | stated_at["is_percent"])
    return stated_at.join(near, (stated_at["at"] == near["bucket"]) & close, "left_anti").drop("at")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sentence): split after ., ! or ? before a blank and a capital, but not after a one-letter or known abbreviation."""
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?<!\b(?:[A-Z]|Mr|Mrs|Dr|St|No|vs|Gov|Sen|Rep)\.)(?<=[.!?])\s+(?=\p{Lu})", "\u0001")
    return docs.select("doc_id", F.posexplode(F.split(marked, "\u0001")).alias("n", "sentence")).where(F.trim("sentence") != "")


def known_place(docs: DataFrame, places: list[str]) -> DataFrame:
    """(doc_id, place): the first of the named places in each text, the longest where several begin there. A short list."""
    ordered = sorted(places, key=lambda p: (-len(p), p))
    pattern = r"(?i)\b(" + "|".join(r"\Q" + p + r"\E" for p in ordered) + r")\b"
    return docs.select("doc_id", F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), pattern, 1), F.lit("")).alias("place"))


class _Best:
    """The n best vectors of each query so far, by cosine, then id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, n: int):
        self.ids, self.vectors, self.n = ids, vectors, n
        self.squares = _in_order(vectors, vectors)
        self.unit = vectors / np.sqrt(self.squares)[:, None]
        self.floor = np.full(len(ids), -np.inf)
        self.query, self.vec, self.cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """A product of matrices says which pairs come near a floor; only their cosines are added up in order."""
        squares = _in_order(vectors, vectors)
        about = self.unit @ (vectors / np.sqrt(squares)[:, None]).T
        floor = self.floor
        if len(ids) > self.n and not np.isfinite(floor).all():
            # one more than n, as a query may meet itself; repeated ids, more than once
            once = np.unique(ids).size == len(ids)
            floor = np.maximum(floor, np.partition(about, -self.n - 1, axis=1)[:, -self.n - 1] if once else -np.inf)
        q, v = np.nonzero((about >= floor[:, None] - 1e-9) & (self.ids[:, None] != ids[None, :]))
        if not len(q):
            return
        parts = [slice(at, at + (1 << 16)) for at in range(0, len(q), 1 << 16)]
        dots = np.concatenate([_in_order(self.vectors[q[p]], vectors[v[p]]) for p in parts])
        cosine = dots / np.sqrt(self.squares[q] * squares[v])
        query, vec, cosine = np.concatenate([self.query, q]), np.concatenate([self.vec, ids[v]]), np.concatenate([self.cosine, cosine])
        order = np.lexsort([vec, -cosine, query])
        query, vec, cosine = query[order], vec[order], cosine[order]
        first = np.searchsorted(query, np.arange(len(self.ids)))
        rank = np.arange(len(query)) - first[query]
        last = rank == self.n - 1
        self.floor[query[last]] = cosine[last]
        kept = rank < self.n
        self.query, self.vec, self.cosine = query[kept], vec[kept], cosine[kept]


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up from the first component to the last, as an aggregate over arrays does."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _nearest_plain(queries: DataFrame, vectors: DataFrame, n: int, size: int, shards: int, most: int) -> DataFrame:
    """(query_id, vec_id, cosine): at least the n best of each query, of vectors with `size` components and a length.

    Queries are dealt to groups of about `most`, vectors to shards; a cell of a group and a shard holds its queries and
    streams its vectors past them, so a task keeps n rows a query. Vectors are copied once for each group.
    """
    groups = max(1, -(-queries.count() // most))
    part = lambda name, c, of: F.pmod(F.xxhash64(F.lit(name), c), F.lit(of))
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)).cast("array<bigint>"))
    of_queries = queries.select(F.lit(0).alias("kind"), part("group", "vec_id", groups).alias("group"), each(shards).alias("shard"), F.col("vec_id").cast("long").alias("id"), "v")
    of_vectors = vectors.select(F.lit(1).alias("kind"), each(groups).alias("group"), part("shard", "vec_id", shards).alias("shard"), F.col("vec_id").cast("long").alias("id"), "v")
    cells = of_queries.unionByName(of_vectors).select((F.col("group") * shards + F.col("shard")).alias("cell"), "kind", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, best, ids, held = None, None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.query]), pa.array(best.vec), pa.array(best.cosine)], ["query_id", "vec_id", "cosine"])

        for b in batches:
            keys = b.column("cell").to_numpy() * 2 + b.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for x, y in zip(edges[:-1], edges[1:]):
                if y == x:
                    continue
                now, kind = divmod(int(keys[x]), 2)
                if now != cell:
                    yield from out()
                    cell, best, ids, held = now, None, [], []
                own = b.column("id").slice(x, y - x).to_numpy()
                rows = b.column("v").slice(x, y - x).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                if kind == 0:
                    ids.append(own)
                    held.append(rows)
                elif ids:
                    best = best or _Best(np.concatenate(ids), np.concatenate(held), n)
                    for at in range(0, len(own), 512):
                        best.add(own[at : at + 512], rows[at : at + 512])
        yield from out()

    dealt = cells.repartition(groups * shards, "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(run, "query_id long, vec_id long, cosine double")


def nearest(queries: DataFrame, vectors: DataFrame, n: int, blocks: int = 16, shards: int = 32, most: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, cosine) of the n nearest vectors to each query. Ids are whole numbers.

    Every query is compared with every vector: by products of matrices in the tasks, which settle the pairs that are far
    from a query's n best; the others' cosines are those of plain sums in order. Pairs in which a vector is null or empty,
    has null or non-finite components, no length or another size than most others have no such bound. They are compared by
    array functions: vectors are dealt to blocks by a hash of their id, and each query meets every block, of which each
    keeps n rows a query.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = F.coalesce(finite & F.exists("embedding", lambda x: F.abs(x) > 1e-60) & F.forall("embedding", lambda x: F.abs(x) < 1e60), F.lit(False))
    usual = vectors.where(able).groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = usual["size"] if usual else 0
    plain = F.coalesce(able & (F.size("embedding") == size), F.lit(False)) & F.col("vec_id").isNotNull()
    typed = vectors.schema["vec_id"].dataType
    best = lambda *by: F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc("cosine"), "vec_id"))
    odd = _nearest_odd(queries.where(~plain), vectors, n, blocks).unionByName(_nearest_odd(queries.where(plain), vectors.where(~plain), n, blocks))
    near = odd
    if usual:
        kept = lambda df: df.where(plain).select("vec_id", F.col("embedding").alias("v"))
        found = _nearest_plain(kept(queries), kept(vectors), n, size, shards, most)
        near = found.select(F.col("query_id").cast(typed).alias("query_id"), F.col("vec_id").cast(typed).alias("vec_id"), "cosine").unionByName(odd)
    return near.withColumn("rank", best()).where(F.col("rank") <= n).select("query_id", "vec_id", "cosine", "rank")


def _nearest_odd(queries: DataFrame, vectors: DataFrame, n: int, blocks: int) -> DataFrame:
    """(query_id, vec_id, cosine): the n best of each query and block by array functions."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), dot("embedding", "embedding").alias("qq"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    c = vectors.select("vec_id", F.col("embedding").alias("v"), dot("embedding", "embedding").alias("vv"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    score = dot("q", "v") / F.sqrt(F.col("qq") * F.col("vv"))
    rows = c.join(q, "block").where(F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", score.alias("cosine"), "block")
    order = Window.partitionBy("query_id", "block").orderBy(F.desc("cosine"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "vec_id", "cosine")
