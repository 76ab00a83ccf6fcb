"""Texts, pages and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.operators import texts as X
from newsgrid.registry import query


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("k01_articles")
def _articles(spark, sf_dir):
    return X.gated(X.article(_read(spark, sf_dir, "pages")))


@query("k05_numbers")
def _numbers(spark, sf_dir):
    return X.numbers(_read(spark, sf_dir, "documents"))


@query("k06_ungrounded_numbers")
def _ungrounded(spark, sf_dir):
    facts = _read(spark, sf_dir, "orders").select(F.round("o_totalprice", 0).alias("value"))
    return X.ungrounded(X.numbers(_read(spark, sf_dir, "documents")), facts)


@query("k08_sentences")
def _sentences(spark, sf_dir):
    return X.sentences(_read(spark, sf_dir, "documents"))


@query("k12_known_place", "SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '(?i)\\b(New York City|New York|Texas|Ohio)\\b', 1), '') AS place FROM documents")
def _place(spark, sf_dir):
    return X.known_place(_read(spark, sf_dir, "documents"), ["Texas", "New York", "New York City", "Ohio"])


@query(
    "g14_nearest_vectors",
    "SELECT query_id, vec_id, round(cosine, 9) AS cosine, rank FROM (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(c.embedding, lambda x: x::DOUBLE)) AS cosine, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(c.embedding, lambda x: x::DOUBLE)) DESC, c.vec_id) AS INTEGER) AS rank FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10",
)
def _nearest(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    return X.nearest(vectors.where(F.col("vec_id") % 50 == 0), vectors, 10).withColumn("cosine", F.round("cosine", 9))
