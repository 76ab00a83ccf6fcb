"""Operators 3, 5 and 10 against the tokenizers library on whole texts."""

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from newsgrid.llm import segments
from newsgrid.llm.common import shared_folder
from newsgrid.llm.packing import combinations, pack, sequences, solve_counts
from newsgrid.llm.token_counts import count_tokens
from newsgrid.llm.token_files import find_documents, ids_crc32, read_token_files, write_token_files

ODD = [
    None,
    "",
    " ",
    "\n",
    "plain words here",
    "two  blanks and\ttabs \n\n lines ",
    "line one\nline two don't it's\nDON'T",
    "<|endoftext|> inside <|endoftext|>text<|startoftext|> <|ENDOFTEXT|>",
    "naïve café é ́x ΑΣ İstanbul ß ﬁ",
    "a b c\x1cd\x85e \x00f",
    "数字 123 456.78 ... !!! 😀😀 été\r\nend",
    "x" * 5000,
    "word " * 9000,
    "ab, cd. " * 4000 + "end",
    " lead and trail ",
]


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", "s", 1, "clash") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string"
    df = spark.createDataFrame(rows, schema)
    return df if extra else df.select("doc_id", "text")


@lru_cache
def library(name):
    return segments.load(segments.vocabulary(name))


def whole(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts_are_the_librarys(spark):
    rows = {r.doc_id: r for r in count_tokens(frame(spark, ODD)).collect()}
    assert len(rows) == len(ODD)
    for i, t in enumerate(ODD):
        n = len(whole("byte_bpe_50k.json", t))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 1024), t


def test_counts_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in count_tokens(docs).collect():
        assert r.n_tokens == len(whole("byte_bpe_50k.json", texts[r.doc_id]))


def test_memo_is_bounded():
    counter = segments.TokenCounter(segments.vocabulary("byte_bpe_50k.json"), most=3)
    texts = ["a b c d", "e f g h", "a f c z"]
    assert counter.counts(texts) == [4, 4, 4]
    encoder = segments.WordEncoder(segments.vocabulary("word_bpe_49k.json"), most=3)
    for group in (texts, ["a. a, a", "a. b"], ["x. É. é, a."], ODD[1:], texts):
        assert [list(x) for x in encoder.encode(group)] == [whole("word_bpe_49k.json", t) for t in group]


def test_safe_chunks_lose_nothing():
    text = "ab cd  ef " * 500
    parts = segments.safe_chunks(text, 64)
    assert "".join(parts) == text and len(parts) > 20


def test_token_files_round_trip(spark):
    path = shared_folder(spark)
    texts = [*ODD[::-1], "same", "same"]
    write_token_files(frame(spark, texts).repartition(5), path)
    rows = read_token_files(spark, path).collect()
    start = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*whole("word_bpe_49k.json", texts[r.doc_id]), 1]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        start += len(ids)
    digests = {r.doc_id: r.ids_crc32 for r in ids_crc32(read_token_files(spark, path)).collect()}
    assert digests == {r.doc_id: crc(r.ids) for r in rows}
    assert [r.doc_id for r in find_documents(spark, path, [3]).collect()] == [3]


def test_token_files_of_nothing(spark):
    path = shared_folder(spark)
    write_token_files(frame(spark, ODD).limit(0), path)
    assert ids_crc32(read_token_files(spark, path)).count() == 0


def check_packing(texts, rows, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids, at = [*whole("word_bpe_49k.json", t), 2], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    fills = []
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        fills.append(at)
    assert max(fills) <= window and sum(f < window for f in fills) <= 1
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("window", [16, 4096])
def test_packing_keeps_every_id_once(spark, window):
    texts = [*ODD, *(" ".join(["ab"] * (k % 23)) for k in range(200))]
    rows = pack(frame(spark, texts).repartition(3), window=window).collect()
    check_packing(texts, rows, window)


def test_packing_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    check_packing([r.text for r in docs.collect()], pack(docs).collect(), 4096)


def test_packing_nothing_and_repeats(spark):
    assert pack(frame(spark, ODD).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "ab cd"), (1, "ab cd"), (None, None)], "doc_id long, text string")
    rows = pack(twice, window=4).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 1


def test_equal_rows_cut_at_different_places_keep_their_sums(spark):
    text = "ab cd ef gh ij kl mn op qr st"
    ids = [*whole("word_bpe_49k.json", text), 2]
    rows = pack(spark.createDataFrame([(7, text)] * 12, "doc_id long, text string"), window=16).collect()
    assert sum(r.length for r in rows) == 12 * len(ids) and any(r.length < len(ids) for r in rows)
    assert all(r.ids_crc32 == crc(ids[r.start : r.start + r.length]) for r in rows)


def test_sequences_hold_the_ids(spark):
    texts = ["ab cd ef", "gh " * 30, None, "ij"]
    docs = frame(spark, texts)
    pieces = pack(docs, window=16)
    rows = sequences(docs, pieces, window=16).collect()
    assert all(len(r.ids) == 16 for r in rows)
    assert sum(r.n_ids for r in rows) == sum(len(whole("word_bpe_49k.json", t)) + 1 for t in texts)


def test_least_squares_uses_exact_fills():
    hist = np.zeros(17, np.int64)
    hist[[4, 12, 8, 5, 6]] = [100, 80, 40, 30, 60]
    lengths = np.flatnonzero(hist)
    patterns = combinations(lengths, hist[lengths] * lengths, 16, 3, 500)
    assert all(sum(p) == 16 for p in patterns.tolist())
    counts = solve_counts(hist, patterns)
    used = np.zeros(17, np.int64)
    for p, n in zip(patterns.tolist(), counts.tolist()):
        for a in p:
            used[a] += n if a else 0
    assert (used <= hist).all() and (used * np.arange(17)).sum() >= 0.9 * (hist * np.arange(17)).sum()
