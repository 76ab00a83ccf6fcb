"""Operator 11 against the library whose rank files it reads, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import pytest
import regex

from newsgrid.llm import byte_bpe
from newsgrid.llm.segments import vocabulary

NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
PIECES = ["the ", " ", "\n", "  ", "a", "bc", "é", "ß", "日本", "1", "23", "'s", "'", "!", "<|endoftext|>", "▁", "Ġ", "\0", "\x1c", " ", "🙂", "Ā", "ing", " tion", "x" * 90, "\t", "\r", "İ", "<unk>"]


def library(name):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(vocabulary(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(bpe, text):
    (ids,) = bpe.encode([text])
    return ids.tolist()


@pytest.mark.parametrize("name", NAMES)
def test_strings_as_the_library_has_them(name):
    ours, theirs, r = byte_bpe.ByteBpe(vocabulary(name), None, 200), library(name), random.Random(3)
    for _ in range(400):
        texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 25))) for _ in range(5)]
        texts += [" ".join(r.choice(["the", "cat's", "x1", "日本", "!'s", "a\nb", "é"]) for _ in range(r.randint(1, 9))) for _ in range(5)]
        for text, ids in zip(texts, ours.encode(texts), strict=True):
            assert ids.tolist() == theirs.encode_ordinary(text)
            assert ours.decode(ids) == text.encode()
    assert len(ours.starts) < 1000


def test_every_token_is_reached_and_decoded():
    ours = byte_bpe.ByteBpe(vocabulary(NAMES[0]))
    tokens = byte_bpe.read_ranks(vocabulary(NAMES[0]))
    assert ours.bytes == tokens
    assert [i for (i,) in ours.model.encode([byte_bpe.letters(t) for t in tokens], out_type=int)] == list(range(len(tokens)))


def test_the_pattern_splits_every_character_as_the_library_does():
    theirs, from_pattern = library(NAMES[0]), byte_bpe.ByteBpe(vocabulary(NAMES[0]))
    chars = [chr(c) for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for c in chars:
        text = f"a{c}{c} {c}1"
        assert encode(from_pattern, text) == theirs.encode_ordinary(text), hex(ord(c))


def test_texts_beyond_one_chunk():
    ours, theirs, r = byte_bpe.ByteBpe(vocabulary(NAMES[0])), library(NAMES[0]), random.Random(5)
    words = ["ab" * r.randint(1, 9) + r.choice(["", "\n", "  ", "é"]) for _ in range(3000)]
    text = " ".join(r.choice(words) for _ in range(250_000))
    assert len(text) > 2 << 20 and encode(ours, text) == theirs.encode_ordinary(text)
    one_word = "".join(chr(r.randint(97, 122)) for _ in range(100_000))
    assert encode(ours, one_word) == theirs.encode_ordinary(one_word)


def test_files_with_gaps_or_without_all_bytes(tmp_path):
    with pytest.raises(ValueError):
        byte_bpe.serialised([b"a", b"b"])
    file = tmp_path / "ranks"
    file.write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(file))


def test_rows(spark):
    rows = [(1, "The  end", "c", "d"), (1, "The  end", "c", "d"), (2, None, "c", "d"), (3, "", "c", "d"), (None, "x", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    encoded = byte_bpe.encode(docs)
    assert encoded.columns == ["doc_id", "ids"]
    theirs = library(NAMES[0])
    got = byte_bpe.decode(encoded).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=key) == sorted(((i, theirs.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows), key=key)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).count() == 0
    none = spark.createDataFrame([(1, None)], "k int, ids array<int>")
    assert [tuple(r) for r in byte_bpe.decode(none).collect()] == [(1, None, None)]
    clash = encoded.withColumn("Decoded", encoded.doc_id)
    assert byte_bpe.decode(clash).columns == ["doc_id", "ids", "decoded"]
    one_a_word = byte_bpe.encode(docs.where("doc_id = 1").limit(1), pattern=r"\S+| +").first()
    assert one_a_word.ids == [i for m in regex.findall(r"\S+| +", "The  end") for i in theirs._core_bpe.encode_single_piece(m.encode())]


def test_query(spark):
    from newsgrid.llm.registry import QUERIES

    folder, theirs = "/root/testdata/sf0.001", library(NAMES[0])
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = theirs.encode_ordinary(text or "")
        want.add((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())))
    got = [tuple(r) for r in QUERIES["op11_byte_bpe"](spark, folder).collect()]
    assert set(got) == want and len(got) == len(spark.read.parquet(f"{folder}/documents.parquet").collect())
