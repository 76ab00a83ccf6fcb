"""Byte-level BPE (operator 11): a sentencepiece model written from the ranks, pre-tokens encoded, ids decoded.

A rank file says which byte strings are tokens and which merge comes first. A sentencepiece BPE model merges the adjacent
pair whose piece has the highest score, the leftmost of equals. So with one letter for each byte, the tokens as pieces,
and their negative ranks as scores, its merges are those of the rank file, and a piece's id is its rank.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from newsgrid.llm.common import table
from newsgrid.llm.segments import _Memo as Memo
from newsgrid.llm.segments import by_bytes, kept, safe_chunks, vocabulary

#: One letter for each byte, from U+0100 on: none is white space or has a meaning of its own in sentencepiece.
_LETTERS = [chr(256 + b) for b in range(256)]
_TO_LETTERS = {b: letter for b, letter in enumerate(_LETTERS)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: a number, a 32-bit float, or bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, from lines of base64 and rank; ranks have to be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: the ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def letters(piece: bytes) -> str:
    return piece.decode("latin-1").translate(_TO_LETTERS)


def serialised(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of these tokens: BPE, no change to the text, ids equal ranks; the unknown piece comes last.

    No text has an unknown piece as long as every byte is a token.
    """
    # fields of ModelProto: 1 pieces (1 piece, 2 score, 3 type; 2 is unknown), 2 trainer (3 kind; 2 is BPE, 40 to 43 ids of unknown,
    # begin, end and padding), 3 normaliser (1 name, 3 dummy prefix, 4 blanks removed, 5 blanks escaped)
    missing = set(range(256)).difference(t[0] for t in tokens if len(t) == 1)
    if missing:
        raise ValueError(f"{len(missing)} bytes are no tokens")
    none = (1 << 64) - 1
    pieces = [_field(1, _field(1, letters(t).encode()) + _field(2, float(-rank))) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Decoder:
    """The byte strings of the pieces of one rank file: letters mapped back to bytes. Without the model, which only encodes."""

    def __init__(self, path: str):
        tokens = read_ranks(path)
        # a letter's number is 256 and its byte: the low half of its two bytes
        self.bytes = [letters(t).encode("utf-16-le")[::2] for t in tokens]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


class ByteBpe(Decoder):
    """Encoder and decoder of one rank file.

    A text in which every white space is a single blank or line feed between two other characters is cut before each
    blank and around each line feed, where the public pattern always begins a match: equal segments have equal ids. All
    other texts, and all under another pattern, are cut into the pattern's matches. Ids of segments lie in one flat array,
    up to about `most` segments; those met once are forgotten first.
    """

    def __init__(self, path: str, pattern: str | None = None, most: int = 200_000):
        import regex
        import sentencepiece
        from public_tokenizers import PATTERN

        super().__init__(path)
        self.split = regex.compile(pattern or PATTERN).findall
        self.plain = pattern in (None, PATTERN)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.bytes))
        self.whole = {letters(t): i for i, t in enumerate(self.bytes)}
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.place = Memo(self._meet)  # of segments: strings to cut by the pattern, matches as tuples of one
        self.new: list = []
        self.flat, self.starts, self.sizes, self.met = np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3))

    def _meet(self, segment) -> int:
        i = self.place[segment] = len(self.starts) + len(self.new)
        self.new.append(segment)
        return i

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments at these places, one after the other, and how many each has."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(at) else 0)], sizes

    def _trim(self) -> None:
        """Forget segments met once, and all if the others fill half of the memo."""
        often = self.met > 1
        if often.sum() > self.most // 2:
            return self._forget()
        segments = [s for s, i in self.place.items() if often[i]]
        kept_at = np.fromiter(map(self.place.__getitem__, segments), np.int64, len(segments))
        flat, sizes = self._gather(kept_at)
        self._forget()
        self.place.update(zip(segments, range(len(segments))))
        self.flat, self.sizes, self.starts, self.met = flat, sizes, np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)

    def _learn(self) -> None:
        """Ids of new segments: a match that is a token is that one; the model merges all others."""
        matches = [x if isinstance(x, tuple) else self.split(x) for x in self.new]
        number = np.fromiter(map(len, matches), np.int64, len(matches))
        mapped = [letters(x.encode()) for x in chain.from_iterable(matches)]
        rest = [x for x in dict.fromkeys(mapped) if x not in self.whole]
        merged = dict(zip(rest, self.model.encode(rest, out_type=int, num_threads=1)))
        ids = [merged[x] if x in merged else (self.whole[x],) for x in mapped]
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])[np.concatenate([[0], np.cumsum(number)])]
        self.starts, self.sizes = np.concatenate([self.starts, len(self.flat) + ends[:-1]]), np.concatenate([self.sizes, np.diff(ends)])
        self.flat, self.met = np.concatenate([self.flat, flat]), np.concatenate([self.met, np.zeros(len(matches), np.int64)])
        self.new = []

    def _segments(self, text: str) -> list:
        if self.plain and "\0" not in text:
            words = text.replace("\n", " ").split(" ")
            # equal pieces, not only equally many: no other white space inside one makes up for an empty one
            if words == text.split():
                return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return [(x,) for x in self.split(text)]

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.starts) > self.most:
            self._trim()
        cut = [self._segments(t) for t in texts]
        segments = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.place.__getitem__, segments), np.int64, len(segments))
        if self.new:
            self._learn()
        self.met += np.bincount(at, minlength=len(self.met))
        ids, sizes = self._gather(at)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, cut)])]
        return (ids[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist()))

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Texts of any length: in chunks cut before a blank between two words."""
        for group in by_bytes(texts):
            chunks = [safe_chunks(t, 1 << 20) if self.plain else [t] for t in group]
            parts = chain.from_iterable(self._group(g) for g in by_bytes(chain.from_iterable(chunks)))
            for own in chunks:
                yield next(parts) if len(own) == 1 else np.concatenate([next(parts) for _ in own])


def _sizes(lengths: pa.Array) -> np.ndarray:
    return pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)


def _runs(sizes: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Neighbouring rows (start, number) of about `most` in size together."""
    groups = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(sizes)]
    for a, z in zip(edges[:-1], edges[1:]):
        if z > a:
            yield a, z - a


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs (doc_id, text): the ids of the whole text, without special tokens.

    ranks: path of a rank file on every machine; the public one by default. pattern: what splits a text before merges. A
    null text counts as empty and has no ids; repeated rows give repeated rows; other columns are ignored; no rows give no
    rows. One pass, no shuffle; a worker holds the ids of about two million bytes of text, or of one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(ByteBpe, ranks or vocabulary("byte_bpe_50k.tiktoken"), pattern)
        for b in batches:
            for a, n in _runs(_sizes(pc.binary_length(b.column("text")))):
                part = b.slice(a, n)
                rows = list(bpe.encode(t or "" for t in part.column("text").to_pylist()))
                ends = np.cumsum([0, *map(len, rows)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, ranks: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the bytes of their ids as a further column `name`, in place of any of that name. Null ids give null, no ids
    no bytes; an id that is no rank, or a null among ids, is an error."""
    rows = rows.drop(name)
    schema = StructType([*rows.schema.fields, StructField(name, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(Decoder, ranks or vocabulary("byte_bpe_50k.tiktoken"))
        for b in batches:
            for a, n in _runs(_sizes(pc.list_value_length(b.column(ids)))):
                part = b.slice(a, n)
                lists = part.column(ids)
                if pc.any(pc.is_null(lists.flatten())).as_py():
                    raise ValueError("a null among ids")
                flat, ends = lists.values.to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
                out = [bpe.decode(flat[x:z]) if known else None for x, z, known in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*b.schema.names, name])

    return rows.mapInArrow(run, schema)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(table(spark, sf_dir, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
