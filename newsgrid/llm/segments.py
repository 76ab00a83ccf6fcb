"""Exact tokenization of whole texts by the tokenizers library, with texts split at safe boundaries.

A boundary is safe when the tokenizer never joins what stands on its two sides; the ids of a text are then those of its
segments, one after the other. Segments repeat, so each worker keeps a bounded memo from segment to ids (or their number)
and hands the library only those it has not met, a batch at a time.
"""

from __future__ import annotations

import codecs
import ctypes
import gc
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Between two characters that are not white space, before a single blank.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def load(path: str):
    """The tokenizer of a .json file; threads are left to Spark."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def safe_chunks(text: str, size: int = 1 << 14) -> list[str]:
    """text cut before a single blank between two words, the first one after each `size` characters."""
    out, at = [], 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def by_bytes(texts: Iterable[str], most: int = 1 << 21) -> Iterator[list[str]]:
    """Groups of texts that hold about as many bytes of UTF-8 each."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


class TokenCounter:
    """Number of tokens of a text under a byte-level BPE whose pieces may begin with one blank.

    A text in which every white space is a single blank or line feed between two other characters is split before each
    blank and around each line feed. All other texts go to the library in safe chunks.
    """

    def __init__(self, path: str, most: int = 400_000):
        self.tokenizer, self.most = load(path), most
        self.first: dict[str, int] = {}  # of segments that begin a line
        self.later: dict[str, int] = {}  # of segments after a blank
        self.feed = self._lengths(["\n"])[0]

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, memo: dict[str, int], wanted: set[str], prefix: str) -> None:
        new = list(wanted.difference(memo))
        if len(memo) + len(new) > self.most:
            memo.clear()
            new = list(wanted)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            memo.update(zip(part, self._lengths([prefix + x for x in part])))

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for group in by_bytes(texts):
            out += self._counts(group)
        return out

    def _counts(self, texts: list[str]) -> list[int]:
        split: list[tuple[list[str], list[str]] | None] = []
        first, later = set(), set()
        for t in texts:
            flat = t.replace("\n", " ")
            # equal pieces, not only equally many: no other white space inside one makes up for an empty one
            if not t or flat.split(" ") != flat.split():
                split.append(None)
                continue
            heads, rest = [], []
            for line in t.split("\n"):
                words = line.split(" ")
                heads.append(words[0])
                rest += words[1:]
            first.update(heads)
            later.update(rest)
            split.append((heads, rest))
        self._learn(self.first, first, "")
        self._learn(self.later, later, " ")
        out = []
        for t, parts in zip(texts, split):
            if parts is None:
                out.append(sum(self._lengths(safe_chunks(t))) if t else 0)
            else:
                heads, rest = parts
                out.append(sum(map(self.first.__getitem__, heads)) + sum(map(self.later.__getitem__, rest)) + self.feed * (len(heads) - 1))
        return out


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(i) if i in own else chr(next(other)) for i in range(256)]


class _Memo(dict):
    """A dict that asks learn for what it has not met."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key):
        return self.learn(key)


#: A run of letters below U+0250 but for İ, whose lower case ends in a mark, and ASCII marks around it; an apostrophe may
#: begin a piece of its own, and < a special string.
_MARKED = (
    r"^(?P<head>[!-&(-/:;=-@\[-`{-~]*)(?P<run>[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+)"
    r"(?P<tail>[!-&(-/:;=-@\[-`{-~]*)$"
)


class WordEncoder:
    """Ids of a text under a tokenizer that drops white space: blanks and line feeds are safe boundaries.

    The tokenizer's pieces are runs of letters and runs of marks, among others. Those of words that _MARKED knows go
    straight to the library's model, in lower case; other words go through the whole library. Ids of the words met lie
    in one flat array, up to about `most` words.
    """

    def __init__(self, path: str, most: int = 250_000):
        self.tokenizer, self.most = load(path), most
        self.model, self.letters = self.tokenizer.model, "".join(_byte_letters())
        self.place = _Memo(self._meet)  # of words as they stand
        self.new: list[str] = []
        self.flat, self.starts, self.sizes, self.met = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._no_pieces()

    def _no_pieces(self) -> None:
        self.pieces = {"": 0}  # of pieces in lower case
        self.piece_ids, self.piece_ends = array("i"), array("q", [0, 0])

    def _meet(self, word: str) -> int:
        i = self.place[word] = len(self.starts) + len(self.new)
        self.new.append(word)
        return i

    def _trim(self) -> None:
        """Forget words met once, and all if the others fill half of the memo."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > self.most // 2:
            kept = kept[:0]
        new = np.full(len(self.starts), -1)
        new[kept] = np.arange(len(kept))
        places = new[np.fromiter(self.place.values(), np.int64, len(self.place))].tolist()
        words = [(w, i) for w, i in zip(self.place, places) if i >= 0]
        self.flat, self.sizes = self._gather(kept)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.met = np.zeros(len(kept), np.int64)
        self.place.clear()
        self.place.update(words)
        self._no_pieces()

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, one after the other, and how many each has."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(at) else 0)], sizes

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])

    def _places(self, pieces: list[str]) -> list[int]:
        """Places of pieces among piece_ends."""
        fresh = [x for x in pieces if x not in self.pieces]
        tokenize, ids, ends = self.model.tokenize, self.piece_ids, self.piece_ends
        self.pieces.update(zip(fresh, range(len(ends) - 1, len(ends) - 1 + len(fresh))))
        for x in fresh:
            ids.extend([t.id for t in tokenize(x if x.isascii() else codecs.charmap_decode(x.encode(), "strict", self.letters)[0])])
            ends.append(len(ids))
        return [self.pieces[x] for x in pieces]

    def _odd(self, word: str) -> int:
        """The place of a word that the whole library has to read."""
        self.piece_ids.extend(chain.from_iterable(self.tokenizer.encode(part, add_special_tokens=False).ids for part in safe_chunks(word)))
        self.piece_ends.append(len(self.piece_ids))
        return len(self.piece_ends) - 2

    def _learn(self) -> None:
        words, self.new = pa.array(self.new, pa.string()), []
        found = pc.extract_regex(words, _MARKED)
        three = [pc.fill_null(x, "") for x in (pc.struct_field(found, "head"), pc.utf8_lower(pc.struct_field(found, "run")), pc.struct_field(found, "tail"))]
        pieces = pa.concat_arrays(three).dictionary_encode()
        known = np.array(self._places(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64)
        at = known[np.asarray(pieces.indices)].reshape(3, -1)
        odd = np.flatnonzero(np.asarray(pc.is_null(found)))
        at[0, odd] = [self._odd(w) for w in words.take(pa.array(odd)).to_numpy(zero_copy_only=False)]
        at = at.T.ravel()
        # copies: an array that is viewed cannot grow
        ends, ids = np.array(self.piece_ends), np.array(self.piece_ids)
        starts, sizes = ends[at], ends[at + 1] - ends[at]
        last = np.cumsum(sizes)
        self._add(ids[np.repeat(starts - (last - sizes), sizes) + np.arange(last[-1])], sizes.reshape(-1, 3).sum(1))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """An int32 array of ids for each text, in order."""
        for group in by_bytes(texts):
            if len(self.starts) > self.most:
                self._trim()
            split = pc.split_pattern(pc.replace_substring(pa.array(group, pa.string()), "\n", " "), " ")
            number, words = np.diff(np.asarray(split.offsets)), split.values.dictionary_encode()
            codes, distinct = np.asarray(words.indices), words.dictionary.to_numpy(zero_copy_only=False)
            del split, words
            at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
            if self.new:
                self._learn()
            self.met = np.concatenate([self.met, np.zeros(len(self.starts) - len(self.met), np.int64)])
            self.met[at] += np.bincount(codes, minlength=len(at))
            ids, sizes = self._gather(at[codes])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            last = 0
            for end in ends[np.cumsum(number)].tolist():
                yield ids[last:end]
                last = end


_KEPT: dict[tuple, object] = {}


def kept(kind, *args):
    """One encoder of each kind and file (and what else kind takes) for a worker's whole life."""
    key = (kind.__name__, *args)
    if key not in _KEPT:
        _KEPT[key] = kind(*args)
    return _KEPT[key]


def forget() -> None:
    """Let go of all encoders, and hand what is free back to the system: a worker that turns to another operator, and the
    others of its executor, need the memory. Encoders refer to themselves, so only a collection frees them."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def vocabulary(name: str) -> str:
    """Where the public vocabulary files are on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
