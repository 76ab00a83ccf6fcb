"""The encoders of operators 3, 5 and 10 against the library on random strings of awkward pieces."""

import random

from newsgrid.llm import segments

PIECES = (
    ["a", "B", "foo", "Bar", "ALİ", "İ", "ı", "ß", "ẞ", "É", "é", "́", "ﬁ", "ſ", "ŉ", "ǰ", "Ω", "ς", "Σ", "ª", "²", "中", "😀", "Ⅷ"]
    + ["'s", "'", "don't", "12", "3", "_", "...", "!?", "--", ".", ",", "(", ")", "&&&", "[", "]", "\\", "`", "~", "/", "<", "<|endoftext|>"]
    + ["\t", "\n", "\n\n", " ", "  ", "\xa0", " ", "\r", "\x1c", "\x85"]
)


def test_random_strings():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 9))) for _ in range(50_000)]
    words, counts = segments.vocabulary("word_bpe_49k.json"), segments.vocabulary("byte_bpe_50k.json")
    encoder, counter = segments.WordEncoder(words, most=3000), segments.TokenCounter(counts, most=3000)
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        want = [x.ids for x in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(part)] == want
        assert counter.counts(part) == [len(x.ids) for x in counter.tokenizer.encode_batch(part, add_special_tokens=False)]
