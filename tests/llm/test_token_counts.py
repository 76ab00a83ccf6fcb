"""Operator 5: white space inside pieces does not hide double blanks and empty lines."""

from newsgrid.llm import segments


def test_tabs_do_not_make_up_for_line_feeds():
    path = segments.vocabulary("byte_bpe_50k.json")
    texts = ["a\tb\tc\n\n", "a\tb  c", "a\u00a0b\u00a0c\n\n\nd", "a\tb c\n", "plain text\nof two lines"]
    library = segments.load(path)
    assert segments.TokenCounter(path).counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
