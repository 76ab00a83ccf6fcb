"""Stages leave the caller's columns alone, whatever they are called."""

from newsgrid.llm.common import unused
from newsgrid.llm.line_dedup import dedup_lines
from newsgrid.llm.mixing import take_mix
from newsgrid.llm.near_dedup import keep_first

NAMES = ["line_doc", "line_removed", "near_doc", "mix_doc", "mix_text", "mix_source", "MIX_COPIES", "removed", "d", "keys", "id", "bucket"]


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", s, 0, *NAMES) for i, t, s in rows], schema)


def test_clashing_names(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = frame(spark, [(1, text, "a"), (2, text + " more", "a"), (3, "something else altogether here", "b"), (None, None, None), (5, "", None)])
    for stage, ids in ((dedup_lines, [1, 2, 3, 5, None]), (keep_first, [1, 3, 5, None])):
        rows = stage(docs).collect()
        assert sorted(r.doc_id or 99 for r in rows) == sorted(i or 99 for i in ids), stage
        assert all([r[n] for n in NAMES] == NAMES for r in rows) and set(rows[0].asDict()) == set(docs.columns)
    taken = take_mix(docs)
    assert taken.columns == docs.columns and all([r[n] for n in NAMES] == NAMES for r in taken.collect())
    assert unused(docs, "Removed") == "Removed_"


def test_equal_ids_are_taken_by_text_and_source(spark):
    rows = [(1, "one two three", "a"), (1, "four five six seven", "b"), (1, "one two three", "a")] + [(i, "x y z " * (i % 7), "ab"[i % 2]) for i in range(10, 60)]
    docs = frame(spark, rows)
    words = sum(len((r.text or "").split()) for r in take_mix(docs).collect())
    total = sum(len(t.split()) for _, t, _ in rows)
    assert abs(words - 1.5 * total) <= 8
