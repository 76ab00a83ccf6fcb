"""Words that begin no name of a small dictionary are not taken from the texts; a large one is met all the same."""

from newsgrid.operators import places as P

TEXT = "one two three New York City four, york " * 50


def test_only_first_words_meet_the_dictionary(spark, monkeypatch):
    docs = spark.createDataFrame([(1, TEXT), (2, "five six"), (3, None)], "doc_id long, text string")
    index = P.name_index(spark.createDataFrame([("New York",), ("York",), ("Zulu",)], "name string"))
    found = P.mentions(docs, index)
    rows = sorted(tuple(r) for r in found.collect())
    assert len(rows) == 150 and {r[2] for r in rows} == {"New York", "York"}
    # the words are told apart before the join, so that the text's other 350 are in no row
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "zulu" in plan and "size(transform" not in plan and "size(filter" not in plan
    monkeypatch.setattr(P, "_FEW", 1)
    assert sorted(tuple(r) for r in P.mentions(docs, index).collect()) == rows
