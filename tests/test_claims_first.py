"""Record claims: what dates and counts of each cost is asked of sentences with a claim only."""

from newsgrid.operators import reports as P


def test_dates_are_read_after_claims(spark):
    texts = ["Three records on 2024-01-05 each with 7 articles. Nothing happened on January 6, 2024.", "The year 2024 was calm.", "TWO Events on January 6 drew 5 articles each.", None, "Records fell."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    said = P.record_claims(docs)
    assert said.columns == ["doc_id", "n", "sentence", "claimed", "digits", "days", "articles"]
    got = [(r.doc_id, r.n, r.claimed, r.digits, [str(d.low) for d in r.days], [(a.low, a.high) for a in r.articles]) for r in said.orderBy("doc_id", "n").collect()]
    assert got == [(0, 0, 3, False, ["2024-01-05"], [(7, 7)]), (2, 0, 2, False, ["2024-01-06"], [(5, 5)])]
    lines = said._jdf.queryExecution().optimizedPlan().toString().splitlines()
    asks = [x for x in lines if r"\beach\s+" in x]
    assert len(asks) == 1 and "Generate" in asks[0]
    # what stands below it, in order: the text without parentheses, the claims, the sentences
    assert sum("Generate" in x for x in lines[lines.index(asks[0]) + 1 :]) == 3
