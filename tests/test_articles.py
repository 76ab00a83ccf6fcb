"""Articles from HTML, length gates, numbers and sentences: values by hand."""

from newsgrid.operators import texts as X

PAGE = """<html><head><title> The &amp; title </title><style>p {x}</style></head><body><nav><p>Navigation that is long enough to count</p></nav>
<ARTICLE class="a"><p>First paragraph,<b>bold</b> and &lt;long&gt; enough.</p><p>Too short.</p><script>var p = "<p>a script paragraph, long enough</p>";</script>
<p class='x'>Second   paragraph&nbsp;that
runs over lines.</p></ARTICLE><p>A paragraph outside of the article element.</p></body></html>"""
PLAIN = "<h1>Only a heading</h1><p>This page has no article, but one paragraph.</p><footer><p>A footer paragraph, quite long.</p></footer>"


def test_articles(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", PLAIN), (3, "w", None), (4, "x", ""), (5, "y", "<p>unclosed paragraph of some length")], "page_id long, url string, html string")
    got = {r.page_id: (r.title, r.text) for r in X.article(pages).collect()}
    assert got == {
        1: ("The & title", "First paragraph, bold and <long> enough. Second paragraph that runs over lines."),
        2: ("Only a heading", "This page has no article, but one paragraph."),
        3: (None, ""),
        4: (None, ""),
        5: (None, ""),
    }


def test_gates(spark):
    rows = spark.createDataFrame([(1, "x" * 149), (2, "x" * 150), (3, "x" * 12000), (4, "y" * 12001)], "page_id long, text string")
    assert {r.page_id: (r.status, len(r.text)) for r in X.gated(rows).collect()} == {1: ("short", 149), 2: ("ok", 150), 3: ("ok", 12000), 4: ("cut", 12000)}


def test_numbers(spark):
    docs = spark.createDataFrame([(1, "Of 1,234 people 5.5% left on 2024-01-02, -7 in May 3, 2024, and 12 in 1999; v2 and 3.4.5 stay."), (2, None), (3, "none")], "doc_id long, text string")
    got = [(r.doc_id, r.position, r.raw, r.value, r.is_percent) for r in X.numbers(docs).orderBy("doc_id", "position").collect()]
    assert got[:4] == [(1, 0, "1,234", 1234.0, False), (1, 1, "5.5%", 5.5, True), (1, 2, "-7", -7.0, False), (1, 3, "12", 12.0, False)]
    assert {r[0] for r in got} == {1} and not any(r[2] in ("2024", "1999", "2", "3") and r[1] < 4 for r in got)


def test_grounded_numbers(spark):
    stated = spark.createDataFrame([(1, 0, "1,234", 1234.0, False), (1, 1, "9", 9.0, False), (1, 2, "30.1%", 30.1, True), (1, 3, "2000", 2000.0, False), (1, 4, "5%", 5.0, True)], "doc_id long, position int, raw string, value double, is_percent boolean")
    facts = spark.createDataFrame([(1230.0,), (0.301,), (1985.0,)], "value double")
    assert sorted(r.position for r in X.ungrounded(stated, facts).collect()) == [3, 4]


def test_sentences(spark):
    docs = spark.createDataFrame([(1, "Dr. Who met J. Smith. He left! Did he? Yes: at 3.5 km. and more.\nÉté came."), (2, ""), (3, None), (4, "No end")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n, r.sentence) for r in X.sentences(docs).collect())
    assert got == [(1, 0, "Dr. Who met J. Smith."), (1, 1, "He left!"), (1, 2, "Did he?"), (1, 3, "Yes: at 3.5 km. and more."), (1, 4, "Été came."), (4, 0, "No end")]
