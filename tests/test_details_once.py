"""Detail requests: events and what is derived from them are computed once, not for requests and answers each."""

from newsgrid.registry import QUERIES


def test_answers_read_stored_rows(spark):
    found = QUERIES["b20_event_details"](spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if f.endswith("events.parquet")]
