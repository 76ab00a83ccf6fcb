"""The keyword index against a scan: plans, appends, rare and absent words, negative and repeated ids."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from newsgrid.operators import keyword_index as I


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    vocabulary = ["the"] * 8 + ["protest", "paris", "talks"] * 3 + [f"w{i}" for i in range(60)]
    return [(i * 40_000 - 70_000, " ".join(r.choice(vocabulary) for _ in range(5)).upper(), f"a-{r.choice(vocabulary)}/b.html" if i % 5 else None) for i in range(300)]


@pytest.fixture(scope="module")
def index(spark, rows):
    name = f"test_index_{uuid.uuid4().hex}"
    frame = spark.createDataFrame([*rows, (None, "the", "the")], "id long, headline string, url string")
    for part in (frame.where("id < 3000000"), frame.where("id >= 3000000"), frame.where("id BETWEEN 2000000 AND 4000000")):
        I.append(part, name, "id", I.words("headline", "url"), buckets=8)
    yield name, frame
    spark.sql(f"DROP TABLE {name}")


def scanned(rows, wanted):
    def words(r):
        return set("".join(c if c.isalnum() else " " for c in f"{r[1]} {r[2] or ''}".lower()).split())

    return sorted(r[0] for r in rows if set(wanted) <= words(r))


@pytest.mark.parametrize("wanted", [["the"], ["the", "paris"], ["paris", "the", "protest", "a"], ["w3"], ["w3", "the", "the"], ["html", "b", "talks"]])
def test_as_a_scan_finds(spark, rows, index, wanted):
    name, frame = index
    got = sorted(r.id for r in I.matching(spark, name, wanted).collect())
    assert got == scanned(rows, wanted) and len(got) > 0
    assert sorted(r.id for r in I.search(frame, name, wanted, "id").collect()) == got


def test_absent_and_no_words(spark, index):
    assert I.matching(spark, index[0], ["the", "absent"]).count() == 0
    assert I.matching(spark, index[0], []).count() == 0


def test_only_the_buckets_of_the_words_are_read(spark, index):
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "256")  # no two files in one partition
    try:
        table = spark.table(index[0])
        every, one = table.rdd.getNumPartitions(), table.where("token = 'paris'").rdd.getNumPartitions()
        plan = table.where("token = 'paris'")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set(size, before)
    assert 0 < one * 4 <= every
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,paris)]" in plan


def test_a_list_is_bounded_by_its_block(spark):
    many = spark.range(200_000).select("id", F.lit("the").alias("text"))
    sizes = [(r.block, r.n) for r in I.postings(many, "id", I.words("text")).select("block", "n").collect()]
    assert sorted(sizes) == [(0, 65536), (1, 65536), (2, 65536), (3, 200_000 - 3 * 65536)]
