"""Own columns with the names that operators use inside come back as they were."""

import pytest

from chronoweave.llm import line_dedup, mixing, quality_cnn

NAMES = ["_size", "_key", "_bucket", "_id", "_source", "_s", "_i", "epochs", "_last", "_cut", "_gone", "_doc", "_own", "line_no", "none", "_score0"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"line of words number {i}\nthe same line in each text\nown {i}", "s" + str(i % 3), *[1000 * i + k for k in range(len(NAMES))]) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in NAMES))


def check(out, docs):
    got = out.collect()
    assert got
    for r in got:
        assert [r[n] for n in NAMES] == [1000 * r.doc_id + k for k in range(len(NAMES))]
    assert [c for c in out.columns if c in docs.columns] == docs.columns


def test_mixing_clashes(docs):
    check(mixing.mixed(docs), docs)
    out = mixing.mix(docs.withColumnRenamed("line_no", "copies").withColumnRenamed("copies", "line_no"))
    check(out, docs)
    assert mixing.mix(docs.withColumnRenamed("none", "taken")).where("taken <> 1000 * doc_id + 14").count() == 0


def test_line_dedup_clashes(docs):
    check(line_dedup.deduplicated(docs), docs)
    check(line_dedup.keep_new_lines(docs), docs)


def test_quality_clashes(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    check(quality_cnn.keep_good(docs, labels), docs)
