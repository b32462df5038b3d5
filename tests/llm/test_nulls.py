"""Null ids, and rows that are null throughout."""

import public_tokenizers

from chronoweave.llm import ann, bpe, html_extract, license_scan, line_dedup, mixing, quality_cnn, setsketch, toxicity, vector_dedup


def test_null_rows(spark):
    text = "six words that make a line"
    rows = [(None, None, None), (None, text, "s"), (5, text, None), (9_007_199_254_740_993, text + " indeed", "s"), (6, None, "s"), (7, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(None, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    n = len(rows)
    ids = {5, 6, 7, 9_007_199_254_740_993, None}
    for out in (
        license_scan.licenses(docs),
        line_dedup.deduplicated(docs),
        quality_cnn.predictions(docs, labels),
        toxicity.predictions(docs, labels),
        mixing.mixed(docs),
        setsketch.near_duplicates(docs),
    ):
        got = out.collect()
        assert len(got) == n and {r.doc_id for r in got} == ids
    codes = bpe.encode_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(codes) == n and {r.doc_id for r in codes} == (ids - {None}) | {-1}
    near = {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs).collect()}
    assert near[None] is None and near[5] == 5
    assert {r.doc_id for r in setsketch.keep_first(docs).collect()} >= {None, 5, 6, 7}
    assert sum(r.n_removed for r in line_dedup.deduplicated(docs).collect()) == 1  # the last of the three lines


def test_null_pages_and_vectors(spark):
    pages = spark.createDataFrame([(None, None, None), (2**60 + 1, "u", "<p>Some text of a page</p>")], "page_id long, url string, html string")
    assert {r.page_id for r in html_extract.extracted(pages).collect()} == {None, 2**60 + 1}
    vectors = spark.createDataFrame([(None, None), (None, [1.0, 0.0]), (50, [1.0, 0.0]), (2**60, [1.0, 0.1])], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_vectors(vectors).collect()}
    assert got == {(None, 0, None), (50, 1, 50), (2**60, 1, 50)}
    assert [(r.query_id, r.vec_id) for r in ann.nearest(vectors).collect()] == [(50, 2**60)]
