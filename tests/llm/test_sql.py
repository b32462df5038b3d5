"""The SQL of the operators, over tables made for it, against the operators."""

import duckdb
import pytest

from chronoweave.llm import license_scan, oracle


@pytest.fixture(scope="module")
def texts():
    out = []
    for i, (label, _, name) in enumerate(license_scan.NAMES):
        plain = name.split("|")[0].replace("(", "").replace(")", "").replace("?", "").replace("~3 ", "any ")
        out += [f"Licensed under the terms of the {plain} License, version {i}.", f"émit {plain} license; see {plain} license for details", f"{label} released under {plain}"]
    for _, label, _, rule in license_scan.TEXTS:
        out.append(f"{rule.replace('YEAR', '1999')} permission license {label}".replace("|", " "))
    return [*out, "copyright (c) 1999 somebody", "all rights reserved licensed under the mit license all rights reserved", None, "", "SPDX-License-Identifier: MIT"]


def test_license_sql(spark, texts):
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    cols = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
    want = sorted(con.execute(f"SELECT {cols} FROM ({oracle.licenses()})").fetchall())
    assert len({r[6] for r in got}) > 60
    for a, b in zip(got, want, strict=True):
        assert a == b, texts[a[0]]
