"""Seams of long texts, odd markup, labels that clash, hot words."""

import hashlib
import random
import tracemalloc

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import bpe, html_extract, labelled, line_dedup, quality_cnn, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXT = "The river had risen in the night and by morning the lower fields were under water, so the council met."


def test_bpe_blocks_inside_partitions(spark, monkeypatch):
    """Many small blocks, words in many packs, and texts read match by match give what one block gives."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "日本", "x" + str(rng.randrange(300))]) for _ in range(rng.randrange(0, 90)))) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "no id"), (-1, "an id"), (7, None)], "doc_id long, text string").coalesce(2)
    want = sorted(map(tuple, bpe.encode_digest(docs, RANKS, public_tokenizers.PATTERN, nulls=None).collect()), key=str)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 900)
    monkeypatch.setattr(bpe, "LONG_CHARS", 150)
    monkeypatch.setattr(bpe, "WORDS", 7)
    got = sorted(map(tuple, bpe.encode_digest(docs, RANKS, public_tokenizers.PATTERN, nulls=None).collect()), key=str)
    assert got == want and len(want) == 203
    assert sum(r[0] is None for r in want) == 1 and sum(r[0] == -1 for r in want) == 1


def test_bpe_memory_of_a_block():
    """Two million words of one block: neither cutting nor putting together holds them all as numbers."""
    rng = random.Random(4)
    names = [f" w{i}" for i in range(500)]
    texts = ["".join(rng.choices(names, k=20_000)) for _ in range(100)]
    docs = pd.DataFrame({"key": [str(i) for i in range(100)], "text": texts})
    of_text = [hashlib.sha256(t.encode()).hexdigest() for t in texts]

    def peak(run):
        tracemalloc.start()
        out = run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most / 1e6

    blocks, cutting = peak(lambda: pd.concat(list(bpe._blocks(public_tokenizers.PATTERN)(iter([docs])))))
    words, places = (blocks[blocks["kind"] == kind] for kind in ("words", "places"))
    listed = pd.concat(list(bpe._words(iter([words])))).sort_values("word")
    ids = pd.concat(list(bpe._encode_words(RANKS, public_tokenizers.PATTERN)(iter([listed]))))
    got, putting = peak(lambda: bpe._assemble(RANKS, public_tokenizers.PATTERN)[0]((), places, ids))
    assert sorted(zip(got["key"].astype(int), got["decoded_sha256"], strict=True)) == list(enumerate(of_text))
    assert cutting < 20 and putting < 30, (cutting, putting)


def test_toxicity_has_no_seams(monkeypatch):
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 123, 3000, dtype=np.uint8))
    model = {"cells": np.arange(1 << toxicity.BITS, dtype=np.int32), "weights": rng.normal(0, 0.01, 1 << toxicity.BITS).astype(np.float32), "bias": 0.1}
    dense = toxicity._dense(model)
    want = toxicity.score(model, dense, text)
    for piece in (1, 7, 500, 2999):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert toxicity.score(model, dense, text) == pytest.approx(want, abs=1e-12)
    assert toxicity.score(model, dense, b"") == pytest.approx(1 / (1 + np.exp(-0.1)))


def test_labelled_sample(spark):
    """Clashing labels are left out, empty and null texts learned, the odds of a cut sample mended."""
    docs = spark.createDataFrame([(i, None if i % 50 == 0 else "" if i % 50 == 1 else f"text {i}") for i in range(400)] + [(3, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(8, 0), (9, None)], "doc_id long, quality int")
    rows, odds = labelled.sample(docs, labels, "quality", 1, 5, 40, 1000)
    got = rows.collect()
    assert len(got) == 40 and sum(r["_y"] for r in got) == 20 and odds == pytest.approx(np.log(99 / 300))
    every, none = labelled.sample(docs, labels, "quality", 1, 5, 10_000, 1000)
    texts = [bytes(r["_t"]) for r in every.collect()]
    assert len(texts) == 399 and texts.count(b"") == 16 and none == 0
    assert texts.count(b"another text") == 1 and b"text 3" not in texts and b"text 8" not in texts
    assert labelled.learned(rows, lambda x: {"n": len(x), "first": x[0][1]})["n"] == 40
    assert labelled.learned(rows.limit(0), lambda x: {"n": len(x)}) == {"n": 0}


def test_quality_learns_from_long_texts():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows = []
    for i in range(60):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([20, 1500])))
        rows.append(((t + " ### ### ###" if i % 2 else t).encode(), int(not i % 2)))
    m = quality_cnn.train(rows, seen=6000)
    assert np.mean([(quality_cnn.score(m, t) >= 0.3) == bool(y) for t, y in rows]) >= 0.9


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        (f"<div class='layout has-sidebar'><article><p>{TEXT}</p></article></div>", 1),
        (f"<div class='market share'><p>{TEXT}</p><p>{TEXT}</p></div>", 2),
        (f"<main><div class='social-policy report'><p>{TEXT}</p></div></main>", 1),
        (f"<html><head><title>x</title><article><p>{TEXT}</p></article>", 1),
        (f"<article><p>{TEXT}</p><button>Press<p>{TEXT}</p></article>", 2),
        (f"<article><p>{TEXT}</p><select><option>a<option>b<p>{TEXT}</p></article>", 2),
        (f"<nav><a href=1>Home</a><article><p>{TEXT}</p></article>", 1),
        (f"<nav><a href=1>Home</a><main><p>{TEXT}</p></main>", 1),
        (f"<body class='has-nav no-sidebar'><p>{TEXT}</p>", 1),
        (f"<article><p>{TEXT}</p><svg><text>no</text></svg><p>{TEXT}</p></article><svg><text>no", 2),
        (f"<article><p>{TEXT}</p><ul class='comment-list'><li><article><p>{TEXT}</p></article></li></ul></article>", 1),
        (f"<aside class='sidebar left'><p>{TEXT}</p></aside><article><p>{TEXT}</p></article><div class='footer-links'><p>{TEXT}</p></div>", 1),
    ],
)
def test_html_odd_markup(page, texts):
    assert html_extract.main_text(page) == "\n".join([TEXT] * texts)


def test_lines_under_frequent_words(spark, monkeypatch):
    """Every word counts as frequent: lines are listed by pairs, and the result is the same."""
    rng = random.Random(9)
    rows = []
    for i in range(120):
        w = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 30))]
        rows.append((2 * i, " ".join(w)))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
        rows.append((2 * i + 1, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = [], set()
    for i, t in rows:
        s = frozenset(t.split())
        if any(4 * len(s & o) >= 3 * len(s | o) for o in seen):
            want.add(i)
        seen.append(s)
    for frequent in (1 << 13, 1, 40):
        monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
        assert {r.doc_id for r in line_dedup.later_matches(docs).collect()} == want


def test_line_of_a_million_words(spark):
    long = " ".join(f"v{i}" for i in range(1_100_000))
    docs = spark.createDataFrame([(1, long), (2, long.replace("v7 ", "u ")), (3, "short line")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicated(docs).select("doc_id", "n_removed").collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_ranks_of_any_count(spark):
    """Counts beyond 2^32, as of a common word in a very large corpus, have a rank, and tokens stay in its order."""
    counts = spark.createDataFrame([(1 << k,) for k in (0, 13, 32, 40, 62)], "n long")
    ranks = [r[0] for r in counts.orderBy("n").select(line_dedup._rank(F.col("n"))).collect()]
    assert ranks == [4 * k for k in (0, 13, 32, 40, 62)]
    assert max(ranks) << line_dedup.RANK_SHIFT < 1 << 63


def test_tabs_returns_and_blank_lines(spark):
    rows = [(1, "one two three four five"), (2, "\tfive  four\tthree two\rone \r"), (3, " \t\r\n\n \t"), (4, "\t\r\n"), (5, "one two"), (6, "one two ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.deduplicated(docs).select("doc_id", "text", "n_removed").collect()}
    assert got == {i: (t, 0) for i, t in rows if i not in (2, 6)} | {2: ("", 1), 6: ("", 1)}


def test_order_of_lines(spark):
    """The number by which a list's earliest line is found ascends with (doc_id, line_no), whatever the ids."""
    for ids in ([0, 1, 7], [-(1 << 63), -5, 0, 3 << 40, (1 << 63) - 1], [(1 << 63) - 3, (1 << 63) - 1]):
        docs = spark.createDataFrame([(i, n) for i in ids for n in (0, 1, 5000)], "doc_id long, line_no int")
        got = [r["o"] for r in docs.select("doc_id", "line_no", line_dedup._order(docs).alias("o")).orderBy("doc_id", "line_no").collect()]
        assert got == sorted(got) and (ids[0] < 0 or len(set(got)) == len(got))


def test_bands_hold_all_sizes_that_may_match(spark):
    """A line is held against every size that lengths and its place in a list allow, and against few others."""
    sizes = [*range(1, 130), 999, 1000, 1001, 123_456]
    rows = [(n, i) for n in sizes for i in sorted({0, 1, n // 7, n // 4}) if 4 * n - 7 * i >= 0]
    got = spark.createDataFrame(rows, "n long, i long").select("n", "i", (F.col("n") * (1 << 32) + F.col("i")).alias("size")).select("n", "i", line_dedup._bands().alias("bands"))
    band = {r.m: r.b for r in spark.range(1, 170_000).select(F.col("id").alias("m"), line_dedup._band(F.col("id")).alias("b")).collect()}
    assert all(band[m] <= band[m + 1] for m in range(1, 169_999))
    for r in got.collect():
        held = set(r.bands or [])
        allowed = {band[m] for m in range(-(-3 * r.n // 4), 4 * r.n // 3 + 1) if 7 * (r.n - r.i) >= 3 * (r.n + m)}
        assert allowed <= held and len(held) <= 6, (r.n, r.i)
        assert not allowed or (min(held), max(held)) == (min(allowed), max(allowed)), (r.n, r.i)


def test_ways_of_line_dedup_agree(spark, monkeypatch):
    """Lists joined in memory or by sorting, groups from any number on, with or without wide parities: the same lines go."""
    rng = random.Random(11)
    rows, seen, want = [], [], set()
    for i in range(90):
        w = [f"g{i % 3}w{k}" for k in range(rng.randrange(18, 27))]
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"o{rng.randrange(30)}"
        s = frozenset(w)
        if any(4 * len(s & o) >= 3 * len(s | o) for o in seen):
            want.add(i)
        seen.append(s)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 20 < len(want) < 90
    for group, many, in_memory in ((16, 4, 1 << 20), (2, 0, 0), (1 << 40, 1 << 40, 0)):
        monkeypatch.setattr(line_dedup, "GROUP", group)
        monkeypatch.setattr(line_dedup, "MANY", many)
        monkeypatch.setattr(line_dedup, "IN_MEMORY", in_memory)
        assert {r.doc_id for r in line_dedup.later_matches(docs).collect()} == want
