"""The ten operators: odd input, and brute force on small tables."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import ann, bpe, components, html_extract, license_scan, line_dedup, mixing, quality_cnn, setsketch, toxicity, vector_dedup
from chronoweave.llm.hnsw import Graph

DOC = "doc_id long, text string, source string, extra int, size string, score string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(rng, n, stock=400):
    return " ".join(f"w{int(rng.expovariate(1) * stock / 4)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [words(rng, rng.choice([3, 8, 30, 80])) for _ in range(60)]
    texts = []
    for i, t in enumerate(base):
        texts.append(t + "\n" + rng.choice(base) + "\nshared line of seven or more words here")
        for _ in range(i % 4):  # copies with a few words changed
            w = t.split(" ")
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "x" + str(rng.randrange(9))
            texts.append(" ".join(w))
    texts += [None, "", " ", "\n\n", "a", "the mit license", "x " * 30_000, "ÀÉ ß 日本\tend\r\n", "Same words same words same words", texts[0], texts[0]]
    out = [(i, t, rng.choice(["s0", "s0", "s1", "s2", None]), i, "own", "own") for i, t in enumerate(texts)]
    return [*out, out[3]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


# 1 ----------------------------------------------------------------------------------------------------


def test_license_rules_are_many_and_sound():
    rules = license_scan.rules()
    assert len(rules) >= 300 and {r["p"] for r in rules} == {1, 2, 3, 4}
    with pytest.raises(ValueError):
        license_scan.compiled("mit & license")


def test_license_base_against_brute_force(docs, rows):
    import re

    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.licenses(docs).collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at = [(k, label) for k in range(len(w)) for phrase, label in license_scan.BASE if w[k : k + len(phrase.split())] == phrase.split()]
        want[i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert got == want


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and more", "mit", 1.0),
        ("Licensed under the Apache License, Version 2.0 (the License)", "apache,apache-2.0", 0.9),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0-or-later", 1.0),
        ("released under the GNU Lesser General Public License v2.1", "gpl,lgpl-2.1", 0.9),
        ("THE MIT\nLICENSE", "mit", 0.7),
        ("general public\tlicense mit license apache license", "apache,gpl,mit", 0.7),
        ("permission to smile", "", 0.0),
        (None, "", 0.0),
    ],
)
def test_license_labels(spark, text, labels, score):
    r = license_scan.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.labels, r.score) == (labels, score)


def test_license_suppression_keeps_partial_overlaps(spark):
    d = spark.createDataFrame([(1, "licensed under the mit license all rights reserved mit license")], "doc_id long, text string")
    found = [(x.start, -x.neg_end, x.p, x.l) for x in license_scan.scanned(d).first().detections]
    assert found == [(0, 4, 2, "mit"), (5, 7, 4, "all-rights-reserved"), (8, 9, 3, "mit")]


# 2 ----------------------------------------------------------------------------------------------------


def test_html_tree_fits_its_table():
    x, y = html_extract.table()
    assert all(html_extract.is_main(list(a)) == bool(b) for a, b in zip(x, y, strict=True)) and 60 <= len(y) <= 200


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>  Only   text\n here </p>", "Only text here"),
        ("<article><h1>T &amp; U&copy</h1><p>a&nbsp;b<b>c</b>d<br>e<p>one</article><footer>f</footer>", "T & U©\na bcd e\none"),
        ("<article><p>x</p><script>var t='</p><p>no';</script><!-- <p>no</p> --><style>p{}</style><p>y", "x\ny"),
        ("<nav><a href=1>m</a></nav><article><p>x</p><div class='ad-box'>buy</div><form>in<p>put</p></form></article><aside>s</aside><div id=comments><article><p>c</p></article></div>", "x"),
        ("<article><p>5 < 6 &lt; 7 &am", "5 < 6 < 7 &am"),
        ("<article><p>cut <a href='x", "cut"),
        ("<header>h</header><main><ul><li>one</li><li><a href=1>two</a></li></ul></main>", "one\ntwo"),
    ],
)
def test_html_pages(page, text):
    assert html_extract.main_text(page) == text


def test_html_table(spark):
    p = spark.createDataFrame([(1, "u", None, 1), (2, None, "<p>" + "long text " * 100_000 + "</p>", 2), (2, None, "<p>x</p>", 3)], "page_id long, url string, html string, text int")
    got = html_extract.extracted(p).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (2, 1), (2, 999_999)]
    assert html_extract.extracted(p.limit(0)).count() == 0


# 3 ----------------------------------------------------------------------------------------------------


def brute_lines(rows):
    seen, out, first = [], {}, {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if t is not None}):
        gone = []
        for k, line in enumerate(t.split("\n")):
            w = [x for x in line.replace("\t", " ").replace("\r", " ").split(" ") if x]
            if len(w) < line_dedup.MIN_WORDS:
                continue
            s = frozenset(w)
            if any(4 * len(s & o) >= 3 * len(s | o) for o in seen):
                gone.append(k)
            seen.append(s)
        out[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone)
    return out


def test_line_dedup_against_brute_force(docs, rows, empty):
    want = brute_lines(rows)
    out = line_dedup.deduplicated(docs).collect()
    assert len(out) == len(rows)
    assert sum(r.n_removed for r in out) > 40
    for r in out:
        assert (r.text, r.n_removed) == (want[r.doc_id] if r.doc_id in want else (None, 0)), r.doc_id
        assert r.size == "own"
    assert line_dedup.deduplicated(empty).count() == 0
    kept = line_dedup.keep_new_lines(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t, *_ in rows if t is None or want[i][1] == 0 or want[i][0]}


def test_line_variants_of_a_group(spark):
    """Many variants of one line: what is not like the first may be like another."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(24)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(24)] = f"c{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    want = brute_lines(rows)
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: n for i, (_, n) in want.items()} and 20 < sum(got.values()) < 150


def test_short_and_unspaced_lines(spark):
    """Lines of one word or more go when repeated, blank lines stay."""
    rows = [
        (1, "All rights reserved.\n\nnext page\n \n\tDisclaimer"),
        (2, "All rights reserved.\n\npage next\n \nDisclaimer\nown words"),
        (3, "著作権はすべて当社に帰属します\na b c d"),
        (4, "著作権はすべて当社に帰属します\nd b a\nd b"),
        (5, "no\u00a0break\u00a0spaces\nno\u00a0break\u00a0spaces\n\n"),
    ]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n \nown words", 3), 3: (rows[2][1], 0), 4: ("d b", 2), 5: ("no\u00a0break\u00a0spaces\n\n", 1)}


# 4, 10 ------------------------------------------------------------------------------------------------


def vectors(spark, n=600, d=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v[100:160] = v[100] + rng.normal(size=(60, d)) * 0.02  # near copies
    v[160:260] = v[160]  # equal ones
    v[300:330] = v[0] + np.linspace(0, 3, 30)[:, None] * v[1]  # a chain
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(n)]
    rows += [(n, None, 0), (n + 50, [], 0), (n + 100, [0.0] * d, 0), (n + 150, [float("nan")] * d, 0), (n + 200, [1.0] * (d - 1) + [None], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), v


def test_hnsw_recall():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = Graph.build(v)
    assert [len(a) for a in g.layers] == [3000, 187]
    ids, _ = g.nearest(v[:200], 64)
    want = np.argsort(-(v[:200] @ v.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids, want, strict=True)]) > 0.9
    assert Graph.build(v[:1]).nearest(v[:3], 8)[0][:, 0].tolist() == [0, 0, 0]


def test_nearest_against_brute_force(spark):
    table, v = vectors(spark)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for r in ann.nearest(table, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 600, 10):
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        assert len(got[q]) == 5 and all(abs(s[i] - x) < 1e-12 for i, x in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in got[q]} & set(want.tolist()))
    assert set(got) == set(range(0, 600, 10)) and hits / 300 >= 0.9
    assert ann.nearest(table.limit(0)).count() == 0
    few = ann.nearest(table.where("vec_id < 3"), 1).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(q, k) for q in range(3) for k in (1, 2)]


def test_near_vectors_against_brute_force(spark):
    table, v = vectors(spark)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.95
    comp = np.arange(600)
    while True:
        new = np.array([comp[near[i]].min() for i in range(600)])
        if (new == comp).all():
            break
        comp = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(table).collect()}
    assert got == {i: (int(near[i].sum()) - 1, int(comp[i]), bool(comp[i] == i)) for i in range(600)} | {i: (0, i, True) for i in (600, 650, 700, 750, 800)}
    assert vector_dedup.near_vectors(table.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(7, 7), (3, 2), (None, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


# 5, 8 -------------------------------------------------------------------------------------------------


def labelled(spark):
    rng = random.Random(5)
    good = [(i, " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 120)))) for i in range(300)]
    rows, labels = [], []
    for i, t in good:
        bad, rude = i % 3 == 0, i % 4 == 1
        if rude:
            w = t.split(" ")
            w.insert(rng.randrange(len(w)), "blockhead" + rng.choice(["s", "ly", ""]))
            t = " ".join(w)
        if bad:
            t = t.replace(" ", "### ")
        rows.append((i, t, 1))
        labels.append((i, int(not bad), int(rude)))
    rows += [(1000, None, 1), (1001, "", 1), (1002, "y" * 300_000, 1), (0, rows[0][1], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame([*labels, (2000, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), dict((i, (q, x)) for i, q, x in labels)


@pytest.mark.parametrize(("op", "which", "fold", "out"), [(quality_cnn, 0, 5, 0), (toxicity, 1, 4, 2)])
def test_classifiers(spark, op, which, fold, out):
    import zlib

    docs, labels, truth = labelled(spark)
    got = op.predictions(docs, labels).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == out) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id][which] for r in held) / len(held) >= 0.9
    assert op.predictions(docs.limit(0), labels).count() == 0
    assert {r.score for r in op.predictions(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_filter_and_chunks(spark):
    docs, labels, _ = labelled(spark)
    kept = quality_cnn.keep_good(docs, labels)
    assert kept.columns == docs.columns and 150 < kept.count() < 260
    t = bytes(range(256)) * 9
    c = quality_cnn.chunks(t)
    assert len(quality_cnn.chunks(b"")) == 1 and set(c.ravel().tolist()) - {quality_cnn.PAD} == set(t)
    assert c[-1][c[-1] != quality_cnn.PAD].tolist()[-1] == t[-1]
    m = quality_cnn.train([(b"good words here", 1), (b"### ### ###", 0)] * 20)
    many = [t, b"", b"short", t * 3]
    assert np.allclose(quality_cnn._scores(m, many), [quality_cnn.score(m, x) for x in many], atol=1e-5)


# 6 ----------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, rows, empty):
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert r.taken == r["size"] * r.copies and r.copies in (0, 1, 2) and r.extra == r.doc_id
        t = dict((i, t) for i, t, *_ in rows)[r.doc_id]
        assert r["size"] == len((t or "").encode().split())
    sizes = {s: sum(r["size"] for r in x) for s, x in by.items()}
    # resharing step by step
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        over = {s for s in free if left * weight[s] / sum(weight[f] for f in free) >= 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    for s, x in by.items():
        assert x[0].source_size == sizes[s] and abs(x[0].target - target[s]) < 1e-6 * max(target[s], 1)
        assert abs(sum(r.taken for r in x) - target[s]) <= max(r["size"] for r in x) / 2 + 1
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))
    assert mixing.mix(docs).count() == sum(r.copies for r in out) and mixing.mix(docs).columns == docs.columns
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixed(docs.where("text is null")).first().taken == 0


def test_mixing_weights_and_a_hot_source(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("five words in each text").alias("text"), F.when(F.col("id") < 2900, "hot").otherwise("other").alias("source"), F.when(F.col("id") % 2 == 0, 10.0).otherwise(0.1).alias("w"))
    got = mixing.mixed(d, "w").where("source = 'hot'").groupBy(F.col("w") > 1).agg(F.avg("copies")).collect()
    share = {r[0]: r[1] for r in got}
    assert share[True] > share[False]


# 7 ----------------------------------------------------------------------------------------------------


def test_bpe_round_trip(spark, docs, rows, empty):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest((t or "").encode())] += 1
    assert collections.Counter(tuple(r) for r in bpe.encode_digest(docs, RANKS, public_tokenizers.PATTERN).collect()) == want
    whole = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    texts = {i: t or "" for i, t, *_ in rows}
    assert all(r.decoded == texts[r.doc_id] and r.again == r.decoded for r in bpe.decode(whole.withColumnRenamed("decoded", "again"), RANKS, public_tokenizers.PATTERN).collect())
    assert bpe.encode_digest(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_many_blocks(spark, docs, monkeypatch):
    want = sorted(tuple(r) for r in bpe.encode_digest(docs, RANKS, public_tokenizers.PATTERN).collect())
    twice = docs.unionAll(docs).repartition(5)  # partitions with the same rows
    assert sorted(tuple(r) for r in bpe.encode_digest(twice, RANKS, public_tokenizers.PATTERN).collect()) == sorted(want * 2)


# 9 ----------------------------------------------------------------------------------------------------


def brute_near(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_against_brute_force(docs, rows, empty):
    want = brute_near(rows)
    got = [(r.doc_id, (r.n_shingles, r.component_id, r.kept)) for r in setsketch.near_duplicates(docs).collect()]
    assert len(got) == len(rows) and dict(got) == want and sum(not k for _, _, k in want.values()) > 10
    assert {r.doc_id for r in setsketch.keep_first(docs).collect()} == {i for i, (_, _, k) in want.items() if k}
    assert setsketch.near_duplicates(empty).count() == 0


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """A group around one text: many are like it, few like each other, and it is not the first."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(0 if i == 77 else rng.randrange(1, 5)):
            w[rng.randrange(120)] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(setsketch, "SMALL", 8)
    monkeypatch.setattr(setsketch, "BLOCK", 32)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows) and 1 < len({c for _, c, _ in got.values()}) < 100


def test_sketch_estimates():
    rng = np.random.default_rng(9)
    for share in (0.3, 0.6, 0.9):
        est = []
        for _ in range(30):
            h = np.unique(rng.integers(1 << 62, size=1000, dtype=np.uint64))
            n = int(round(1000 * 2 * share / (1 + share)))
            a, b = h, np.concatenate([h[:n], rng.integers(1 << 62, size=1000 - n, dtype=np.uint64)])
            est.append(setsketch.estimate(setsketch.registers(a)[None], setsketch.registers(b)[None], np.array([1000.0]), np.array([1000.0]))[0])
        assert abs(np.mean(est) - share) < 0.04
    a, b = rng.integers(1 << 62, size=(2, 500), dtype=np.uint64)
    assert (np.maximum(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(np.concatenate([a, b]))).all()
