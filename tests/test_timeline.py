"""Operators against plain folds over random input, and fixed cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import scalars, text
from chronoweave.operators import frames, intervals, regions, segments, speakers, turns


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_regions_from_events(spark):
    rng = random.Random(1)
    events, media, want = [], [], []
    for m in range(40):
        n, start, active = rng.randrange(0, 12), None, rng.random() < 0.5
        for i in range(n):
            kind = rng.choice(["start", "end"])
            events.append((m, i, kind, i * 100))
            if kind == "start":
                start = i * 100
            elif start is not None:
                want.append((m, start, i * 100))
                start = None
        media.append((m, 5000, active))
        if active and start is not None:
            want.append((m, start, 5000))
    got = regions.from_events(spark.createDataFrame(events, "media_id int, ord int, kind string, at_ms long"), spark.createDataFrame(media, "media_id int, duration_ms long, active boolean"))
    assert rows(got, "media_id", "start_ms", "end_ms") == sorted(want)


def test_packing(spark):
    rng = random.Random(2)
    data, media, want = [], [], []
    for m in range(40):
        at, spans = 0, []
        for i in range(rng.randrange(1, 15)):
            at += rng.randrange(0, 4000)
            end = at + rng.randrange(1, 9000)
            spans.append((at, end))
            data.append((m, i, at, end))
            at = end
        total = at - rng.randrange(0, 500)
        media.append((m, total))
        chunks = []
        for s, e in spans:
            if chunks and e - chunks[-1][0] <= 10_000:
                chunks[-1][1] = e
            else:
                chunks.append([s, e])
        padded = [(max(0, s - 200), min(total, e + 200)) for s, e in chunks]
        want += [(m, i, s, e) for i, (s, e) in enumerate(p for p in padded if p[1] > p[0])]
    got = regions.packed(spark.createDataFrame(data, "media_id int, ord int, start_ms long, end_ms long"), spark.createDataFrame(media, "media_id int, duration_ms long"), 10_000, 200)
    assert rows(got, "media_id", "chunk", "start_ms", "end_ms") == sorted(want)


@pytest.mark.parametrize(("window", "overlap"), [(0, 10), (600, 30), (100, 90), (1000, 0)])
def test_overlapping_windows(spark, window, overlap):
    media = [(i, d) for i, d in enumerate([0, 1, 99, 100, 101, 600, 601, 1170, 1171, 5000])]
    want = []
    for m, d in media:
        if d <= 0:
            continue
        if window <= 0 or d <= window:
            want.append((m, 0, 0, d, True))
            continue
        step, at, i = max(window - min(overlap, window // 2), window // 2), 0, 0
        while True:
            end = min(d, at + window)
            want.append((m, i, at, end, end >= d))
            if end >= d:
                break
            at, i = at + step, i + 1
    got = regions.overlapping_windows(spark.createDataFrame(media, "media_id int, duration_ms long"), window, overlap)
    assert rows(got, "media_id", "window", "start_ms", "end_ms", "last") == sorted(want)


@pytest.mark.parametrize("tail", [0, 1, 7, 40])
def test_sample_windows(spark, tail):
    media, want = [(i, i * 3) for i in range(60)], []
    for m, total in media:
        at, i = 0, 0
        while at < total:
            end = min(at + 50, total)
            if 0 < total - end < tail:
                end = total
            want.append((m, i, at, end))
            if end >= total:
                break
            at, i = at + 40, i + 1
    got = regions.sample_windows(spark.createDataFrame(media, "media_id int, total long"), 50, 10, tail)
    assert rows(got, "media_id", "window", "start", "end") == sorted(want)


def test_capped_and_least(spark):
    r = spark.createDataFrame([(1, 0, 100), (1, 100, 330), (2, 5, 5)], "media_id int, start_ms long, end_ms long")
    assert rows(regions.capped(r, 100), "media_id", "start_ms", "end_ms", "piece") == [(1, 0, 100, 0), (1, 100, 200, 0), (1, 200, 300, 1), (1, 300, 330, 2)]
    assert regions.capped(r, 0).count() == 3
    assert rows(regions.at_least(r, 101), "start_ms") == [(100,)]
    assert regions.at_least(r, 0).count() == 3


def test_frames_of(spark):
    b = spark.createDataFrame([("m", 0, [1.0] * 5), ("m", 5, [2.0] * 4)], "media_id string, start long, pcm array<float>")
    got = {r.frame: list(r.pcm) for r in regions.frames_of(b, 4).collect()}
    assert got == {0: [1, 1, 1, 1], 1: [1, 2, 2, 2], 2: [2, 0, 0, 0]}


def test_merged_events_against_fold(spark):
    rng = random.Random(3)
    data, want = [], []
    for m in range(60):
        out = []
        found = [(rng.randrange(0, 60), rng.choice("ab")) for _ in range(rng.randrange(0, 14))]
        for o, (s, lab) in enumerate(found):
            data.append((m, o, s, s + rng.randrange(1, 9), lab, 0, rng.random(), rng.random() < 0.5))
        for _, o, s, e, lab, _, sc, rel in sorted((x for x in data if x[0] == m), key=lambda x: (x[2], x[1])):
            if out and out[-1][2] == lab and s - out[-1][1] <= 3:
                p = out[-1]
                out[-1] = (p[0], max(p[1], e), lab, max(p[3], sc), p[4] or rel)
            else:
                out.append((s, e, lab, sc, rel))
        want += [(m, *x) for x in out]
    df = spark.createDataFrame(data, "media_id int, ord int, start_ms long, end_ms long, label string, class int, score double, prompt_relevant boolean")
    assert rows(frames.merged(df, 3), "media_id", "start_ms", "end_ms", "label", "score", "prompt_relevant") == sorted(want)
    assert frames.merged(df, 0).count() == len(data)


def test_frame_events_against_fold(spark):
    rng = np.random.default_rng(4)
    labels = ["Dog", "Speech", "Rain"]
    data, want = [], []
    for m in range(12):
        p = rng.random((40, 4)).astype(np.float32)
        data += [(m, 0, f, c, float(p[f, c])) for f in range(40) for c in range(4)]
        order = np.argsort(-p, axis=1, kind="stable")[:, :2]
        on = np.zeros(p.shape, bool)
        np.put_along_axis(on, order, True, 1)
        on &= p >= np.float32(0.4)
        for c in range(4):
            label = labels[c] if c < 3 else "3"
            if label == "Speech":
                continue
            spans = []
            for f in np.flatnonzero(on[:, c]):
                if spans and f - spans[-1][1] <= 2:
                    spans[-1][1] = f + 1
                else:
                    spans.append([f, f + 1])
            want += [(m, label, a * 10, b * 10, round(float(p[a:b, c].max()), 3), label == "Dog") for a, b in spans if (b - a) * 10 >= 20]
    df = spark.createDataFrame(data, "media_id int, window int, frame long, class int, prob float")
    names = spark.createDataFrame(list(enumerate(labels)), "class int, label string")
    got = frames.events(df, 10, names, 0.4, 2, 20, 20, True, (" dog ", ""))
    assert rows(got, "media_id", "label", "start_ms", "end_ms", "score", "prompt_relevant") == sorted((m, lab, int(a), int(b), s, r) for m, lab, a, b, s, r in want)


def test_trimmed_offset_rounds_half_up(spark):
    # window 6 begins at 930,000 samples; 8 frames on is 29222.5 ms, which rounds to the odd number
    probs = spark.createDataFrame([(0, w, f, 0, 0.5) for w in (0, 2, 6) for f in range(250)], "media_id long, window long, frame long, class int, prob float")
    starts = spark.createDataFrame([(0, w, w * 155_000, w * 155_000 + 160_000, 2_000_000, 250) for w in (0, 2, 6)], "media_id long, window long, start long, end long, total long, frames int")
    out = frames.trimmed(probs, starts, 5_000, 32_000).groupBy("window").agg(F.count("*").alias("n"), F.min("frame").alias("f"), F.max("offset_ms").alias("at"))
    assert sorted(map(tuple, out.collect())) == [(0, 242, 0, 0), (2, 234, 0, 9848), (6, 234, 0, 29223)]


def test_interval_joins_against_loops(spark):
    rng = random.Random(5)
    t = [(m, o, s, s + rng.randrange(0, 2_000_000), f"spk_{rng.randrange(3)}") for m in range(6) for o, s in enumerate(rng.randrange(0, 5_000_000) for _ in range(12))]
    w = [(m, i, s, s + rng.randrange(0, 900_000)) for m in range(7) for i, s in enumerate(rng.randrange(0, 6_000_000) for _ in range(20))]
    td = spark.createDataFrame(t, "media_id int, ord int, start_ms long, end_ms long, speaker_id string")
    wd = spark.createDataFrame(w, "media_id int, span_id int, start_ms long, end_ms long")

    def first(m, at):
        return next((k for mm, _, s, e, k in t if mm == m and s <= at < e), None)

    def best(m, a, b):
        top, out = 0, None
        for mm, _, s, e, k in t:
            if mm == m and min(b, e) - max(a, s) > top:
                top, out = min(b, e) - max(a, s), k
        return out

    key = lambda x: (x[0], x[1])
    got = {(r.media_id, r.span_id): r.speaker_id for r in intervals.best_overlap(wd, td).collect()}
    assert got == {key(x): best(x[0], x[2], x[3]) for x in w}
    got = {(r.media_id, r.span_id): r.speaker_id for r in intervals.word_speakers(wd, td).collect()}
    assert got == {key(x): first(x[0], (x[2] + x[3]) / 2) or best(x[0], x[2], x[3]) for x in w}
    assert intervals.best_overlap(wd, td.limit(0)).where("speaker_id is not null").count() == 0


def test_assigned_speakers(spark):
    word = "array<struct<word:string,start_ms:bigint,end_ms:bigint>>"
    s = spark.createDataFrame(
        [("a", 0, 0, 4000, "x", [(" HELLO", 0, 500), ("there", 500, 1000), ("you", 2000, 2500), (" ", 2500, 2600)], 0.5), ("a", 1, 4000, 5000, "all", None, 0.6), ("b", 0, 0, 10, "none", [("w", 0, 5)], 0.7)],
        f"media_id string, ord int, start_ms long, end_ms long, text string, words {word}, confidence double",
    )
    t = spark.createDataFrame([("a", 0, 0, 1000, "spk_0"), ("a", 1, 1500, 6000, "spk_10"), ("a", 2, 3900, 9000, "spk_2")], "media_id string, ord int, start_ms long, end_ms long, speaker_id string")
    out = speakers.assigned(s, t)
    assert rows(out, "media_id", "ord", "part", "start_ms", "end_ms", "text", F.coalesce("speaker_id", F.lit("-")), "confidence") == [
        ("a", 0, 0, 0, 1000, "HELLO there", "spk_0", 0.5),
        ("a", 0, 1, 2000, 2600, "you", "spk_10", 0.5),
        ("a", 1, 0, 4000, 5000, "all", "spk_10", 0.6),
        ("b", 0, 0, 0, 10, "none", "-", 0.7),
    ]
    assert "words" not in out.columns
    r = speakers.roster(out).orderBy("id").collect()
    assert [(x.id, x.speech_ms, x.segment_count) for x in r] == [("spk_0", 1000, 1), ("spk_10", 1600, 2)]


def test_speaker_matching():
    a, b = np.array([1.0, 0]), np.array([0, 1.0])
    got, n = turns.match_speakers([("x", a), ("y", b)], [("spk_0", b), ("spk_1", a)], ["x", "y", "z"], 2, 0.75)
    assert got == {"x": "spk_1", "y": "spk_0", "z": "spk_2"} and n == 3
    got, n = turns.match_speakers([("x", a), ("y", a)], [("spk_0", a)], ["y", "x"], 1, 0.75)
    assert got == {"x": "spk_0", "y": "spk_1"} and n == 2
    got, n = turns.match_speakers([("x", a)], [("spk_0", np.array([1.0, 1.0]))], ["x"], 1, float(np.sqrt(0.5)))
    assert got == {"x": "spk_1"}  # not above the threshold
    assert turns.match_speakers([("x", None)], [("spk_0", a)], ["x"], 4, 0.1) == ({"x": "spk_4"}, 5)
    assert turns.match_speakers([("x", np.zeros(2))], [("spk_0", a)], ["x"], 1, 0.1)[0] == {"x": "spk_1"}


def test_linked_windows(spark):
    t = spark.createDataFrame(
        [("m", 0, 0, 0, 400, "A"), ("m", 0, 1, 560, 600, "B"), ("m", 1, 0, 570, 590, "q"), ("m", 1, 1, 580, 600, "p"), ("m", 1, 2, 700, 900, "r")], "media_id string, window int, ord int, start_ms long, end_ms long, speaker_id string"
    )
    w = spark.createDataFrame([("m", 0, 0), ("m", 1, 560)], "media_id string, window int, start_ms long")
    v = spark.createDataFrame([("m", 0, "B", "prior", [1.0, 0.0]), ("m", 1, "p", "local", [0.99, 0.1]), ("m", 1, "q", "local", [0.0, 1.0])], "media_id string, window int, speaker_id string, side string, vector array<double>")
    got = {(r.window, r.speaker_id): r.global_id for r in turns.linked(t, w, v, 40).collect()}
    assert got == {(0, "A"): "spk_0", (0, "B"): "spk_1", (1, "p"): "spk_1", (1, "q"): "spk_2", (1, "r"): "spk_3"}


def test_turn_names(spark):
    t = spark.createDataFrame([("m", 0, 50, 60, "Z"), ("m", 1, 0, 10, "A"), ("m", 2, 20, 30, "Z")], "media_id string, ord int, start_ms long, end_ms long, speaker_id string")
    assert [(r.start_ms, r.speaker_id) for r in turns.normalized(t).orderBy("ord").collect()] == [(0, "spk_1"), (20, "spk_0"), (50, "spk_0")]
    named = spark.createDataFrame([("m", "spk_3"), ("m", "spk_x"), ("n", "other")], "media_id string, speaker_id string")
    assert rows(turns.next_index(named), "media_id", "next") == [("m", 4), ("n", 0)]
    m = spark.createDataFrame([("m", "Z", "spk_9")], "media_id string, speaker_id string, global_id string")
    assert rows(turns.remapped(t, m), "ord", "speaker_id") == [(0, "spk_9"), (1, "A"), (2, "spk_9")]


TEXTS = ["ПРИВІТ СВІТ", "Hello", "OK", "  ABC  ", "123", "ÉTÉ FROID", "", None, "ß SS", "Don’t — stop!\t now", "A1B2C3", "日本 ABC"]


def test_text(spark):
    def caps(t):
        up = sum(c.isalpha() and c.upper() != c.lower() and c == c.upper() for c in t)
        low = sum(c.isalpha() and c.upper() != c.lower() and c != c.upper() and c == c.lower() for c in t)
        return up + low >= 3 and low == 0

    import re

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r for r in df.select("i", text.is_mostly_uppercase(F.col("t")).alias("caps"), text.normalize_segment_text(F.col("t")).alias("seg"), text.normalize_for_matching(F.col("t")).alias("norm")).collect()}
    for i, t in enumerate(TEXTS):
        if t is None:
            assert got[i].seg is None and got[i].norm is None and got[i].caps is False
            continue
        assert got[i].caps == caps(t), t
        s = t.strip()
        assert got[i].seg == (s.lower() if caps(s) else s)
        assert got[i].norm == re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t.lower().replace("’", "'"))).strip()


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
        scalars.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))).alias("c"),
        scalars.unit(F.array(F.lit(3.0), F.lit(4.0)), 2).alias("u"),
        scalars.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("wrong"),
        scalars.logprob_to_confidence(F.lit(None).cast("double")).alias("none"),
        scalars.confidence_to_logprob(F.lit(0.0)).alias("low"),
        scalars.samples(F.lit(-1.0), 16_000).alias("s"),
        text.alignment_language(F.lit(""), F.lit("auto"), F.array(F.lit("unknown"), F.lit("uk"))).alias("lang"),
        text.normalize_language(F.lit(" AUTO ")).alias("auto"),
        text.trusted_language(F.lit("uk"), F.lit(None).cast("double")).alias("trust"),
    ).first()
    assert (r.zero, round(r.c, 9), list(r.u), r.wrong, r.none, r.low, r.s, r.lang, r.auto, r.trust) == (0.0, 0.96, [0.6, 0.8], None, 0.0, -0.5, 0, "uk", None, "unknown")


def test_languages_and_text_order(spark):
    c = spark.createDataFrame([("m", 2, "en"), ("m", 0, "unknown"), ("m", 1, "uk"), ("m", 3, "uk")], "media_id string, chunk int, language string")
    assert segments.languages(c).first().languages == ["uk", "en"]
    t = spark.createDataFrame([("m", 1, 0, "b"), ("m", 0, 1, "a2"), ("m", 0, 0, " a1")], "media_id string, chunk int, seg int, text string")
    assert segments.full_text(t).first().text == "a1 a2 b"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "media_id int, ord int, start_ms long, end_ms long, label string, class int, score double, prompt_relevant boolean, speaker_id string, span_id int")
    assert frames.merged(none, 5).count() == 0
    assert regions.packed(none, spark.createDataFrame([], "media_id int, duration_ms long")).count() == 0
    assert intervals.best_overlap(none.drop("speaker_id"), none).count() == 0
    assert speakers.roster(none).count() == 0
    assert turns.clip_budget(none).count() == 0
