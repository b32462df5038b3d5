"""Sources, stages, the whole chain with stand-in models, and streams."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.plans.options import Options
from chronoweave.plans.pipeline import Models, health, transcripts
from chronoweave.plans.stages import Stage, energy_detector
from chronoweave.sources import config, media
from chronoweave.streaming import vad


def tone(seconds, rate=16_000):
    t = np.arange(round(seconds * rate)) / rate
    return (0.5 * np.sin(2 * np.pi * 440 * t)).astype(np.float32)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("media")
    quiet = np.zeros(16_000, np.float32)
    (d / "a.wav").write_bytes(media.wav_bytes(np.concatenate([quiet, tone(2), quiet, quiet, tone(1), quiet]), 16_000))
    (d / "b.wav").write_bytes(media.wav_bytes(quiet, 16_000))
    (d / "c.wav").write_bytes(b"no media")
    return str(d)


def test_blocks_and_windows(spark, folder):
    pcm = media.blocks(media.files(spark, folder), (16_000, 32_000), block_s=2).cache()
    assert {os.path.basename(r.media_id): r.duration_ms for r in media.durations(pcm).where("rate = 16000").collect()} == {"a.wav": 7000, "b.wav": 1000}
    assert [os.path.basename(r.media_id) for r in media.undecoded(pcm).collect()] == ["c.wav"]
    got = {os.path.basename(r.media_id): len(r.pcm) for r in media.window(pcm, 1.5, 1.0, block_s=2).collect()}
    assert got == {"a.wav": 16_000}
    assert media.window(pcm, -1, 1).count() == 0 and media.window(pcm, 0, 0).count() == 0
    spans = pcm.select("media_id", F.lit(3).alias("window"), F.lit(6500).cast("long").alias("start_ms"), F.lit(9000).cast("long").alias("end_ms")).distinct()
    assert [len(r.pcm) for r in media.windows(pcm, spans, 32_000, 2).collect()] == [16_000]


def test_workspace(spark, folder, tmp_path):
    with media.Workspace(spark, media.blocks(media.files(spark, folder)), str(tmp_path)) as w:
        assert w.read(0, 0.5).count() == 2
        with pytest.raises(RuntimeError):
            w.read(0, 1, 32_000)
        path = w.path
    assert not os.path.exists(path)


def test_wav_round_trip():
    x = tone(0.1)
    y, rate = media.decode_wav(media.wav_bytes(x, 16_000))
    assert rate == 16_000 and np.abs(x - y).max() < 1e-3
    assert len(media.resampled(x, 16_000, 8_000)) == len(x) // 2


def test_whole_chain(spark, folder):
    def recognise(_, row):
        words = [("HELLO", 0.0, 0.4, 0.9), ("YOU", 0.4, 0.8, None)]
        return [("en", 0.9, [(" HELLO YOU ", 0.0, 1.0, -0.1, 0.0, 1.0, words), (" ", 1.0, 1.1, -0.1, 0.0, 1.0, [])])]

    def tag(_, row):
        return [(f, c, 0.9 if c == f // 40 % 2 else 0.1) for f in range(len(row.pcm) // 320) for c in range(2)]

    word = "array<struct<word:string,start:double,end:double,probability:double>>"
    seg = f"array<struct<text:string,start:double,end:double,avg_logprob:double,no_speech_prob:double,compression_ratio:double,words:{word}>>"
    models = Models(
        detector=energy_detector(),
        recogniser=Stage("asr", lambda: None, recognise, f"language string, language_probability double, segments {seg}", (("media_id", "string"), ("chunk", "int"), ("offset_ms", "long"))),
        tagger=Stage("tag", lambda: None, tag, "frame long, class int, prob float", (("media_id", "string"), ("window", "int"))),
        diarizer=Stage("diar", lambda: None, lambda _, r: [(0, 0, 2500, "x"), (1, 2500, 9000, "y")], "ord int, start_ms long, end_ms long, speaker_id string", (("media_id", "string"), ("window", "int"))),
        frame_ms=10,
        labels=spark.createDataFrame([(0, "Dog"), (1, "Rain")], "class int, label string"),
    )
    c = config.load({"SPEAKERS_ENABLED": "yes", "VAD_MAX_CHUNK_S": "2.5"})
    pcm = media.blocks(media.files(spark, folder), (16_000, 32_000))
    out = {os.path.basename(r.media_id): json.loads(r.body) for r in transcripts(spark, pcm, models, c, {"least_ms": None, "top_k": 1}).collect()}
    a, b = out["a.wav"], out["b.wav"]
    assert a["language"] == "en" and a["text"] == "hello you hello you" and a["duration"] == 7.0
    speech = [s for s in a["segments"] if s["kind"] == "speech"]
    assert [(round(s["start"], 1), s["text"], s["speaker_id"]) for s in speech] == [(0.8, "hello you", "spk_0"), (4.8, "hello you", "spk_1")]
    assert {s["label"] for s in a["segments"] if s["kind"] == "sound"} <= {"Dog", "Rain"}
    assert [s["start"] for s in a["segments"]] == sorted(s["start"] for s in a["segments"])
    assert {s["id"] for s in a["speakers"]} == {"spk_0", "spk_1"}
    assert b["language"] == "unknown" and b["text"] == "" and "c.wav" not in out


def test_speakers_over_three_windows(spark, tmp_path):
    """A speaker keeps one id in all windows, and has an embedding."""
    t = np.arange(5 * 16_000) / 16_000
    x = np.concatenate([0.5 * np.sin(2 * np.pi * f * t) for f in (440, 1000)]).astype(np.float32)
    (tmp_path / "d.wav").write_bytes(media.wav_bytes(x, 16_000))
    said = [("ONE", 0.0, 2.0, 0.9), ("TWO", 2.0, 5.0, 0.9), ("THREE", 5.0, 7.5, 0.9), ("FOUR", 7.5, 10.0, 0.9)]
    local = {0: [(0, 0, 4000, "u")], 1: [(0, 0, 2000, "p"), (1, 2000, 4000, "q")], 2: [(0, 0, 4000, "z")]}

    def embed(_, row):
        m = np.abs(np.fft.rfft(row.pcm))
        return [([float(m[round(f * len(row.pcm) / 16_000)]) for f in (440, 1000)],)]

    word = "array<struct<word:string,start:double,end:double,probability:double>>"
    seg = f"array<struct<text:string,start:double,end:double,avg_logprob:double,no_speech_prob:double,compression_ratio:double,words:{word}>>"
    models = Models(
        detector=energy_detector(),
        recogniser=Stage("asr3", lambda: None, lambda _, r: [("en", 0.9, [("ONE TWO THREE FOUR", 0.0, 10.0, -0.1, 0.0, 1.0, said)])], f"language string, language_probability double, segments {seg}", (("media_id", "string"), ("chunk", "int"), ("offset_ms", "long"))),
        diarizer=Stage("diar3", lambda: None, lambda _, r: local[r.window], "ord int, start_ms long, end_ms long, speaker_id string", (("media_id", "string"), ("window", "int"))),
        embedder=Stage("embed3", lambda: None, embed, "vector array<double>", (("media_id", "string"), ("clip", "string"))),
    )
    c = config.load({"SPEAKERS_ENABLED": "yes", "SPEAKERS_CHUNK_S": "4", "SPEAKERS_CHUNK_OVERLAP_S": "1"})
    body = json.loads(transcripts(spark, media.blocks(media.files(spark, str(tmp_path))), models, c).first().body)
    assert [(s["text"], s["speaker_id"]) for s in body["segments"]] == [("one two", "spk_0"), ("three four", "spk_1")]
    assert [(s["id"], s["speech_seconds"], [round(v) for v in s["embedding"]]) for s in body["speakers"]] == [("spk_0", 5.0, [1, 0]), ("spk_1", 5.0, [0, 1])]


def test_request_options_and_failures(spark, tmp_path):
    """Options choose branches; seams of sound windows tell one event once; failures stand in the body."""
    t = np.arange(9 * 32_000) / 32_000
    (tmp_path / "e.wav").write_bytes(media.wav_bytes((0.5 * np.sin(2 * np.pi * 440 * t)).astype(np.float32), 32_000))

    def tag(_, row):
        if row.window == 9:
            raise ValueError("bad window")
        return [(f, c, p) for f in range(len(row.pcm) // 3200) for c, p in ((0, 0.6 + 0.01 * row.window), (1, 0.1))]

    def fail(_, row):
        raise ValueError("no speaker model")

    word = "array<struct<word:string,start:double,end:double,probability:double>>"
    seg = f"array<struct<text:string,start:double,end:double,avg_logprob:double,no_speech_prob:double,compression_ratio:double,words:{word}>>"
    models = Models(
        detector=energy_detector(),
        recogniser=Stage("asr5", lambda: None, lambda _, r: [("xx", 0.1, [("HI ALL", 0.0, 1.0, -0.1, 0.0, 1.0, [])])], f"language string, language_probability double, segments {seg}", (("media_id", "string"), ("chunk", "int"), ("offset_ms", "long"))),
        tagger=Stage("tag5", lambda: None, tag, "frame long, class int, prob float", (("media_id", "string"), ("window", "int"))),
        diarizer=Stage("diar5", lambda: None, fail, "ord int, start_ms long, end_ms long, speaker_id string", (("media_id", "string"), ("window", "int"))),
        frame_ms=100,
        labels=spark.createDataFrame([(0, "Dog"), (1, "Rain")], "class int, label string"),
    )
    c = config.load({"SOUND_EVENTS_WINDOW_S": "4", "SOUND_EVENTS_OVERLAP_S": "1", "SPEAKERS_ENABLED": "no", "SOUND_EVENTS_ENABLED": "no"})
    pcm = media.blocks(media.files(spark, str(tmp_path)), (16_000, 32_000))
    plain = json.loads(transcripts(spark, pcm, models, c, options=Options()).first().body)
    assert {s["kind"] for s in plain["segments"]} == {"speech"} and "speakers" not in plain and "aed_debug" not in plain and "failures" not in plain
    asked = Options.from_dict({"sound_events": True, "diarize": True, "align": True, "language": "en", "debug_top_n": 1})
    body = json.loads(transcripts(spark, pcm, models, c, options=asked).first().body)
    assert body["language"] == "en"
    assert [(s["label"], s["start"], s["end"]) for s in body["segments"] if s["kind"] == "sound"] == [("Dog", 0.0, 9.0)]
    assert body["aed_debug"] == [{"label": "Dog", "index": 0, "score": 0.62, "at": 6.5}]
    assert body["failures"] == [{"stage": "diarizer", "error": "ValueError: no speaker model"}]
    assert (body["alignment_requested"], body["alignment_applied"], body["alignment_failed"], body["alignment_failed_segments"]) == (True, False, False, 0)
    text = transcripts(spark, pcm, models, c, options=Options(response_format="text")).first().body
    assert text == body["text"]


def test_stage_failures_are_rows(spark):
    def infer(m, row):
        if row.x == 2:
            raise ValueError("bad")
        return [(row.x * m,)]

    df = spark.createDataFrame([("a", 1), ("b", 2)], "media_id string, x int")
    got = {r.media_id: (r.y, r.error) for r in Stage("s", lambda: 10, infer, "y int").apply(df).collect()}
    assert got == {"a": (10, None), "b": (None, "ValueError: bad")}


def test_config_and_env_file(tmp_path):
    c = config.load({"ASR_TEMPERATURES": "0, x", "MAX_CONCURRENT_REQUESTS": "99", "SOUND_EVENTS_ENABLED": "off", "ASR_LANGUAGE": "None", "ASR_BEAM_SIZE": "many", "SOUND_EVENTS_PROMPT_ALLOWLIST": "a, ,b"})
    assert (c.temperatures[1], c.max_concurrent_requests, c.sound_enabled, c.beam_size, c.sound_allow) == (0.2, 8, False, 5, ("a", "b"))
    assert config.forced_language(c) is None and health(c)["sound_events"] is False
    (tmp_path / ".env").write_text("# c\nexport A='x y'\nB=2 # two\nC=3\n")
    env = {"B": "kept"}
    assert config.load_env_file(env, tmp_path) == tmp_path / ".env" and env == {"A": "x y", "B": "kept", "C": "3"}
    assert config.load_env_file({"ENV_FILE": str(tmp_path / "none")}) is None


def test_options():
    from chronoweave.plans.options import Options, overridden

    o = Options.from_dict({"language": " Auto ", "align": True, "sound": {"top_k": 1}, "other": 1})
    assert o.language is None and o.align and Options.from_dict(o.to_dict()) == o
    assert overridden({"a": 1, "b": 2}, {"a": None, "b": 3, "c": 4}) == {"a": 1, "b": 3}
    assert config.preload_languages(config.load({"ASR_LANGUAGE": "uk"})) == ("uk",)


def test_arriving_files(spark, folder, tmp_path):
    s = media.arriving(spark, folder).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    assert s.awaitTermination(60) and spark.table("arrived").count() == 3


def test_streamed_regions(spark, tmp_path):
    x = np.concatenate([np.zeros(8_000, np.float32), tone(1.03), np.zeros(3_000, np.float32), tone(0.5)])
    src = tmp_path / "in"
    cuts = [0, 5_000, 9_000, 9_100, 20_000, len(x)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame([("m", a, x[a:b].tolist(), b == len(x))], "media_id string, start long, pcm array<float>, eos boolean").coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    schema = "media_id string, start long, pcm array<float>, eos boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = vad.region_stream(stream).writeStream.format("memory").queryName("regions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r.start_ms, r.end_ms) for r in spark.table("regions").collect())
    frame = 512
    y = np.pad(x, (0, -len(x) % frame)).reshape(-1, frame)
    on, want, at = np.sqrt((y * y).mean(1)) >= 0.05, [], None
    for i, o in enumerate([*on, False]):
        if o and at is None:
            at = i
        elif not o and at is not None:
            want.append((round(at * frame / 16), round(min(i * frame, len(x)) / 16)))
            at = None
    assert got == want


def test_streamed_sessions_equal_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.col("event_type").alias("label"), "value")
    e.repartition(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = vad.emitted(s, lambda df: vad.label_sessions(df), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("label", "start", "n")
    want = vad.label_sessions(e).select("label", "start", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "timeline" in o
    assert e.entry(spark).count() > 0
