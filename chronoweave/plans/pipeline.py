"""From media to one response each: the whole chain, with models as stages.

Each model's output is written once, so that no later step runs the model again.  Optional branches
(alignment, speakers, sounds) are best effort: where their stage reports an error for a media, the rest
of it is delivered without them.  What went wrong, in any stage, stands in the response's ``failures``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import assemble, frames, regions, segments, speakers, turns
from chronoweave.plans.options import Options, overridden
from chronoweave.plans.stages import Stage, failures, kept
from chronoweave.sources import media
from chronoweave.sources.config import Config, load


#: A shorter rest of a media belongs to the sound window before it.
LEAST_TAIL_S = 0.5


@dataclass(frozen=True)
class Models:
    """Stages; None leaves a branch out.

    detector: rows (media_id, pcm) to ord, kind, at_ms.  recogniser: rows (media_id, chunk, offset_ms, pcm)
    to language, language_probability, segments (see segments.recognised), keeping media_id, chunk, offset_ms.
    tagger: rows (media_id, window, pcm) to frame, class, prob.  diarizer: rows (media_id, window, pcm)
    to ord, start_ms, end_ms, speaker_id.  embedder: rows (media_id, clip, pcm), a clip being a speaker's
    speech, to vector array<double>, keeping media_id, clip; without it, every window's speakers get names
    of their own, and the roster has no embeddings.  aligner: rows (media_id, language, id, text, start_ms,
    end_ms) to the columns of segments.aligned.
    """

    detector: Stage
    recogniser: Stage
    tagger: Stage | None = None
    diarizer: Stage | None = None
    embedder: Stage | None = None
    aligner: Stage | None = None
    frame_ms: int = 10
    labels: DataFrame | None = None


def health(config: Config | None = None) -> dict:
    """What the service is set up to do."""
    c = config or load()
    return {"status": "ok", "model": c.model, "diarization": c.speakers_enabled, "alignment": c.align_enabled, "sound_events": c.sound_enabled}


def _embedded(pcm: DataFrame, spans: DataFrame, embedder: Stage, least_ms: int) -> DataFrame:
    """``media_id, window, side, speaker_id, vector`` of the speech in ``spans`` (those, ord, start_ms, end_ms).

    Speakers with ``least_ms`` of speech or more, their first 30 s; unit vectors, rounded as the response has them.
    """
    key = F.to_json(F.struct("window", "side", "speaker_id"))
    taken = turns.clip_budget(spans.select("media_id", key.alias("speaker_id"), "ord", "start_ms", "end_ms"), least_ms)
    taken = taken.select("media_id", F.struct("speaker_id", "start_ms", "end_ms", "ord").alias("window"), "start_ms", (F.col("start_ms") + F.col("take_ms")).alias("end_ms"))
    cut = media.windows(pcm, taken).select("media_id", F.col("window.speaker_id").alias("clip"), F.struct("window.start_ms", "window.end_ms", "window.ord", "pcm").alias("_x"))
    clips = cut.groupBy("media_id", "clip").agg(F.flatten(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["pcm"])).alias("pcm"))
    out = kept(embedder.apply(clips)).where("error is null").withColumn("_k", F.from_json("clip", "window int, side string, speaker_id string"))
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x))
    return out.where(size > 0).select("media_id", "_k.window", "_k.side", "_k.speaker_id", F.transform("vector", lambda x: F.round(x / size, 6)).alias("vector"))


def _seams(local: DataFrame, spans: DataFrame, overlap_ms: int) -> DataFrame:
    """``local`` turns inside the overlaps: a window's own (side local), and those of the window before (prior)."""
    # a seam with nobody behind it links nobody, so its prior speakers are left out
    seam = spans.where("window > 0").select("media_id", "window", F.col("start_ms").alias("_from"), (F.col("start_ms") + overlap_ms).alias("_to"))
    seam = seam.join(local.select("media_id", "window").distinct(), ["media_id", "window"], "left_semi")
    own = local.join(seam, ["media_id", "window"]).withColumn("side", F.lit("local"))
    before = local.join(seam.withColumn("window", F.col("window") - 1), ["media_id", "window"]).withColumn("side", F.lit("prior"))
    both = own.unionByName(before).withColumns({"start_ms": F.greatest("start_ms", "_from"), "end_ms": F.least("end_ms", "_to")})
    return both.where("end_ms > start_ms").drop("_from", "_to")


def transcripts(spark: SparkSession, pcm: DataFrame, models: Models, config: Config | None = None, overrides: dict | None = None, options: Options | None = None) -> DataFrame:
    """``media_id, body`` for each decoded media in ``pcm`` (blocks of :mod:`media`).

    ``overrides`` (least, top_k, gap_ms, least_ms, exclude_speech) replace sound settings where not None.
    ``options`` of a request choose the branches and the language, and ask for the loudest classes;
    without them the settings decide.  With ``response_format`` text, ``body`` is the text alone.
    """
    c = config or load()
    o = options or Options(align=c.align_enabled, diarize=c.speakers_enabled, sound_events=c.sound_enabled)
    overrides = (o.sound or {}) | (overrides or {})
    failed: list[DataFrame] = []

    def good(stage: str, out: DataFrame) -> DataFrame:
        out = kept(out)
        failed.append(failures(stage, out))
        return out.where("error is null")

    ms = lambda s: round(s * 1000)
    all_media = media.durations(pcm.where(F.col("rate") == media.RATE)).select("media_id", "duration_ms")
    whole = media.windows(pcm, all_media.select("media_id", F.lit(0).alias("window"), F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms")))
    found = good("detector", models.detector.apply(whole.select("media_id", "pcm")))
    last = found.groupBy("media_id").agg((F.max_by("kind", "ord") == "start").alias("active"))
    spoken = regions.from_events(found, all_media.join(last, "media_id"))
    spoken = regions.capped(regions.at_least(spoken, c.vad_min_speech_ms), ms(c.chunk_most_s))
    spoken = spoken.withColumn("ord", F.struct("ord", "piece"))
    chunks = regions.packed(spoken, all_media, ms(c.chunk_most_s), ms(c.chunk_pad_s))
    heard = media.windows(pcm, chunks.withColumnRenamed("chunk", "window"))
    heard = heard.join(chunks.select("media_id", F.col("chunk").alias("window"), F.col("start_ms").alias("offset_ms")), ["media_id", "window"])
    raw = good("recogniser", models.recogniser.apply(heard.withColumnRenamed("window", "chunk").select("media_id", "chunk", "offset_ms", "pcm")))
    if o.language:  # what a request says is not doubted
        raw = raw.withColumns({"language": F.lit(o.language), "language_probability": F.lit(1.0).cast("double")})
    said = segments.recognised(raw, c.language_least)
    texts = segments.full_text(said)
    langs = segments.languages(raw.withColumn("language", segments.trusted_language(F.col("language"), F.col("language_probability"), c.language_least)))
    speech = segments.stitched(said).drop("chunk", "seg", "language_probability").withColumn("kind", F.lit("speech"))
    alignment = speech.limit(0).select("media_id", F.lit(False).alias("applied"), F.lit(False).alias("failed"), F.lit(0).cast("long").alias("alignment_failed_segments")) if o.align and (options is not None or models.aligner is not None) else None
    if models.aligner is not None and o.align:
        numbered = segments.typed(speech.withColumn("alignment_failed", F.lit(None).cast("boolean"))).withColumn("language_probability", F.lit(None).cast("double"))
        fixed = segments.aligned(numbered, good("aligner", models.aligner.apply(numbered.select("media_id", "language", "id", "text", "start_ms", "end_ms"))))
        speech = segments.apply_aligned(speech, fixed)
        alignment = segments.failed_alignments(speech).withColumns({"applied": F.lit(True), "failed": F.col("alignment_failed_segments") > 0})
    who = None
    if models.diarizer is not None and o.diarize:
        spans = regions.overlapping_windows(all_media, ms(c.speakers_window_s), ms(c.speakers_overlap_s))
        local = good("diarizer", models.diarizer.apply(media.windows(pcm, spans)))
        local = local.join(spans.select("media_id", "window", F.col("start_ms").alias("_w")), ["media_id", "window"])
        local = local.withColumns({"start_ms": F.col("start_ms") + F.col("_w"), "end_ms": F.col("end_ms") + F.col("_w")}).drop("_w", "error")
        if models.embedder is not None:
            vectors = _embedded(pcm, _seams(local, spans, ms(c.speakers_overlap_s)), models.embedder, ms(c.speakers_min_speech_s))
        else:
            vectors = spark.createDataFrame([], "media_id string, window int, speaker_id string, side string, vector array<double>")
        named = turns.remapped(local, turns.linked(local, spans, vectors, ms(c.speakers_overlap_s), c.speakers_threshold))
        final = turns.merged_windows(named, spans, ms(c.speakers_overlap_s))
        speech = speakers.assigned(speech, final).withColumn("ord", F.struct("ord", "part")).drop("part")
        heard_in_all = final.withColumns({"window": F.lit(0), "side": F.lit("whole")})
        who = speakers.roster(speech, _embedded(pcm, heard_in_all, models.embedder, 3000) if models.embedder is not None else None)
    else:
        speech = speech.withColumn("ord", F.struct("ord", F.lit(0).alias("part")))
    sound = debug = None
    if models.tagger is not None and o.sound_events:
        chosen = {"least": c.sound_least, "top_k": c.sound_top_k, "gap_ms": ms(c.sound_gap_s), "least_ms": ms(c.sound_min_s), "exclude_speech": c.sound_exclude_speech}
        chosen = overridden(chosen, overrides)
        sound, debug = _sounds(pcm, all_media, models, c, chosen, good, o.debug_top_n)
    rows = assemble.timeline(speech, sound) if sound is not None else assemble.timeline(speech, speech.limit(0))
    wrong = failed[0]
    for part in failed[1:]:
        wrong = wrong.unionByName(part)
    out = assemble.response(rows, all_media, segments.overall_confidence(rows), langs, texts, who, alignment, debug, wrong)
    if o.response_format == "text":
        out = out.select("media_id").join(texts, "media_id", "left").select("media_id", F.coalesce("text", F.lit("")).alias("body"))
    return out


def _sounds(pcm: DataFrame, all_media: DataFrame, models: Models, c: Config, chosen: dict, good, debug_top_n: int) -> tuple[DataFrame, DataFrame | None]:
    """Sound events over overlapping windows of samples, each frame told by one window only; and the loudest classes if asked for."""
    per_ms = c.sound_rate / 1000
    samples = lambda s: round(s * c.sound_rate)
    total = all_media.select("media_id", F.rint(F.col("duration_ms") * per_ms).cast("long").alias("total"))
    spans = regions.sample_windows(total, samples(c.sound_window_s), samples(c.sound_overlap_s), samples(LEAST_TAIL_S))
    cut = spans.select("media_id", "window", F.rint(F.col("start") / per_ms).cast("long").alias("start_ms"), F.rint(F.col("end") / per_ms).cast("long").alias("end_ms"))
    probs = good("tagger", models.tagger.apply(media.windows(pcm, cut, c.sound_rate))).drop("error")
    counted = spans.join(probs.groupBy("media_id", "window").agg((F.max("frame") + 1).alias("frames")), ["media_id", "window"])
    own = frames.trimmed(probs, counted, samples(c.sound_overlap_s) // 2, c.sound_rate)
    begins = own.select("media_id", "window", "offset_ms").distinct()
    own = own.drop("offset_ms")
    one = frames.events(own, models.frame_ms, models.labels, allow=c.sound_allow, **chosen).join(begins, ["media_id", "window"])
    moved = {"start_ms": F.col("start_ms") + F.col("offset_ms"), "end_ms": F.col("end_ms") + F.col("offset_ms")}
    one = one.withColumns(moved | {"ord": F.struct("window", -F.col("score"), "class")}).drop("offset_ms", "window")
    sound = frames.merged(one, chosen["gap_ms"]).withColumn("ord", F.struct(F.col("class").cast("int").alias("ord"), F.lit(0).alias("part")))
    if debug_top_n <= 0:
        return sound, None
    peaks = frames.peaks(own, models.frame_ms).join(begins, ["media_id", "window"]).withColumn("at_ms", F.col("at_ms") + F.col("offset_ms")).drop("offset_ms")
    best = frames.best_peaks(peaks, debug_top_n)
    if models.labels is None:
        return sound, best.withColumn("label", F.col("class").cast("string"))
    named = models.labels.select("class", F.col("label").alias("_l"))
    return sound, best.join(F.broadcast(named), "class", "left").withColumn("label", F.coalesce("_l", F.col("class").cast("string")))  # a model's classes: hundreds
