"""The timeline of a media, and the response made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions.scalars import seconds


def timeline(speech: DataFrame, sound: DataFrame) -> DataFrame:
    """Speech and sound rows of a media in order of start: at equal starts speech first, then by ord.

    ``ord`` is the place in the timeline.
    """
    both = speech.withColumn("kind", F.lit("speech")).unionByName(sound.withColumn("kind", F.lit("sound")), allowMissingColumns=True)
    by = W.partitionBy("media_id").orderBy("start_ms", (F.col("kind") == "sound").cast("int"), "ord")
    return both.withColumn("ord", F.row_number().over(by) - 1)


def entry(rows: DataFrame):
    """A timeline row as a struct for JSON; fields that a row lacks are null, and absent in JSON."""
    have = set(rows.columns)
    sound = F.col("kind") == "sound"
    only = lambda c, cond: F.when(cond, F.col(c)).alias(c)
    fields = ["kind", seconds(F.col("start_ms")).alias("start"), seconds(F.col("end_ms")).alias("end")]
    fields += [only(c, ~sound) for c in ("text", "confidence", "language", "speaker_id", "alignment_failed") if c in have]
    if "words" in have:
        words = F.transform("words", lambda w: F.struct(w["word"].alias("word"), seconds(w["start_ms"]).alias("start"), seconds(w["end_ms"]).alias("end"), F.when(w["probability"] != 0, F.round(w["probability"], 3)).alias("probability")))
        fields.append(F.when(~sound & (F.size("words") > 0), words).alias("words"))
    if "label" in have:
        fields += [only(c, sound) for c in ("label", "score") if c in have]
        fields += [F.when(sound, F.col("class")).alias("index")] if "class" in have else []
        fields += [F.when(sound, F.coalesce("prompt_relevant", F.lit(True))).alias("prompt_relevant")] if "prompt_relevant" in have else []
    return F.struct(*fields)


def response(rows: DataFrame, media: DataFrame, confidence: DataFrame, langs: DataFrame, text: DataFrame, speakers: DataFrame | None = None, alignment: DataFrame | None = None, debug: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """``media_id, body``: one JSON document per media, media without rows included.

    ``alignment``: media_id, applied, failed, alignment_failed_segments, where alignment was asked for; media
    that it lacks were not aligned.  ``debug``: media_id, rank, class, label, score, at_ms, the loudest
    classes.  ``failed``: media_id, stage, error, what went wrong on the way; absent where nothing did.
    """
    own = rows.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", entry(rows).alias("e")))), lambda x: x["e"]).alias("segments"))
    out = media.select("media_id", "duration_ms").join(own, "media_id", "left").join(confidence, "media_id", "left").join(langs, "media_id", "left").join(text, "media_id", "left")
    empty = F.array().cast("array<string>")
    fields = [
        F.lit("transcribe").alias("task"),
        F.coalesce(F.get("languages", F.lit(0)), F.lit("unknown")).alias("language"),
        F.coalesce("languages", empty).alias("languages"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        seconds(F.col("duration_ms")).alias("duration"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("segments", F.array().cast(dict(own.dtypes)["segments"])).alias("segments"),
    ]
    if speakers is not None:
        cols = [c for c in ("embedding",) if c in speakers.columns]
        who = speakers.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("id", seconds(F.col("speech_ms")).alias("speech_seconds"), "segment_count", *cols))).alias("speakers"))
        out = out.join(who, "media_id", "left")
        fields.append(F.col("speakers"))
    if alignment is not None:
        out = out.join(alignment, "media_id", "left")
        no = F.lit(False)
        fields += [F.lit(True).alias("alignment_requested"), F.coalesce("applied", no).alias("alignment_applied"), F.coalesce("failed", no).alias("alignment_failed")]
        fields.append(F.coalesce("alignment_failed_segments", F.lit(0)).alias("alignment_failed_segments"))
    if debug is not None:
        peak = F.struct("rank", F.struct("label", F.col("class").alias("index"), F.round(F.col("score").cast("double"), 3).alias("score"), seconds(F.col("at_ms")).alias("at")).alias("p"))
        out = out.join(debug.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(peak)), lambda x: x["p"]).alias("aed_debug")), "media_id", "left")
        fields.append("aed_debug")
    if failed is not None:
        out = out.join(failed.groupBy("media_id").agg(F.array_sort(F.collect_set(F.struct("stage", "error"))).alias("failures")), "media_id", "left")
        fields.append("failures")
    return out.select("media_id", F.to_json(F.struct(*fields)).alias("body"))
