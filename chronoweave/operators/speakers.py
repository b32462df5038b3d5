"""Speakers of transcript segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions.text import normalize_segment_text, strip
from chronoweave.operators.intervals import BUCKET_MS, best_overlap, word_speakers


def regrouped(words: DataFrame) -> DataFrame:
    """Words of a segment with one speaker after the other, joined: a new segment where the speaker changes.

    ``words``: media_id, ord (segment), w (place), start_ms, end_ms, word, speaker_id; no speaker is a
    speaker of its own.  Gives media_id, ord, part, start_ms, end_ms, text, speaker_id.
    """
    own = W.partitionBy("media_id", "ord").orderBy("w")
    turn = F.coalesce((~F.col("speaker_id").eqNullSafe(F.lag("speaker_id").over(own))).cast("int"), F.lit(1))
    r = words.withColumn("_t", F.when(F.row_number().over(own) == 1, 1).otherwise(turn)).withColumn("part", F.sum("_t").over(own.rowsBetween(W.unboundedPreceding, 0)) - 1)
    texts = F.array_sort(F.collect_list(F.when(strip(F.col("word")) != "", F.struct("w", strip(F.col("word")).alias("t")))))
    out = r.groupBy("media_id", "ord", "part").agg(F.min_by("start_ms", "w").alias("start_ms"), F.max_by("end_ms", "w").alias("end_ms"), texts.alias("_x"), F.min_by("speaker_id", "w").alias("speaker_id"))
    text = normalize_segment_text(F.array_join(F.transform("_x", lambda x: x["t"]), " "))
    return out.withColumn("text", text).drop("_x")


def assigned(segments: DataFrame, turns: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Segments with speakers: ``media_id, ord, part, start_ms, end_ms, text, speaker_id`` and other columns of ``segments``.

    ``segments`` has media_id, ord, start_ms, end_ms, text, words array<struct<word, start_ms, end_ms>>.
    Segments with words are cut where their words' speaker changes; others take the turn with the
    largest overlap.  Media without turns keep their segments, without speakers; words go in any case.
    """
    heard = turns.select("media_id").distinct()
    rest = [c for c in segments.columns if c not in ("media_id", "ord", "start_ms", "end_ms", "text", "words")]
    plain = segments.join(heard, "media_id", "left_anti").drop("words").withColumns({"part": F.lit(0), "speaker_id": F.lit(None).cast("string")})
    known = segments.join(heard, "media_id", "left_semi")
    whole = best_overlap(known.where("words is null or size(words) = 0").drop("words").withColumn("span_id", F.col("ord")), turns, bucket_ms).drop("span_id").withColumn("part", F.lit(0))
    spoken = known.where("size(words) > 0")
    words = spoken.select("media_id", "ord", F.posexplode("words").alias("w", "_w")).select("media_id", "ord", "w", F.col("_w.word").alias("word"), F.col("_w.start_ms").alias("start_ms"), F.col("_w.end_ms").alias("end_ms"))
    said = word_speakers(words.withColumn("span_id", F.struct("ord", "w")), turns, bucket_ms)
    parts = regrouped(said.select("media_id", "ord", "w", "start_ms", "end_ms", "word", "speaker_id"))
    parts = parts.join(spoken.select("media_id", "ord", *rest), ["media_id", "ord"])
    cols = ["media_id", "ord", "part", "start_ms", "end_ms", "text", "speaker_id", *rest]
    return plain.select(cols).unionByName(whole.select(cols)).unionByName(parts.withColumn("part", F.col("part").cast("int")).select(cols))


def roster(segments: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """``media_id, id, speech_ms, segment_count`` of speakers (not null, not blank), ``embedding`` if ``vectors`` are given.

    Order it by id as text: ``spk_10`` comes before ``spk_2``.
    """
    out = segments.where("speaker_id <> ''").groupBy("media_id", F.col("speaker_id").alias("id")).agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("speech_ms"), F.count("*").alias("segment_count"))
    if vectors is None:
        return out
    return out.join(vectors.select("media_id", F.col("speaker_id").alias("id"), F.col("vector").alias("embedding")), ["media_id", "id"], "left")
