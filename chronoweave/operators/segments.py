"""Transcript segments: from recogniser output to the timeline, and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions.scalars import confidence_to_logprob, logprob_to_confidence, millis
from chronoweave.functions.text import normalize_segment_text, strip, trusted_language


def timed_words(words: Column, offset_ms: Column | None = None) -> Column:
    """Words with both times, raw token not empty: word stripped, times in ms, moved by an offset."""
    by = F.lit(0).cast("long") if offset_ms is None else offset_ms
    ok = F.filter(words, lambda w: (F.coalesce(w["word"], F.lit("")) != "") & w["start"].isNotNull() & w["end"].isNotNull())
    return F.transform(ok, lambda w: F.struct(strip(w["word"]).alias("word"), (millis(w["start"]) + by).alias("start_ms"), (millis(w["end"]) + by).alias("end_ms"), F.coalesce(w["probability"], F.lit(0.0)).alias("probability")))


def recognised(raw: DataFrame, language_least: float = 0.5, normalize: bool = True) -> DataFrame:
    """Segments from recogniser rows.

    ``raw``: media_id, chunk, offset_ms, language, language_probability, segments array<struct<text,
    start, end, avg_logprob, no_speech_prob, compression_ratio, words>>.  Blank segments go, the others keep
    their number.  A language below ``language_least`` is unknown, and null on segments.  Words, where
    there are any, set the segment's span.
    """
    r = raw.withColumn("language", trusted_language(F.col("language"), F.col("language_probability"), language_least))
    one = r.select("media_id", "chunk", "offset_ms", "language", "language_probability", F.posexplode("segments").alias("seg", "s")).where(strip(F.col("s.text")) != "")
    words = timed_words(F.col("s.words"), F.col("offset_ms"))
    known = F.col("language") != "unknown"
    out = one.withColumn("words", words)
    has = F.size("words") > 0
    logprob = F.coalesce("s.avg_logprob", F.lit(-0.5))
    text = normalize_segment_text(F.col("s.text")) if normalize else strip(F.col("s.text"))
    return out.select(
        "media_id",
        "chunk",
        "seg",
        F.when(has, F.element_at("words", 1)["start_ms"]).otherwise(millis(F.col("s.start")) + F.col("offset_ms")).alias("start_ms"),
        F.when(has, F.element_at("words", -1)["end_ms"]).otherwise(millis(F.col("s.end")) + F.col("offset_ms")).alias("end_ms"),
        text.alias("text"),
        logprob.alias("avg_logprob"),
        F.coalesce("s.no_speech_prob", F.lit(0.0)).alias("no_speech_prob"),
        F.coalesce("s.compression_ratio", F.lit(1.0)).alias("compression_ratio"),
        logprob_to_confidence(logprob).alias("confidence"),
        F.when(known, F.col("language")).alias("language"),
        F.when(known, F.col("language_probability")).alias("language_probability"),
        "words",
    )


def stitched(segments: DataFrame) -> DataFrame:
    """One ``ord`` over a media's chunks: by start, then chunk and place in it."""
    return segments.withColumn("ord", F.row_number().over(W.partitionBy("media_id").orderBy("start_ms", "chunk", "seg")) - 1)


def languages(chunks: DataFrame) -> DataFrame:
    """``media_id, languages``: known languages in order of first appearance; ``chunks`` has chunk and language."""
    first = chunks.where("language is not null and language not in ('', 'unknown')").groupBy("media_id", "language").agg(F.min("chunk").alias("c"))
    return first.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "language"))), lambda x: x["language"]).alias("languages"))


def full_text(segments: DataFrame) -> DataFrame:
    """``media_id, text``: texts joined in order of chunks (not of starts), stripped."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "seg", "text")))
    return segments.groupBy("media_id").agg(strip(F.array_join(F.transform(parts, lambda x: x["text"]), " ")).alias("text"))


def overall_confidence(segments: DataFrame) -> DataFrame:
    """``media_id, confidence``: mean weighted by length (1 ms at least) over speech, 3 places; 0 without speech."""
    speech = F.col("kind") == "speech"
    w = F.when(speech, F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1)))
    c = F.coalesce("confidence", F.lit(0.0))
    return segments.groupBy("media_id").agg(F.coalesce(F.round(F.sum(c * w) / F.sum(w), 3), F.lit(0.0)).alias("confidence"))


def typed(timeline: DataFrame) -> DataFrame:
    """Speech rows of a timeline with dense ``id`` from 0, defaults filled in, words without a token gone."""
    t = timeline.where("kind = 'speech'")
    return t.withColumns(
        {
            "id": F.row_number().over(W.partitionBy("media_id").orderBy("ord")) - 1,
            "avg_logprob": F.coalesce("avg_logprob", confidence_to_logprob(F.col("confidence"))),
            "no_speech_prob": F.coalesce("no_speech_prob", F.lit(0.0)),
            "compression_ratio": F.coalesce("compression_ratio", F.lit(1.0)),
            "alignment_failed": F.coalesce("alignment_failed", F.lit(False)),
            "words": F.filter("words", lambda w: F.coalesce(w["word"], F.lit("")) != ""),
        }
    )


def aligned(original: DataFrame, found: DataFrame) -> DataFrame:
    """Aligner output mapped to segments: words, span and failure, other figures from the segment of its number.

    ``found``: media_id, id, start_ms, end_ms, text, words array<struct<word,start,end,probability>>, failed
    (the aligner's own report).  A segment has failed if its text is not blank and it has no timed
    words or was reported.  Where no segment has the number, the one in that place is taken, else
    defaults.
    """
    place = W.partitionBy("media_id").orderBy("id")
    cols = ["avg_logprob", "no_speech_prob", "compression_ratio", "language", "language_probability"]
    o = original.withColumn("_place", F.row_number().over(place) - 1)
    by_id = o.select("media_id", "id", F.struct(*cols).alias("_a"))
    by_place = o.select("media_id", F.col("_place").alias("id"), F.struct(*cols).alias("_b"))
    f = found.join(by_id, ["media_id", "id"], "left").join(by_place, ["media_id", "id"], "left").withColumn("_o", F.coalesce("_a", "_b"))
    f = f.withColumn("words", timed_words(F.col("words"))).withColumn("text", strip(F.col("text")))
    has = F.size("words") > 0
    return f.select(
        "media_id",
        "id",
        F.when(has, F.element_at("words", 1)["start_ms"]).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(has, F.element_at("words", -1)["end_ms"]).otherwise(F.col("end_ms")).alias("end_ms"),
        "text",
        "words",
        F.coalesce("_o.avg_logprob", F.lit(-0.5)).alias("avg_logprob"),
        F.coalesce("_o.no_speech_prob", F.lit(0.0)).alias("no_speech_prob"),
        F.coalesce("_o.compression_ratio", F.lit(1.0)).alias("compression_ratio"),
        "_o.language",
        "_o.language_probability",
        ((F.col("text") != "") & (~has | F.coalesce("failed", F.lit(False)))).alias("alignment_failed"),
    )


def apply_aligned(timeline: DataFrame, found: DataFrame) -> DataFrame:
    """A timeline whose i-th speech row takes the i-th aligned segment; rows without one are kept as failed.

    The row's own speaker stays.  Sound rows are left as they are.  Confidence comes from the aligned
    row's log-probability.
    """
    speech = timeline.where("kind = 'speech'").withColumn("_i", F.row_number().over(W.partitionBy("media_id").orderBy("ord")) - 1)
    new = ["start_ms", "end_ms", "text", "words", "avg_logprob", "no_speech_prob", "compression_ratio", "language", "alignment_failed"]
    f = found.withColumn("_i", F.row_number().over(W.partitionBy("media_id").orderBy("id")) - 1).select("media_id", "_i", F.struct(*new).alias("_n"))
    j = speech.join(f, ["media_id", "_i"], "left")
    hit = F.col("_n").isNotNull()
    kept = {c: F.when(hit, F.col(f"_n.{c}")).otherwise(F.col(c)) for c in new if c != "alignment_failed" and c in speech.columns}
    kept["alignment_failed"] = F.coalesce("_n.alignment_failed", F.lit(True))
    if "confidence" in speech.columns:
        kept["confidence"] = F.when(hit, logprob_to_confidence(F.col("_n.avg_logprob"))).otherwise(F.col("confidence"))
    return j.withColumns(kept).drop("_n", "_i").unionByName(timeline.where("kind <> 'speech'"), allowMissingColumns=True)


def failed_alignments(timeline: DataFrame) -> DataFrame:
    """``media_id, alignment_failed_segments``."""
    return timeline.groupBy("media_id").agg(F.count_if(F.coalesce("alignment_failed", F.lit(False))).alias("alignment_failed_segments"))
