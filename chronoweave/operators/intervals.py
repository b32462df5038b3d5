"""Joins of intervals with points and intervals.

Without more, a join on overlapping times has no key but the media, and one long recording is
one task.  Here time is cut into buckets: an interval stands in each bucket that it touches, a
point in one, and joins are on (media, bucket).  A pair that shares several buckets is taken in the
first of them only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.scalars import overlap_ms

BUCKET_MS = 600_000


def _bucket(ms: Column, width: int) -> Column:
    return F.floor(ms / F.lit(width)).cast("long")


def _spread(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each bucket of ``[start, end)``; empty intervals stand in none."""
    return df.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end) - 1, width))))


def overlapping(left: DataFrame, right: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of one media with a positive overlap: columns of ``left``, ``r_`` ones of ``right``, ``overlap_ms``.

    Both have media_id, start_ms, end_ms.
    """
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    a = _spread(left, "start_ms", "end_ms", bucket_ms)
    b = _spread(r, "r_start_ms", "r_end_ms", bucket_ms).withColumnRenamed("_b", "_rb")
    first = F.greatest(_bucket(F.col("start_ms"), bucket_ms), _bucket(F.col("r_start_ms"), bucket_ms))
    both = a.join(b, (F.col("media_id") == F.col("r_media_id")) & (F.col("_b") == F.col("_rb")) & (F.col("_b") == first))
    over = overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("r_start_ms"), F.col("r_end_ms"))
    return both.withColumn("overlap_ms", over).where("overlap_ms > 0").drop("_b", "_rb", "r_media_id")


def best_overlap(spans: DataFrame, turns: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``spans`` with ``speaker_id`` of the turn with the largest overlap; ties to the smaller ord; null without any.

    ``spans`` is keyed by (media_id, span_id); turns have ord and speaker_id.
    """
    pairs = overlapping(spans.select("media_id", "span_id", "start_ms", "end_ms"), turns.select("media_id", "ord", "start_ms", "end_ms", "speaker_id"), bucket_ms)
    best = pairs.groupBy("media_id", "span_id").agg(F.max_by("r_speaker_id", F.struct("overlap_ms", -F.col("r_ord"))).alias("speaker_id"))
    return spans.join(best, ["media_id", "span_id"], "left")


def first_containing(points: DataFrame, turns: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``points`` (media_id, span_id, at_ms) with ``speaker_id`` of the first turn by ord with start <= at < end.

    at_ms may be fractional (a midpoint); null without such a turn.
    """
    t = _spread(turns.select("media_id", "ord", "start_ms", "end_ms", "speaker_id"), "start_ms", "end_ms", bucket_ms)
    t = t.select(F.col("media_id").alias("_m"), "_b", F.col("ord").alias("_o"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.col("speaker_id").alias("_k"))
    p = points.select("media_id", "span_id", "at_ms").withColumn("_pb", _bucket(F.floor("at_ms"), bucket_ms))
    hit = p.join(t, (F.col("media_id") == F.col("_m")) & (F.col("_pb") == F.col("_b")) & (F.col("at_ms") >= F.col("_s")) & (F.col("at_ms") < F.col("_e")))
    best = hit.groupBy("media_id", "span_id").agg(F.min_by("_k", "_o").alias("speaker_id"))
    return points.join(best, ["media_id", "span_id"], "left")


def word_speakers(words: DataFrame, turns: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``words`` (media_id, span_id, start_ms, end_ms) with the speaker at their midpoint, else of the largest overlap."""
    at = first_containing(words.withColumn("at_ms", (F.col("start_ms") + F.col("end_ms")) / 2), turns, bucket_ms).withColumnRenamed("speaker_id", "_at")
    return best_overlap(at, turns, bucket_ms).withColumn("speaker_id", F.coalesce("_at", "speaker_id")).drop("_at", "at_ms")


def clipped(intervals: DataFrame, windows: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Spans of ``intervals`` inside ``windows`` (media_id, window): ``media_id, window, speaker_id, ord, start_ms, end_ms``."""
    pairs = overlapping(windows.select("media_id", "window", "start_ms", "end_ms"), intervals.select("media_id", "ord", "speaker_id", "start_ms", "end_ms"), bucket_ms)
    return pairs.select(
        "media_id",
        "window",
        F.col("r_speaker_id").alias("speaker_id"),
        F.col("r_ord").alias("ord"),
        F.greatest("start_ms", "r_start_ms").alias("start_ms"),
        F.least("end_ms", "r_end_ms").alias("end_ms"),
    )


def midpoint_in(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows whose midpoint lies in ``[start, end)``."""
    mid2 = F.col("start_ms") + F.col("end_ms")
    return df.where((mid2 >= 2 * start) & (mid2 < 2 * end))


def shifted(df: DataFrame, offset_ms: Column | int) -> DataFrame:
    """Times moved by an offset."""
    by = F.lit(offset_ms) if isinstance(offset_ms, int) else offset_ms
    return df.withColumns({"start_ms": F.col("start_ms") + by, "end_ms": F.col("end_ms") + by})
