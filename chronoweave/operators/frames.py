"""From class probabilities of frames to events.

``probs`` is long: media_id, window, frame, class, prob (float).  Only frames that count are moved
between tasks: the threshold is applied in the scan, and the top-k is a grouped limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions.text import is_speech_label, prompt_relevant


def active(probs: DataFrame, least: float = 0.35, top_k: int = 3, classes: int | None = None) -> DataFrame:
    """Rows of ``least`` or more that are among their frame's ``top_k`` (ties to the smaller class).

    top_k of 0 or less, or of as many as there are ``classes``, sets no limit.  The threshold is
    compared as float, as probabilities are.
    """
    over = probs.where(F.col("prob") >= F.lit(least).cast("float"))
    if top_k <= 0 or (classes is not None and top_k >= classes):
        return over
    # rows under the threshold never push one above it out of the first k, so they need no rank
    by = W.partitionBy("media_id", "window", "frame").orderBy(F.desc("prob"), "class")
    return over.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= top_k).drop("_r")


def runs(on: DataFrame, gap_frames: int) -> DataFrame:
    """Runs of active frames of a class, bridged over up to ``gap_frames``: media_id, window, class, first, past."""
    own = W.partitionBy("media_id", "window", "class").orderBy("frame")
    new = F.coalesce((F.col("frame") - F.lag("frame").over(own) > max(gap_frames, 0) + 1).cast("int"), F.lit(1))
    isle = on.withColumn("_new", new).withColumn("_isle", F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    return isle.groupBy("media_id", "window", "class", "_isle").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("past")).drop("_isle")


def events(
    probs: DataFrame,
    frame_ms: int,
    labels: DataFrame | None = None,
    least: float = 0.35,
    top_k: int = 3,
    gap_ms: int = 600,
    least_ms: int = 500,
    exclude_speech: bool = True,
    allow: tuple[str, ...] = (),
    classes: int | None = None,
) -> DataFrame:
    """Events: media_id, window, class, label, start_ms, end_ms, score, prompt_relevant.

    The score is the class's largest probability from the run's first to its last frame, bridged
    frames and those beyond the top-k included.  ``labels`` (class, label) names classes; others
    are named by their number.
    """
    on = active(probs, least, top_k, classes)
    gap = round(gap_ms / frame_ms) if frame_ms > 0 else 0
    isles = runs(on, gap).where((F.col("past") - F.col("first")) * frame_ms >= least_ms)
    named = isles.withColumn("label", F.col("class").cast("string"))
    if labels is not None:
        named = isles.join(F.broadcast(labels.select("class", F.col("label").alias("_l"))), "class", "left")  # a model's classes: hundreds
        named = named.withColumn("label", F.coalesce("_l", F.col("class").cast("string"))).drop("_l")
    if exclude_speech:
        named = named.where(~is_speech_label(F.col("label")))
    # each frame of a class meets the run it lies in: the latest that begins at or before it
    own = W.partitionBy("media_id", "window", "class").orderBy("frame", "_kind").rowsBetween(W.unboundedPreceding, 0)
    begins = named.select("media_id", "window", "class", F.col("first").alias("frame"), F.lit(0).alias("_kind"), F.struct("first", "past", "label").alias("_run"), F.lit(None).cast("float").alias("prob"))
    all_ = begins.unionByName(probs.select("media_id", "window", "class", "frame", "prob").withColumns({"_kind": F.lit(1), "_run": F.lit(None).cast("struct<first:bigint,past:bigint,label:string>")}))
    met = all_.withColumn("_in", F.last("_run", ignorenulls=True).over(own)).where("_kind = 1 and frame < _in.past")
    out = met.groupBy("media_id", "window", "class", "_in").agg(F.max("prob").alias("score"))
    return out.select(
        "media_id",
        "window",
        "class",
        "_in.label",
        (F.col("_in.first") * frame_ms).cast("long").alias("start_ms"),
        (F.col("_in.past") * frame_ms).cast("long").alias("end_ms"),
        F.round(F.col("score").cast("double"), 3).alias("score"),
        prompt_relevant(F.col("_in.label"), allow).alias("prompt_relevant"),
    )


def peaks(probs: DataFrame, frame_ms: int) -> DataFrame:
    """Per media, window and class the largest probability and the first frame that has it: score, at_ms."""
    best = probs.groupBy("media_id", "window", "class").agg(F.max("prob").alias("score"), F.min_by("frame", F.struct(-F.col("prob"), "frame")).alias("_f"))
    return best.select("media_id", "window", "class", "score", (F.col("_f") * frame_ms).cast("long").alias("at_ms"))


def best_peaks(per_window: DataFrame, top_n: int | None = None) -> DataFrame:
    """Over windows the highest peak of each class (ties to the earlier window), the ``top_n`` of a media if given."""
    best = per_window.groupBy("media_id", "class").agg(F.max_by(F.struct("score", "at_ms"), F.struct("score", -F.col("window"))).alias("p"))
    best = best.select("media_id", "class", "p.score", "p.at_ms")
    if top_n is None:
        return best
    by = W.partitionBy("media_id").orderBy(F.desc("score"), "class")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_n)


def trimmed(probs: DataFrame, windows: DataFrame, half: int, rate: int) -> DataFrame:
    """Frames without the seam margins; frames count anew from 0, ``offset_ms`` says where their first one lies.

    ``windows`` is of :func:`regions.sample_windows` with the number of ``frames`` of each.  A margin of
    ``half`` samples goes at inner edges, unless nothing would be left.  Half a millisecond of an offset
    is rounded up.
    """
    w = windows.withColumn("_ratio", F.col("frames") / (F.col("end") - F.col("start")))
    cut = F.rint(F.lit(half) * F.col("_ratio")).cast("long")
    w = w.withColumns({"_l": F.when(F.col("start") == 0, F.lit(0)).otherwise(cut), "_r": F.when(F.col("end") >= F.col("total"), F.lit(0)).otherwise(cut)})
    fits = F.col("_l") + F.col("_r") < F.col("frames")
    w = w.withColumn("offset_ms", F.round((F.col("start") + F.col("_l") / F.col("_ratio")) / rate * 1000).cast("long"))
    w = w.withColumns({"_l": F.when(fits, F.col("_l")).otherwise(0), "_r": F.when(fits, F.col("_r")).otherwise(0)})
    out = probs.join(w.select("media_id", "window", "frames", "_l", "_r", "offset_ms"), ["media_id", "window"])
    out = out.where((F.col("frame") >= F.col("_l")) & (F.col("frame") < F.col("frames") - F.col("_r")))
    return out.withColumn("frame", F.col("frame") - F.col("_l")).drop("_l", "_r", "frames")


def merged(found: DataFrame, gap_ms: int) -> DataFrame:
    """Events of one label merged over gaps of up to ``gap_ms``, across window seams.

    ``found`` has media_id, ord (order among equal starts), start_ms, end_ms, label, class, score,
    prompt_relevant.  In order of start, an event only merges with what stands right before it:
    another label between two events keeps them apart.  The gap is measured from the furthest end so
    far.  A gap of 0 or less merges nothing.
    """
    if gap_ms <= 0:
        return found.drop("ord")
    own = W.partitionBy("media_id").orderBy("start_ms", "ord")
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    r = found.withColumn("_turn", F.coalesce((F.col("label") != F.lag("label").over(own)).cast("int"), F.lit(1)))
    r = r.withColumn("_label_run", F.sum("_turn").over(upto))
    run = W.partitionBy("media_id", "_label_run").orderBy("start_ms", "ord")
    end = F.max("end_ms").over(run.rowsBetween(W.unboundedPreceding, -1))
    r = r.withColumn("_new", F.when(end.isNull() | (F.col("start_ms") - end > gap_ms), 1).otherwise(0))
    r = r.withColumn("_isle", F.sum("_new").over(run.rowsBetween(W.unboundedPreceding, 0)))
    order = F.struct("start_ms", "ord")
    return (
        r.groupBy("media_id", "_label_run", "_isle")
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.min_by("label", order).alias("label"),
            F.min_by("class", order).alias("class"),
            F.max("score").alias("score"),
            F.bool_or("prompt_relevant").alias("prompt_relevant"),
        )
        .drop("_label_run", "_isle")
    )
