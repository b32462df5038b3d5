"""Speech regions: from detector events to regions, and from regions to bounded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def from_events(events: DataFrame, media: DataFrame) -> DataFrame:
    """Regions from ``events`` (media_id, ord, kind 'start'/'end', at_ms) and ``media`` (media_id, duration_ms, active).

    An end closes the start right before it; an end without a start before it counts for nothing,
    as does a start that another start follows.  A last start without an end runs to the media's
    end if speech is still active there.  Gives media_id, ord, start_ms, end_ms.
    """
    own = W.partitionBy("media_id").orderBy("ord")
    e = events.where(F.col("kind").isin("start", "end"))
    e = e.withColumns({"_before": F.lag("kind").over(own), "_from": F.lag("at_ms").over(own), "_next": F.lead("kind").over(own)})
    closed = e.where("kind = 'end' and _before = 'start'").select("media_id", "ord", F.col("_from").alias("start_ms"), F.col("at_ms").alias("end_ms"))
    last = e.where("kind = 'start' and _next is null").join(media.where("active"), "media_id")
    open_ = last.select("media_id", "ord", F.col("at_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    return closed.unionByName(open_)


def at_least(regions: DataFrame, least_ms: int) -> DataFrame:
    """Without regions shorter than ``least_ms``; 0 and less keep all."""
    return regions if least_ms <= 0 else regions.where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def capped(regions: DataFrame, most_ms: int) -> DataFrame:
    """Regions cut into pieces of up to ``most_ms`` (0 and less: as they are), with their number ``piece``."""
    if most_ms <= 0:
        return regions.withColumn("piece", F.lit(0))
    n = F.ceil((F.col("end_ms") - F.col("start_ms")) / F.lit(most_ms)).cast("int")
    cut = regions.where("end_ms > start_ms").withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("start_ms") + F.col("piece").cast("long") * most_ms
    return cut.withColumns({"start_ms": start, "end_ms": F.least("end_ms", start + most_ms)})


def packed(regions: DataFrame, media: DataFrame, most_ms: int = 28_000, pad_ms: int = 200) -> DataFrame:
    """Chunks of consecutive regions whose span stays within ``most_ms``, padded and clamped to the media.

    ``regions`` has media_id, ord, start_ms, end_ms; ``media`` has media_id, duration_ms.  Which region
    begins a chunk depends on where the one before began, so each media's regions are folded in order;
    a fold keeps only the chunks' bounds, and media are spread over tasks.  Gives media_id, chunk
    (from 0), start_ms, end_ms; chunks that clamping empties are left out, their numbers too.
    """
    rows = F.array_sort(F.collect_list(F.struct("ord", "start_ms", "end_ms")))
    each = regions.groupBy("media_id").agg(rows.alias("r"))
    span = "struct<s:bigint,e:bigint>"
    begin = F.struct(F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), F.array().cast(f"array<{span}>").alias("done"))

    def step(acc, x):
        fits = acc["s"].isNotNull() & (x["end_ms"] - acc["s"] <= most_ms)
        closed = F.when(acc["s"].isNull() | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e")))))
        return F.struct(F.when(fits, acc["s"]).otherwise(x["start_ms"]).alias("s"), x["end_ms"].alias("e"), closed.alias("done"))

    fold = F.aggregate("r", begin, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e")))))
    cut = each.select("media_id", F.posexplode(fold).alias("chunk", "c")).join(media.select("media_id", "duration_ms"), "media_id")
    start, end = F.greatest(F.lit(0), F.col("c.s") - pad_ms), F.least("duration_ms", F.col("c.e") + pad_ms)
    out = cut.select("media_id", "chunk", start.alias("start_ms"), end.alias("end_ms")).where("end_ms > start_ms")
    return out.withColumn("chunk", F.row_number().over(W.partitionBy("media_id").orderBy("chunk")) - 1)


def overlapping_windows(media: DataFrame, window_ms: int = 600_000, overlap_ms: int = 30_000) -> DataFrame:
    """Windows over each media: ``media_id, window, start_ms, end_ms, last``.

    One window where ``window_ms`` is 0 or less or not shorter than the media; none for empty media.
    The overlap is clamped to half a window.
    """
    m = media.where("duration_ms > 0")
    if window_ms <= 0:
        return m.select("media_id", F.lit(0).alias("window"), F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"), F.lit(True).alias("last"))
    step = max(window_ms - max(0, min(overlap_ms, window_ms // 2)), window_ms // 2)
    n = F.greatest(F.lit(1), F.ceil((F.col("duration_ms") - window_ms) / F.lit(step)).cast("int") + 1)
    w = m.select("media_id", "duration_ms", n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    start = F.col("window").cast("long") * step
    return w.select("media_id", "window", start.alias("start_ms"), F.least("duration_ms", start + window_ms).alias("end_ms"), (F.col("window") == F.col("_n") - 1).alias("last"))


def sample_windows(media: DataFrame, window: int, overlap: int, least_tail: int) -> DataFrame:
    """Windows in samples over ``media`` (media_id, total): ``media_id, window, start, end, total``.

    The overlap is at most window - 1; a tail shorter than ``least_tail`` belongs to the window before it.
    """
    m = media.where("total > 0")
    if window <= 0:
        return m.select("media_id", F.lit(0).alias("window"), F.lit(0).cast("long").alias("start"), F.col("total").alias("end"), "total")
    step = window - min(max(overlap, 0), window - 1)
    # the first window i whose end i * step + window is within least_tail of the total ends it
    left = F.col("total") - window
    n = F.when(left <= 0, 1).otherwise(F.least(F.ceil(left / F.lit(step)), F.greatest(F.lit(0), F.floor((left - least_tail) / F.lit(step)) + 1)).cast("int") + 1)
    w = m.withColumn("_n", n).withColumn("window", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.col("window").cast("long") * step
    end = F.when(F.col("window") == F.col("_n") - 1, F.col("total")).otherwise(start + window)
    return w.select("media_id", "window", start.alias("start"), end.alias("end"), "total")


def owned(windows: DataFrame, overlap_ms: int) -> DataFrame:
    """``windows`` with ``own_start, own_end``: inner edges moved in by half the overlap."""
    half = max(overlap_ms, 0) / 2
    first, last = F.col("window") == 0, F.col("last")
    return windows.withColumns({"own_start": F.col("start_ms") + F.when(first, 0.0).otherwise(half), "own_end": F.col("end_ms") - F.when(last, 0.0).otherwise(half)})


def select_owned(intervals: DataFrame, windows: DataFrame, overlap_ms: int) -> DataFrame:
    """``intervals`` (media_id, window, ...) whose midpoint lies in their window's own span."""
    w = owned(windows, overlap_ms).select("media_id", "window", "own_start", "own_end")
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    return intervals.join(w, ["media_id", "window"]).where((mid >= F.col("own_start")) & (mid < F.col("own_end"))).drop("own_start", "own_end")


def frames_of(blocks: DataFrame, frame: int = 512) -> DataFrame:
    """Frames of ``frame`` samples from ``blocks`` (media_id, start, pcm array): the last one padded with zeros.

    Samples are dealt to frames by number, so block borders do not matter.
    """
    one = blocks.select("media_id", "start", F.posexplode("pcm").alias("i", "x")).withColumn("_at", F.col("start") + F.col("i"))
    one = one.withColumn("frame", F.floor(F.col("_at") / frame).cast("long"))
    whole = one.groupBy("media_id", "frame").agg(F.array_sort(F.collect_list(F.struct("_at", "x"))).alias("s"))
    x = F.transform("s", lambda s: s["x"])
    return whole.select("media_id", "frame", F.concat(x, F.array_repeat(F.lit(0).cast("float"), frame - F.size(x))).alias("pcm"))
