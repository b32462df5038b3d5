"""Speaker turns: labels, windows, and linking of speakers across windows.

``turns``: media_id, ord, start_ms, end_ms, speaker_id.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.operators.regions import select_owned


def normalized(raw: DataFrame) -> DataFrame:
    """Raw labels as ``spk_k`` in order of first appearance (by ord); a new ord by start."""
    first = raw.groupBy("media_id", "speaker_id").agg(F.min("ord").alias("_first"))
    k = F.row_number().over(W.partitionBy("media_id").orderBy("_first")) - 1
    names = first.withColumn("_name", F.concat(F.lit("spk_"), k)).drop("_first")
    out = raw.join(names, ["media_id", "speaker_id"]).withColumn("speaker_id", F.col("_name")).drop("_name")
    return out.withColumn("ord", F.row_number().over(W.partitionBy("media_id").orderBy("start_ms", "ord")) - 1)


def unique_speakers(turns: DataFrame) -> DataFrame:
    """``media_id, speaker_id, place``: speakers in order of first appearance, from 0."""
    first = turns.groupBy("media_id", "speaker_id").agg(F.min("ord").alias("_f"))
    return first.withColumn("place", F.row_number().over(W.partitionBy("media_id").orderBy("_f")) - 1).drop("_f")


def counts(turns: DataFrame) -> DataFrame:
    """``media_id, speakers, tagged``: distinct speakers, and rows that have one."""
    return turns.groupBy("media_id").agg(F.count_distinct("speaker_id").alias("speakers"), F.count("speaker_id").alias("tagged"))


def next_index(turns: DataFrame) -> DataFrame:
    """``media_id, next``: one more than the largest N of ``spk_N``; other names do not count."""
    n = F.try_to_number(F.nullif(F.regexp_extract("speaker_id", r"^spk_(\d{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int")
    return turns.groupBy("media_id").agg((F.coalesce(F.max(n), F.lit(-1)) + 1).alias("next"))


def ranked_by_overlap(spans: DataFrame) -> DataFrame:
    """Speakers of a window by total length, longest first, ties by first ord: media_id, window, speaker_id, total_ms, rank."""
    total = spans.groupBy("media_id", "window", "speaker_id").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("total_ms"), F.min("ord").alias("_f"))
    by = W.partitionBy("media_id", "window").orderBy(F.desc("total_ms"), "_f")
    return total.withColumn("rank", F.row_number().over(by)).drop("_f")


def with_enough_speech(turns: DataFrame, least_ms: int) -> DataFrame:
    """``media_id, speaker_id, total_ms`` of speakers with ``least_ms`` or more."""
    total = turns.groupBy("media_id", "speaker_id").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("total_ms"))
    return total.where(F.col("total_ms") >= least_ms)


def clip_budget(turns: DataFrame, least_ms: int = 3000, budget_ms: int = 30_000) -> DataFrame:
    """For each speaker with ``least_ms`` of speech, spans from the earliest on, cut at ``budget_ms`` in all: adds take_ms."""
    own = W.partitionBy("media_id", "speaker_id").orderBy("start_ms", "end_ms", "ord")
    dur = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    t = turns.withColumns({"_d": dur, "_total": F.sum(dur).over(W.partitionBy("media_id", "speaker_id"))}).where(F.col("_total") >= least_ms)
    before = F.coalesce(F.sum("_d").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("take_ms", F.least(F.col("_d"), F.greatest(F.lit(0), F.lit(budget_ms) - before)))
    return t.where("take_ms > 0").drop("_d", "_total")


def remapped(turns: DataFrame, mapping: DataFrame) -> DataFrame:
    """``turns`` with speakers renamed by ``mapping`` (media_id, [window,] speaker_id, global_id); others keep their name."""
    keys = [c for c in ("media_id", "window", "speaker_id") if c in mapping.columns and c in turns.columns]
    return turns.join(mapping, keys, "left").withColumn("speaker_id", F.coalesce("global_id", "speaker_id")).drop("global_id")


def merged_windows(turns: DataFrame, windows: DataFrame, overlap_ms: int) -> DataFrame:
    """Turns of all windows, each window giving those in its own span; ord by (start, speaker)."""
    own = select_owned(turns, windows, overlap_ms)
    by = W.partitionBy("media_id").orderBy("start_ms", "speaker_id", "window", "ord")
    return own.withColumn("ord", F.row_number().over(by) - 1)


def match_speakers(local: list[tuple[str, np.ndarray | None]], known: list[tuple[str, np.ndarray | None]], others: list[str], following: int, threshold: float) -> tuple[dict[str, str], int]:
    """Greedy matching of a window's speakers to known ones by cosine.

    ``local``: those heard in the overlap, longest first; ``known``: global ones heard there; ``others``:
    all of the window's speakers in order.  Each takes the unused known one with the highest cosine
    above ``threshold`` (ties to the earlier); without one, without a vector, or outside the
    overlap, a speaker gets the next new name.
    """
    out: dict[str, str] = {}
    free = {k: v for k, v in known if v is not None}
    for name, vector in local:
        best = None
        if vector is not None and free:
            names = list(free)
            stack = np.stack([free[k] for k in names]).astype(np.float64)
            v = np.asarray(vector, np.float64)
            size = np.linalg.norm(stack, axis=1) * np.linalg.norm(v)
            score = np.divide(stack @ v, size, out=np.zeros(len(names)), where=size > 0)
            if score.max() > threshold:
                best = names[int(score.argmax())]
        if best is None:
            best, following = f"spk_{following}", following + 1
        else:
            del free[best]
        out[name] = best
    for name in others:
        if name not in out:
            out[name], following = f"spk_{following}", following + 1
    return out, following


def linked(turns: DataFrame, windows: DataFrame, vectors: DataFrame, overlap_ms: int, threshold: float = 0.75) -> DataFrame:
    """Names of speakers over all windows of a media: ``media_id, window, speaker_id, global_id``.

    ``turns`` (with window) are in global time; ``vectors`` has media_id, window, speaker_id, vector (of
    the overlap with the window before), and prior, the vector of the previous window's speaker there,
    under side 'prior'.  A window's names depend on the one before, so a media's windows are folded in
    order in one group; rows are speakers of windows, a few for each ten minutes of media.
    """
    spans = turns.join(windows.select("media_id", "window", F.col("start_ms").alias("_w")), ["media_id", "window"])
    here = F.greatest(F.lit(0), F.least("end_ms", F.col("_w") + overlap_ms) - F.greatest("start_ms", "_w"))
    heard = spans.groupBy("media_id", "window", "speaker_id").agg(F.sum(here).alias("overlap"), F.min("ord").alias("first"), F.min(F.when(here > 0, F.col("ord"))).alias("first_here"))
    # the same speakers, heard in the overlap with the window behind
    behind = windows.select("media_id", (F.col("window") - 1).alias("window"), F.col("start_ms").alias("_n"))
    tail = turns.join(behind, ["media_id", "window"]).withColumn("_t", F.greatest(F.lit(0), F.least("end_ms", F.col("_n") + overlap_ms) - F.greatest("start_ms", "_n")))
    tail = tail.where("_t > 0").groupBy("media_id", "window", "speaker_id").agg(F.min("ord").alias("tail_first"))
    head = vectors.where("side = 'local'").select("media_id", "window", "speaker_id", F.col("vector").alias("local"))
    prior = vectors.where("side = 'prior'").select("media_id", "window", "speaker_id", F.col("vector").alias("prior"))
    rows = heard.join(tail, ["media_id", "window", "speaker_id"], "left").join(head, ["media_id", "window", "speaker_id"], "left").join(prior, ["media_id", "window", "speaker_id"], "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, following, before = [], 0, []
        for window, g in sorted(pdf.groupby("window"), key=lambda x: x[0]):
            g = g.sort_values("first")
            names = list(g["speaker_id"])
            if not before:
                mapping = {name: f"spk_{i}" for i, name in enumerate(names)}
                following = len(mapping)
            else:
                local = g[g["overlap"] > 0].sort_values(["overlap", "first_here"], ascending=[False, True])
                mapping, following = match_speakers(list(zip(local["speaker_id"], local["local"], strict=True)), before, names, following, threshold)
            tails = g[g["tail_first"].notna()].sort_values("tail_first")
            before = [(mapping[s], v) for s, v in zip(tails["speaker_id"], tails["prior"], strict=True)] or [("", None)]
            out += [(pdf["media_id"].iloc[0], window, s, mapping[s]) for s in names]
        return pd.DataFrame(out, columns=["media_id", "window", "speaker_id", "global_id"])

    kind = dict(turns.dtypes)
    return rows.groupBy("media_id").applyInPandas(fold, f"media_id {kind['media_id']}, window {kind['window']}, speaker_id string, global_id string")


