"""Streaming editions: frames, detector events and sessions over unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 512


def region_stream(blocks: DataFrame, level: float = 0.05, rate: int = 16_000, frame: int = FRAME) -> DataFrame:
    """Speech regions from a stream of ``blocks`` (media_id, start, pcm, eos boolean): media_id, start_ms, end_ms.

    State per media: samples that do not fill a frame yet, samples seen, and the start of an open
    region; never the audio.  Blocks of a media must come in order of start over triggers, and are
    sorted within one; a repeated block (start before what was seen) is skipped.  ``eos`` marks a
    media's last block: the rest is padded with zeros, an open region closed at the end, and the
    state removed.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, done, open_at, carry = state.get if state.exists else (0, 0, -1, b"")
        rest = np.frombuffer(carry, np.float32)
        rows = pd.concat(list(batches)).sort_values("start")
        out, over = [], False
        for r in rows.itertuples():
            x = np.asarray(r.pcm, np.float32) if r.pcm is not None else np.zeros(0, np.float32)
            if r.start >= seen:
                rest = np.concatenate([rest, x])
                seen = int(r.start) + len(x)
            over |= bool(r.eos)
        if over and len(rest) % frame:
            rest = np.pad(rest, (0, -len(rest) % frame))
        n = len(rest) // frame
        loud = np.sqrt((rest[: n * frame].reshape(n, frame) ** 2).mean(1)) >= level if n else np.zeros(0, bool)
        for i, on in enumerate(loud):
            at = (done + i) * frame
            if on and open_at < 0:
                open_at = at
            elif not on and open_at >= 0:
                out.append((key[0], open_at, at))
                open_at = -1
        done, rest = done + n, rest[n * frame :]
        if over:
            if open_at >= 0:
                out.append((key[0], open_at, seen))
            state.remove()
        else:
            state.update((seen, done, open_at, rest.tobytes()))
        ms = 1000 / rate
        yield pd.DataFrame([(k, int(round(a * ms)), int(round(b * ms))) for k, a, b in out], columns=["media_id", "start_ms", "end_ms"])

    return blocks.groupBy("media_id").applyInPandasWithState(run, "media_id string, start_ms long, end_ms long", "seen long, done long, open_at long, rest binary", "append", GroupStateTimeout.NoTimeout)


def hopping_counts(events: DataFrame, window: str = "60 seconds", step: str = "59 seconds", late: str = "10 minutes") -> DataFrame:
    """Rows and largest value per label and overlapping window of event time; ``events``: ts, label, value."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window, step), "label").agg(F.count("*").alias("n"), F.max("value").alias("top")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "label", "n", "top")


def label_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each label: events no more than ``gap`` apart.

    Labels do not part each other here; :func:`frames.merged` is the form where they do.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("s"), "label").agg(F.count("*").alias("n"), F.max("value").alias("top")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "label", "n", "top")


def emitted(stream: DataFrame, batch: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """A query that applies a batch operator to every micro-batch and appends its rows under ``path``, once for each batch."""

    def write(df: DataFrame, number: int) -> None:
        batch(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
