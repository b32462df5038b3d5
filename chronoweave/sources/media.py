"""Media as tables: files in, blocks of PCM samples out.

Decoding is a stage that runs where the files are read; what comes of it is a table of blocks of
fixed length, so that a window of one recording is a filter on its block numbers, and no task ever
needs a whole recording.
"""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE, BLOCK_S = 16_000, 30
BLOCKS = "media_id string, block long, rate int, start long, pcm array<float>"


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono float32 samples of PCM WAV bytes, and their rate.  Other decoders have the same form."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    kinds = {1: np.uint8, 2: np.int16, 4: np.int32}
    if width not in kinds:
        raise ValueError(f"samples of {width} bytes")
    x = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], kinds[width]).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1), rate


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    n = round(len(x) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x).astype(np.float32)


def files(spark: SparkSession, path: str) -> DataFrame:
    """``media_id`` (the path) and ``content`` of media files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("media_id"), "content")


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`files`, a stream over a landing folder: each file once, when it has arrived."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).select(F.col("path").alias("media_id"), "content")


def blocks(media: DataFrame, rates: tuple[int, ...] = (RATE,), decoder: Callable[[bytes], tuple[np.ndarray, int]] = decode_wav, block_s: int = BLOCK_S) -> DataFrame:
    """PCM blocks of each file at each of ``rates``, from one decoding.

    A file that cannot be decoded gives one row with block -1 and no samples, not a failed job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for media_id, content in zip(pdf["media_id"], pdf["content"], strict=True):
                try:
                    x, own = decoder(bytes(content))
                except Exception:  # whatever a decoder raises is about this file
                    yield pd.DataFrame([(media_id, -1, rates[0], 0, None)], columns=["media_id", "block", "rate", "start", "pcm"])
                    continue
                for rate in rates:
                    y, size = resampled(x, own, rate), rate * block_s
                    for b, a in enumerate(range(0, len(y), size)):
                        yield pd.DataFrame([(media_id, b, rate, a, y[a : a + size])], columns=["media_id", "block", "rate", "start", "pcm"])

    return media.select("media_id", "content").mapInPandas(run, BLOCKS)


def durations(pcm: DataFrame) -> DataFrame:
    """``media_id, rate, total, duration_ms`` from the decoded samples themselves."""
    out = pcm.where("block >= 0").groupBy("media_id", "rate").agg(F.max(F.col("start") + F.size("pcm")).alias("total"))
    return out.withColumn("duration_ms", F.rint(F.col("total") / F.col("rate") * 1000).cast("long"))


def undecoded(pcm: DataFrame) -> DataFrame:
    """``media_id`` of files that could not be decoded."""
    return pcm.where("block = -1").select("media_id").distinct()


def window(pcm: DataFrame, start_s: float, duration_s: float, rate: int = RATE, block_s: int = BLOCK_S) -> DataFrame:
    """``media_id, pcm`` of one time window of each media; media without samples there have no row.

    Reads the blocks of the window only.  A negative start or a length below a sample gives nothing.
    """
    first, n = round(start_s * rate), round(duration_s * rate)
    if start_s < 0 or n < 1:
        return pcm.limit(0).select("media_id", "pcm")
    size = rate * block_s
    own = pcm.where((F.col("rate") == rate) & F.col("block").between(first // size, (first + n - 1) // size))
    return _cut(own.withColumns({"_from": F.lit(first), "_to": F.lit(first + n)}), ["media_id"])


def windows(pcm: DataFrame, spans: DataFrame, rate: int = RATE, block_s: int = BLOCK_S) -> DataFrame:
    """``spans`` (media_id, window, start_ms, end_ms) with the samples of each, by an equi-join on blocks."""
    first, past = F.rint(F.col("start_ms") * rate / 1000).cast("long"), F.rint(F.col("end_ms") * rate / 1000).cast("long")
    size = rate * block_s
    w = spans.select("media_id", "window", first.alias("_from"), past.alias("_to")).where("_to > _from")
    w = w.withColumn("block", F.explode(F.sequence(F.floor(F.col("_from") / size).cast("long"), F.floor((F.col("_to") - 1) / size).cast("long"))))
    return _cut(pcm.where(F.col("rate") == rate).join(w, ["media_id", "block"]), ["media_id", "window"])


def _cut(parts: DataFrame, keys: list[str]) -> DataFrame:
    begin = F.greatest(F.lit(0), F.col("_from") - F.col("start"))
    n = F.least(F.col("start") + F.size("pcm"), F.col("_to")) - F.greatest("start", "_from")
    piece = parts.withColumn("_p", F.slice("pcm", (begin + 1).cast("int"), F.greatest(F.lit(0), n).cast("int"))).where(F.size("_p") > 0)
    whole = piece.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", F.col("_p").alias("p")))).alias("_all"))
    return whole.select(*keys, F.flatten(F.transform("_all", lambda x: x["p"])).alias("pcm"))


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM WAV of float samples, for models that take files."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


class Workspace:
    """Decoded blocks, written once and read by every stage after; gone when closed.

    ``folder`` is a place that all executors share.
    """

    def __init__(self, spark: SparkSession, pcm: DataFrame, folder: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/pcm-{uuid.uuid4().hex}"
        pcm.write.partitionBy("rate").parquet(self.path)
        self.pcm = spark.read.schema(BLOCKS).parquet(self.path)
        self.media = durations(self.pcm)

    def read(self, start_s: float, end_s: float, rate: int = RATE) -> DataFrame:
        """Samples of one window; a rate that was not prepared raises."""
        if not self.pcm.where(F.col("rate") == rate).take(1):
            raise RuntimeError(f"no samples at a rate of {rate} were prepared")
        return window(self.pcm, start_s, end_s - start_s, rate)

    def close(self) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def write_responses(bodies: DataFrame, path: str, response_format: str = "verbose_json") -> None:
    """One line per media: ``text`` writes the plain text, anything else the JSON body."""
    body: Column = F.get_json_object("body", "$.text") if response_format == "text" else F.col("body")
    bodies.select(body.alias("value")).write.text(path)
