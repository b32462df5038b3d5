"""Vectors as bytes: what can be compared, and how."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(table: DataFrame, key: str = "vec_id", vector: str = "embedding", kind: str = "<f8") -> DataFrame:
    """``vec_id, mark, x``: x is the vector as bytes of numbers of ``kind``, mark a 128-bit hash of it.

    Both are null for vectors that are null, empty or zero, or have null or non-finite components.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for k, v in zip(pdf["vec_id"], pdf["v"], strict=True):
                x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
                ok = x is not None and len(x) and np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf
                raw = (x + 0.0).astype(kind).tobytes() if ok else None  # -0.0 is 0.0
                rows.append((k, xxhash.xxh3_128_digest(raw) if ok else None, raw))
            yield pd.DataFrame(rows, columns=["vec_id", "mark", "x"])

    # ids go as text: beside nulls pandas would make them floats
    own = table.select(F.col(key).cast("long").cast("string").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    out = own.mapInPandas(run, "vec_id string, mark binary, x binary")
    return out.withColumn("vec_id", F.col("vec_id").cast("long"))


def exact_kind(table: DataFrame, vector: str = "embedding") -> str:
    """The narrowest kind of numbers that holds the vectors of ``table`` exactly."""
    return "<f4" if table.schema[vector].dataType.simpleString() == "array<float>" else "<f8"


def even(table: DataFrame) -> DataFrame:
    """A written table of :func:`packed`, mark and x null where the length is not the one that most vectors have.

    Of two lengths that are as frequent the smaller one counts.
    """
    most = table.where("x is not null").groupBy(F.octet_length("x").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    fits = F.octet_length("x") == (most["n"] if most else 0)
    return table.select("vec_id", F.when(fits, F.col("mark")).alias("mark"), F.when(fits, F.col("x")).alias("x"))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows, in double precision; equal rows give equal numbers wherever they stand."""
    a, b = a.astype(np.float64, copy=False), b.astype(np.float64, copy=False)
    dot = np.einsum("kd,kd->k", a, b)
    return dot / (np.sqrt(np.einsum("kd,kd->k", a, a)) * np.sqrt(np.einsum("kd,kd->k", b, b)))


def matrix(col, kind: str = "<f8") -> np.ndarray:
    """Rows of equal length from bytes."""
    return np.frombuffer(b"".join(col), kind).reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 as float32; a slice at a time is held in double precision."""
    out = np.empty(x.shape, np.float32)
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096].astype(np.float64, copy=False)
        out[a : a + 4096] = part / np.linalg.norm(part, axis=1, keepdims=True)
    return out
