"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features say whether a hashed n-gram (by UTF-8 bytes, ASCII letters lowered) occurs in the text.
Each is scaled by r = log of its smoothed share among toxic training texts over its share among
the others; a logistic model is fitted on the scaled features.  What is shipped to the workers is
one weight per hash cell, of fixed number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import labelled

BITS, ORDERS = 20, (4, 5, 6)
#: Bytes whose n-grams are held at once when a text is scored.
PIECE = 4_000_000
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def grams(text: bytes) -> np.ndarray:
    """Hash cells of all n-grams of ORDERS, repeats included; the text is framed by spaces."""
    return _cells(b" " + text + b" ")


def _cells(framed: bytes) -> np.ndarray:
    b = _LOWER[np.frombuffer(framed, np.uint8)]
    out = []
    h = np.zeros(len(b), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint64(0x100000001B3) + b[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def train(rows: list[tuple[bytes, int]], epochs: int = 12, seed: int = 5, keep: float = 1e-3) -> dict:
    """Weights by hash cell and a bias; deterministic.

    Without rows of both labels the model is the constant share of label 1 (0.5 without rows).
    """
    ys = np.array([y for _, y in rows], np.float64)
    if len(set(ys)) < 2:
        return {"constant": float(ys.mean()) if len(ys) else 0.5}
    xs = [np.unique(grams(t)) for t, _ in rows]
    size = 1 << BITS
    count = [np.full(size, 0.5), np.full(size, 0.5)]
    seen = np.zeros(size, np.int32)
    for x, y in zip(xs, ys, strict=True):
        count[int(y)][x] += 1
        seen[x] += 1
    ratio = (np.log(count[1] / (ys == 1).sum()) - np.log(count[0] / (ys == 0).sum())).astype(np.float32)
    expected = seen * ys.mean()
    told = np.abs(count[1] - 0.5 - expected) >= 5 * np.sqrt(expected * (1 - ys.mean()) + 0.05)
    ratio[~told | (seen < 4)] = 0  # within chance, or too rare to tell
    xs = [x[ratio[x] != 0] for x in xs]
    w, g2 = np.zeros(size, np.float32), np.full(size, 1e-6, np.float32)
    b, rng = float(np.log(ys.mean() / (1 - ys.mean()))), np.random.default_rng(seed)
    for epoch in range(epochs):
        for i in rng.permutation(len(xs)):
            x = xs[i]
            r = ratio[x] * 0.1
            d = 1 / (1 + np.exp(-np.clip(float(w[x] @ r) + b, -30, 30))) - ys[i]
            g = d * r + 1e-5 * w[x]
            g2[x] += g * g
            w[x] -= 0.2 * g / np.sqrt(g2[x])
            b -= 0.02 * d
    v = w * ratio * 0.1
    v[np.abs(v) < keep] = 0
    cells = np.flatnonzero(v)
    return {"cells": cells.astype(np.int32), "weights": v[cells], "bias": b}


def _dense(model: dict) -> np.ndarray:
    v = np.zeros(1 << BITS, np.float32)
    v[model["cells"]] = model["weights"]
    return v


def score(model: dict, dense: np.ndarray, text: bytes) -> float:
    """Probability of label 1 for a whole text, an empty one included."""
    total = model["bias"]
    hit = []
    framed = b" " + text + b" "
    for a in range(0, len(framed), PIECE):  # bounded memory for very long texts; no n-gram is lost or made at a seam
        h = _cells(framed[a : a + PIECE + max(ORDERS) - 1])
        hit.append(np.unique(h[dense[h] != 0]))
    cells = hit[0] if len(hit) == 1 else np.unique(np.concatenate(hit))
    return float(1 / (1 + np.exp(-np.clip(float(dense[cells].sum(dtype=np.float64)) + total, -500, 500))))


def scores(docs: DataFrame, model: dict, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a column ``to``; null texts are scored as empty ones.

    Other columns are kept as they are; a column already called ``to`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        if "constant" in own:
            for col in batches:
                yield pd.Series(np.full(len(col), own["constant"]))
            return
        dense = _dense(own)
        for col in batches:
            yield pd.Series([score(own, dense, (x or "").encode("utf-8", "replace")) for x in col], dtype="float64")

    return docs.withColumn(to, run(F.col(text).cast("string")))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 4, out: int = 2, rows: int = 8000, most_bytes: int = 16_384) -> dict:
    """A model from a sample of at most ``rows`` labelled texts of at most ``most_bytes`` each.

    Rows whose crc32(doc_id) leaves ``out`` on division by ``fold`` are never learned from.
    """
    few, odds = labelled.sample(docs, labels, label, fold, out, rows, most_bytes)
    model = labelled.learned(few, train)
    return model if "constant" in model else model | {"bias": model["bias"] + odds}


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    An empty table gives no rows, without labels all scores are 0.5; repeated rows are scored each.
    held_out is null where doc_id is.
    """
    model = fit(docs, labels)
    return scores(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
