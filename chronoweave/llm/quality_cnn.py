"""Document quality by a byte-level convolutional network, trained and applied with numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  In a chunk every byte
is embedded, learned filters slide over the bytes, and each filter keeps its largest answer.  A
text is described by the mean and the largest of its chunks' pooled answers, from which a small
output layer gives one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import labelled
from chronoweave.llm.workers import give_back

CHUNK, STEP, EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 512, 448, 6, 8, 2, 32, 16
#: Byte 256 pads the end of a text; its embedding is learned as well, so that short texts show.
PAD = 256


def chunks(text: bytes) -> np.ndarray:
    """Overlapping windows of CHUNK bytes, STEP apart, over the whole text; at least one."""
    n = len(text)
    count = 1 if n <= CHUNK else 1 + -(-(n - CHUNK) // STEP)
    padded = np.full((count - 1) * STEP + CHUNK, PAD, np.int16)
    padded[:n] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def _columns(bytes_: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """[chunks, positions, WIDTH * EMBED] float32."""
    e = embed[bytes_].reshape(len(bytes_), CHUNK * EMBED)
    return np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]


def pooled(model: dict, bytes_: np.ndarray) -> np.ndarray:
    """[chunks, FILTERS]: each filter's largest answer, not below 0."""
    out = np.empty((len(bytes_), FILTERS), np.float32)
    for a in range(0, len(bytes_), 64):
        part = bytes_[a : a + 64]
        x = np.ascontiguousarray(_columns(part, model["embed"])).reshape(-1, WIDTH * EMBED)
        out[a : a + 64] = (x @ model["filters"]).reshape(len(part), -1, FILTERS).max(1)
    return np.maximum(out + model["bias"], 0)


def _features(p: np.ndarray) -> np.ndarray:
    return np.concatenate([p.mean(0), p.max(0)])


def _head(model: dict, f: np.ndarray) -> np.ndarray:
    """Probabilities of label 1 from texts' features, one row each."""
    u = np.tanh(f @ model["hidden"] + model["hidden_bias"])
    return 1 / (1 + np.exp(-np.clip((u @ model["out"] + model["out_bias"][0]).astype(np.float64), -500, 500)))


def train(rows: list[tuple[bytes, int]], seen: int = 24_000, seed: int = 3, rate: float = 0.01) -> dict:
    """Fit embedding, filters and output layer by Adam on whole texts; deterministic.

    Without rows of both labels the model is the constant share of label 1 (0.5 without rows).
    """
    rng = np.random.default_rng(seed)
    ys = np.array([y for _, y in rows], np.float64)
    if len(set(ys)) < 2:
        return {"constant": float(ys.mean()) if len(ys) else 0.5}
    m = {
        "embed": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
        "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "hidden": rng.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS, HIDDEN)).astype(np.float32),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in m.items()}
    step = 0
    epochs = int(np.clip(seen // len(rows), 4, 200))  # so many texts are looked at, whatever their number
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 32):
            batch = order[a : a + 32]
            grad = {k: np.zeros_like(v) for k, v in m.items()}
            for i in batch:
                b = chunks(rows[i][0])
                x = np.ascontiguousarray(_columns(b, m["embed"]))
                z = x @ m["filters"]
                at = z.argmax(1)
                p = np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + m["bias"], 0)
                f = _features(p)
                u = np.tanh(f @ m["hidden"] + m["hidden_bias"])
                d = np.float32((_head(m, f[None])[0] - ys[i]) / len(batch))
                du = d * m["out"] * (1 - u * u)
                grad["out"] += d * u
                grad["out_bias"] += d
                grad["hidden"] += np.outer(f, du)
                grad["hidden_bias"] += du
                df = m["hidden"] @ du
                dp = np.repeat(df[None, :FILTERS] / len(p), len(p), 0)
                dp[p.argmax(0), np.arange(FILTERS)] += df[FILTERS:]
                dp *= p > 0
                grad["bias"] += dp.sum(0)
                chunk = np.arange(len(b))[:, None]
                seen = x[chunk, at]  # [chunks, FILTERS, WIDTH * EMBED]
                grad["filters"] += np.einsum("cf,cfe->ef", dp, seen)
                de = (dp[:, :, None] * m["filters"].T[None]).reshape(-1, WIDTH, EMBED)
                which = b[chunk[:, :, None], (at * STRIDE)[:, :, None] + np.arange(WIDTH)].reshape(-1, WIDTH)
                np.add.at(grad["embed"], which.ravel(), de.reshape(-1, EMBED))
            step += 1
            # a slow start and bounded steps: else filters may die at once, and the model stays a constant
            now = rate * (0.03 ** (epoch / epochs)) * min(1.0, step / 100)
            large = max(1.0, float(np.sqrt(sum(float((g * g).sum()) for g in grad.values()))))
            for k, g in grad.items():
                g = g / large
                a1, a2 = moments[k]
                a1 += 0.1 * (g - a1)
                a2 += 0.001 * (g * g - a2)
                m[k] -= now * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.999**step)) + 1e-8)
    return m


def score(model: dict, text: bytes) -> float:
    """Probability of label 1 for a whole text, an empty one included."""
    if "constant" in model:
        return model["constant"]
    b = chunks(text)
    total, top = np.zeros(FILTERS), np.zeros(FILTERS, np.float32)
    for a in range(0, len(b), 1024):  # bounded memory for very long texts
        p = pooled(model, b[a : a + 1024])
        total += p.sum(0)
        top = np.maximum(top, p.max(0))
    f = np.concatenate([total / len(b), top])
    return float(_head(model, f[None])[0])


def scores(docs: DataFrame, model: dict, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a column ``to``; null texts are scored as empty ones.

    Other columns are kept as they are; a column already called ``to`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 30 KB, whatever the input

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for col in batches:
            out = np.empty(len(col))
            for a in range(0, len(col), 500):  # encoded copies of a few texts at a time
                out[a : a + 500] = _scores(own, [(x or "").encode("utf-8", "replace") for x in col[a : a + 500]])
            yield pd.Series(out)
        give_back()

    return docs.withColumn(to, run(F.col(text).cast("string")))


def _scores(model: dict, texts: list[bytes]) -> np.ndarray:
    """Scores of many texts: the chunks of short ones go through the filters together."""
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    out = np.empty(len(texts))
    at = 0
    while at < len(texts):
        group, n = [], 0
        while at + len(group) < len(texts) and n < 512:
            t = texts[at + len(group)]
            if len(t) > 1_000_000:
                break
            group.append(chunks(t))
            n += len(group[-1])
        if not group:
            out[at] = score(model, texts[at])
            at += 1
            continue
        p = pooled(model, np.concatenate(group))
        lens = np.array([len(x) for x in group])
        starts = np.cumsum(lens) - lens
        f = np.concatenate([np.add.reduceat(p.astype(np.float64), starts) / lens[:, None], np.maximum.reduceat(p, starts)], 1)
        out[at : at + len(group)] = _head(model, f)
        at += len(group)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 5, out: int = 0, rows: int = 4000, most_bytes: int = 16_384) -> dict:
    """A model from a sample of at most ``rows`` labelled texts of at most ``most_bytes`` each.

    Rows whose crc32(doc_id) leaves ``out`` on division by ``fold`` are never learned from.
    """
    few, odds = labelled.sample(docs, labels, label, fold, out, rows, most_bytes)
    model = labelled.learned(few, train)
    return model if "constant" in model else model | {"out_bias": model["out_bias"] + np.float32(odds)}


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    An empty table gives no rows, without labels all scores are 0.5; repeated rows are scored each.
    held_out is null where doc_id is.
    """
    model = fit(docs, labels)
    return scores(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, with their own columns."""
    name = next(f"_score{i}" for i in range(len(docs.columns) + 1) if f"_score{i}" not in docs.columns)
    return scores(docs, fit(docs, labels), to=name).where(F.col(name) >= threshold).drop(name)
