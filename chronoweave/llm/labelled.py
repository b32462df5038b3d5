"""A bounded sample of labelled texts for the classifiers, and a task that learns from it."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.workers import give_back


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, out: int, rows: int, most_bytes: int) -> tuple[DataFrame, float]:
    """At most ``rows`` texts as UTF-8 with their labels (``_h, _t, _y``), and a correction of the label's odds.

    Half are of each label where there are as many.  Rows with ``crc32(doc_id) % fold == out`` are held
    out, ids with clashing labels are left out, and texts over ``most_bytes`` are not learned from; a
    null text is an empty one.  Of texts that share a doc_id the least in order counts.  The choice is
    by a hash of doc_id, so it does not depend on partitions.  The correction is what the logarithm of
    the odds of label 1 among all labels that may be learned from has over that in the sample: a
    larger table, of which a smaller share is sampled, is scored as a smaller one.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (F.crc32(F.col("_id").cast("string")) % fold != out))
        .groupBy("_id")
        .agg(F.min("_y").alias("_y"), F.max("_y").alias("_most"))
        .where(F.col("_y") == F.col("_most"))
        .select("_id", "_y", F.xxhash64("_id", F.lit(17)).alias("_h"))
    )
    count = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    half = [known.where(F.col("_y") == y).orderBy("_h", "_id").limit(rows // 2) for y in (0, 1)]
    few = F.broadcast(half[0].unionByName(half[1]))  # at most `rows` rows
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    got = docs.select(F.col("doc_id").alias("_id"), text.alias("_t")).where(F.octet_length("_t") <= most_bytes).join(few, "_id").groupBy("_h", "_id", "_y").agg(F.min("_t").alias("_t"))
    odds = 0.0
    if len(count) == 2:
        odds = math.log(count[1] / count[0]) - math.log(min(count[1], rows // 2) / min(count[0], rows // 2))
    return got.select("_h", "_t", "_y"), odds


def learned(rows: DataFrame, train: Callable[[list[tuple[bytes, int]]], dict]) -> dict:
    """``train`` of the rows of :func:`sample`, in one task: only the model comes to the driver.

    The task holds the sample, whose rows and bytes are bounded.  Without rows the model is that of none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted((int(h), bytes(t), int(y)) for pdf in batches for h, t, y in zip(pdf["_h"], pdf["_t"], pdf["_y"], strict=True))
        model = pickle.dumps(train([(t, y) for _, t, y in got]))
        got.clear()
        give_back()
        yield pd.DataFrame({"model": [model]})

    model = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(bytes(model[0]["model"])) if model else train([])
