"""Approximate nearest neighbours with balanced posting lists (after SPANN, Chen et al., 2021).

Centroids are fitted on a bounded sample; over-full clusters of the sample are split.  Every vector
goes to the list of its nearest centroid and, if it lies near a boundary, to others too.  Centroids
are searched by a navigable graph in each worker's memory.  A query reads the lists whose centroids
are not much farther than the nearest one.  Lists are cut into blocks of bounded size, so that
no list is a task of its own size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.hnsw import Graph
from chronoweave.llm.storage import written
from chronoweave.llm.vectors import cosines, even, matrix, packed, unit

#: Vectors for a list, lists at most; the broadcast is MOST_LISTS vectors.  Beyond that, lists grow and are read in blocks.
PER_LIST, MOST_LISTS = 150, 8192
#: Centroids are fitted on SAMPLE vectors, or on 8 for each list if that is more; on so many bytes at most.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: A vector goes to up to REPLICAS lists whose distance is up to CLOSURE times the least one.
REPLICAS, CLOSURE = 8, 1.15
#: A query reads lists up to PRUNE times the least distance, LISTS at least, and a tenth of all (or 32) at most.
PRUNE, LISTS, SHARE = 1.15, 12, 10
BLOCK = 4096
_HELD: dict = {}


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """k unit vectors by spherical k-means; clusters over twice the mean size give a small one's centroid a place.

    Very many are fitted in two levels: clusters first, then their share of k in each.
    """
    rng = np.random.default_rng(seed)
    if k > 1024:
        top = centroids(sample, int(np.sqrt(k)), rounds, seed)
        own = np.concatenate([(sample[a : a + 4096] @ top.T).argmax(1) for a in range(0, len(sample), 4096)])
        parts = [sample[own == i] for i in range(len(top))]
        shares = [min(len(p), max(1, round(k * len(p) / len(sample)))) for p in parts]
        return np.concatenate([centroids(p, n, rounds, seed) for p, n in zip(parts, shares, strict=True) if len(p)])
    c = sample[rng.permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(sample), 4096)])
        count = np.bincount(own, minlength=len(c))
        total = np.zeros(c.shape, np.float64)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1)
        ok = (count > 0) & (norm > 1e-9)
        c[ok] = (total[ok] / norm[ok, None]).astype(np.float32)
        large = np.argsort(-count, kind="stable")
        large = large[count[large] > 2 * len(sample) / len(c)]
        small = np.argsort(count, kind="stable")[: len(large)]
        for i, j in zip(small, large, strict=True):
            if count[i] < count[j] / 4:
                c[i] = sample[rng.choice(np.flatnonzero(own == j))]
    return c


def _graph(c: np.ndarray) -> Graph:
    key = hash(c.tobytes())
    if _HELD.get("key") != key:
        _HELD.update(key=key, graph=Graph.build(c))
    return _HELD["graph"]


def _lists(shared, beam: int, ratio: float, least: int, most: int):
    """mapInPandas function: each vector with the lists it belongs to, or reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = _graph(shared.value)
        for pdf in batches:
            if not len(pdf):
                continue
            ids, sims = graph.nearest(unit(matrix(pdf["x"])), min(beam, len(graph.vectors)))
            far = np.sqrt(np.maximum(2 - 2 * sims.astype(np.float64), 0))
            near = (far <= ratio * far[:, :1] + 1e-9) | (np.arange(far.shape[1]) < least)
            near &= (np.arange(far.shape[1]) < most) & (ids >= 0)
            r, c = np.nonzero(near)
            yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[r], "list": ids[r, c].astype(np.int32), "x": pdf["x"].to_numpy()[r]})

    return run


def _ranked(k: int):
    def run(key, lists: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(lists) or not len(asked):
            return none
        lists = lists.drop_duplicates("vec_id")
        x, ids = matrix(lists["x"]), lists["vec_id"].to_numpy(np.int64)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        out = []
        for a in range(0, len(asked), 1024):
            part = asked.iloc[a : a + 1024]
            q, own = matrix(part["x"]), part["vec_id"].to_numpy(np.int64)
            s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ u.T
            s[own[:, None] == ids[None, :]] = -np.inf
            # a product's last bits depend on where a row stands: those near the k-th are measured again
            cut = np.partition(s, -k, axis=1)[:, -k] - 1e-9 if s.shape[1] > k else np.full(len(s), -2.0)
            r, c = np.nonzero((s >= cut[:, None]) & (s > -np.inf))
            f = pd.DataFrame({"query_id": own[r], "vec_id": ids[c], "score": cosines(q[r], x[c])}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            out.append(f.groupby("query_id", sort=False).head(k))
        return pd.concat(out)

    return run


def nearest(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row whose vec_id ``every`` divides.

    Nearness is the cosine in double precision on the original vectors; ties go to the smaller vec_id.
    Fewer candidates than k are all returned.  Vectors that are null, empty or zero, or hold null or
    non-finite components, take no part, nor do those of another length than most have.  Rows that
    repeat a vec_id count once.  Other columns are not looked at; an empty table gives an empty one.
    """
    spark = table.sparkSession
    v = even(written(packed(table), "ann-vectors")).where("mark is not null and vec_id is not null")
    marks = v.groupBy("mark").agg(F.min("vec_id").alias("vec_id"))  # of equal vectors one is in the sample
    size = v.agg(F.count("*").alias("n"), F.max(F.octet_length("x")).alias("bytes")).first()
    wanted = int(np.clip(size["n"] // PER_LIST, 1, MOST_LISTS))
    most = min(max(SAMPLE, 8 * wanted), SAMPLE_BYTES // (size["bytes"] or 1))
    chosen = marks.orderBy(F.xxhash64("mark"), "vec_id").limit(most).select("vec_id")
    some = v.join(F.broadcast(chosen), "vec_id").select("vec_id", "x").collect()  # SAMPLE_BYTES at most, but for repeated ids
    some = {r["vec_id"]: bytes(r["x"]) for r in sorted(some, key=lambda r: (r["vec_id"], bytes(r["x"])))}
    sample = unit(matrix(list(some.values()))) if some else np.zeros((1, 1), np.float32)
    fitted = centroids(sample, min(wanted, len(sample)))
    lists = len(fitted)
    shared = spark.sparkContext.broadcast(fitted)
    held = written(v.select("vec_id", "x").mapInPandas(_lists(shared, 64, CLOSURE, 1, REPLICAS), "vec_id long, list int, x binary"), "ann-lists")
    blocks = F.broadcast(held.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # MOST_LISTS rows at most
    cut = held.join(blocks, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "x")
    asks = v.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select("vec_id", "x")
    asks = asks.mapInPandas(_lists(shared, max(64, lists // SHARE), PRUNE, LISTS, max(32, lists // SHARE)), "vec_id long, list int, x binary")
    asks = asks.join(blocks, "list").select("list", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "vec_id", "x")
    best = cut.groupBy("list", "block").cogroup(asks.groupBy("list", "block")).applyInPandas(_ranked(k), "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
