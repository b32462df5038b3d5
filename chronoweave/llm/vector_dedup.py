"""Near-duplicate vectors by navigable small-world graphs, one for each shard.

Equal vectors form a class, of which one is compared.  Classes are dealt to shards; each shard's
graph is built once and written, in pieces of bounded size.  Every class queries every shard.  A beam that comes back half full
of links is replaced by an exact scan of the shard for that query; a sample of the other queries is
audited against such a scan, and the beam is widened until the audit finds nothing missing, first by
the shard's own vectors when its graph is built, then in every batch of queries.  Found
pairs are verified in double precision.  A task gives each query's number of links and the edges of
a spanning forest of its links, never the links of a group as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.components import components
from chronoweave.llm.hnsw import STEP, Graph
from chronoweave.llm.storage import drop, written
from chronoweave.llm.vectors import cosines, even, exact_kind, matrix, packed, unit

LEAST = 0.95
#: At least so many shards, and at most so many classes, of so many bytes, in one: its graph must fit a worker.
SHARDS, SHARD_ROWS, SHARD_BYTES = 6, 100_000, 64 << 20
#: A row of a written graph has about so many bytes of vectors; batches that go to Python have about so many in all.
PIECE, BATCH = 1 << 19, 8 << 20
#: Queries of a shard are dealt over tasks in parts of about this many, but in no more parts than there are shards,
#: since each part reads the graph.
PART = 20_000
BEAM, WIDEST, AUDITED = 48, 768, 48
#: Vectors of a shard that audit its graph when it is built.
TRIED = 512
#: Exact scans take so many queries at a time: no more than SLICE * SHARD_ROWS products are held.
SLICE = 64
#: Bytes of vectors whose pairs are verified at a time, and pairs that go into a forest at a time.
PAIR_BYTES, FOREST = 32 << 20, 1 << 20


def _wider(beam: int) -> int:
    return min(WIDEST, beam * 3 // 2)


def _built(kind: str):
    """mapInPandas function: rows of a shard come together, in the order of a hash, so levels are random."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, rows = None, []
        for pdf in batches:
            for s, group in pdf.groupby("shard", sort=False):
                if s != shard and rows:
                    yield from _pieces(shard, rows)
                    rows = []
                shard = s
                rows.append((group["rep"].to_numpy(np.int64), group["size"].to_numpy(np.int64), matrix(group["x"], kind)))
        if rows:
            yield from _pieces(shard, rows)

    return run


def _pieces(shard: int, rows: list) -> Iterator[pd.DataFrame]:
    """A shard's graph, in rows of about PIECE bytes of vectors."""
    ids, sizes, x = (np.concatenate([r[k] for r in rows]) for k in range(3))
    rows.clear()
    u = unit(x)
    graph = Graph.build(u)
    tried = u[-TRIED:]
    there = np.concatenate([(tried[a : a + SLICE] @ u.T >= LEAST - 1e-5).sum(1) for a in range(0, len(tried), SLICE)])
    beam = BEAM
    while beam < WIDEST:
        count = np.bincount(graph.within(tried, beam, LEAST - 1e-5)[0], minlength=len(tried))
        if not ((count < there) & (count < beam // 2)).any():
            break
        beam = _wider(beam)
    step = max(1, PIECE // (x.itemsize * x.shape[1]))
    for a in range(0, len(x), step):
        own = slice(a, a + step)
        yield pd.DataFrame(
            {"shard": [shard], "beam": [beam], "total": [len(x)], "at": [a], "ids": [ids[own].tobytes()], "sizes": [sizes[own].tobytes()], "xs": [x[own].tobytes()], "layers": [[l[own].tobytes() for l in graph.layers]]}
        )


class _Shard:
    def __init__(self, pieces: list, kind: str):
        self.beam = int(pieces[0].beam)
        self.ids, self.sizes = (np.frombuffer(b"".join(getattr(p, name) for p in pieces), np.int64) for name in ("ids", "sizes"))
        if len(self.ids) != int(pieces[0].total):
            raise RuntimeError("a shard's queries came without its whole graph")
        self.x = np.frombuffer(b"".join(p.xs for p in pieces), kind).reshape(len(self.ids), -1)
        layers = [np.frombuffer(b"".join(parts), np.int32).reshape(-1, 32) for parts in zip(*[p.layers for p in pieces], strict=True)]
        self.graph = Graph(unit(self.x), layers)

    def _counts(self, q: np.ndarray) -> np.ndarray:
        """How many nodes each query links with, by single precision."""
        return np.concatenate([(q[a : a + SLICE] @ self.graph.vectors.T >= LEAST - 1e-5).sum(1) for a in range(0, len(q), SLICE)] or [np.zeros(0, np.int64)])

    def _sure(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Which pairs have a cosine of LEAST or more; ``near`` are those that single precision cannot tell."""
        ok = np.ones(len(rows), bool)
        doubt = np.flatnonzero(near)
        step = max(1, PAIR_BYTES // (8 * x.shape[1]))
        for a in range(0, len(doubt), step):
            at = doubt[a : a + step]
            ok[at] = cosines(x[rows[at]], self.x[nodes[at]]) >= LEAST
        return ok & (ids[rows] != self.ids[nodes])

    def _found(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many nodes the beam of each query finds, and the pairs (query, node) of those whose beams are not half full."""
        count, rows, nodes = np.zeros(len(q), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(q), STEP):
            r, n = self.graph.within(q[a : a + STEP], self.beam, LEAST - 1e-5)
            own = np.bincount(r, minlength=len(q[a : a + STEP]))
            count[a : a + STEP] = own
            few = own[r] < self.beam // 2
            rows.append(r[few] + a)
            nodes.append(n[few])
        return count, np.concatenate(rows), np.concatenate(nodes)

    def links(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's number of linked vectors, and the edges of a spanning forest of the links.

        A query's own node is left out.  Links of one slice of queries are held at a time.
        """
        q = unit(x)
        while True:
            count, rows, nodes = self._found(q)
            full = count >= self.beam // 2
            some = np.flatnonzero(~full)
            some = some[np.argsort(ids[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
            some = np.concatenate([some[count[some] > 0][: AUDITED // 2], some[count[some] == 0][: AUDITED // 2]])
            missed = (self._counts(q[some]) > count[some]).any() if len(some) else False
            if not missed:
                break
            if self.beam >= WIDEST:
                full[:] = True
                break
            self.beam = _wider(self.beam)
        keep = ~full[rows]
        rows, nodes = rows[keep], nodes[keep]
        ok = self._sure(ids, x, rows, nodes, np.ones(len(rows), bool))
        rows, nodes = rows[ok], nodes[ok]
        total = np.bincount(rows, weights=self.sizes[nodes].astype(np.float64), minlength=len(ids)).astype(np.int64)
        a = b = np.zeros(0, np.int64)
        for at in range(0, len(rows), FOREST):
            a, b = _forest(np.concatenate([a, ids[rows[at : at + FOREST]]]), np.concatenate([b, self.ids[nodes[at : at + FOREST]]]))
        exact = np.flatnonzero(full)
        for at in range(0, len(exact), SLICE):
            own = exact[at : at + SLICE]
            s = q[own] @ self.graph.vectors.T
            r, n = np.nonzero(s >= LEAST - 1e-5)
            ok = self._sure(ids, x, own[r], n, s[r, n] < LEAST + 1e-5)
            r, n = r[ok], n[ok]
            total[own] += np.bincount(r, weights=self.sizes[n].astype(np.float64), minlength=len(own)).astype(np.int64)
            # a node joins the first query that it links with, and each query the first ones of its nodes
            first = np.full(len(self.ids), len(own))
            np.minimum.at(first, n, r)
            linked = np.flatnonzero(first < len(own))
            pairs = np.unique(r * len(own) + first[n])
            a, b = _forest(np.concatenate([a, self.ids[linked], ids[own[pairs // len(own)]]]), np.concatenate([b, ids[own[first[linked]]], ids[own[pairs % len(own)]]]))
        return total, a, b


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) for the graph of edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _queried(kind: str):
    """mapInPandas function: rows come by (shard, part), the pieces of the shard's graph before its queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, at, pieces = None, None, []
        for pdf in batches:
            for (s, p), group in pdf.groupby(["shard", "part"], sort=False):
                if at != (s, p):
                    shard, at, pieces = None, (s, p), []
                pieces.extend(group[group["xs"].notna()].itertuples())
                group = group[group["x"].notna()]
                if not len(group):
                    continue
                if shard is None:
                    if not pieces:
                        raise RuntimeError("a shard's queries came without its graph")
                    shard, pieces = _Shard(pieces, kind), []
                ids = group["rep"].to_numpy(np.int64)
                count, a, b = shard.links(ids, matrix(group["x"], kind))
                some = count > 0
                yield pd.DataFrame({"rep": np.concatenate([ids[some], a]), "n": np.concatenate([count[some], np.zeros(len(a), np.int64)]), "to": np.concatenate([ids[some], b])})

    return run


def near_vectors(table: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``table`` (vec_id, embedding).

    Linked are vectors with a cosine of LEAST or more.  Vectors that are null, empty or zero, or hold
    null or non-finite components, link with nothing: 0 links, their own component, kept.  n_links
    counts rows, repeated ones too.  Vectors of another length than most have link with nothing as well.
    Other columns are not looked at; an empty table gives an empty one.
    """
    kind = exact_kind(table)
    v = even(written(packed(table, kind=kind), "vectors"))
    good = v.where("mark is not null and vec_id is not null")
    classes = written(good.groupBy("mark").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("x").alias("x")), "vector-classes")
    n, width = classes.agg(F.count("*"), F.max(F.octet_length("x"))).first()
    most = max(1, min(SHARD_ROWS, SHARD_BYTES // (width or 1)))
    shards = max(SHARDS, -(-n // most))
    parts = max(1, min(-(-n // PART), shards))
    batches = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH)}
    dealt = classes.select("rep", "size", "x", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("rep", F.lit(3)).alias("h"))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h")
    graphs = written(dealt.mapInPandas(_built(kind), "shard int, beam int, total int, at int, ids binary, sizes binary, xs binary, layers array<binary>"), "vector-graphs", conf=batches)
    first = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(0))
    asked = classes.select("rep", "x", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(parts)).cast("int").alias("part"))
    # with few classes some shards have none
    asked = asked.join(F.broadcast(graphs.select("shard").distinct()), "shard").withColumn("kind", F.lit(1))
    # a task for each (shard, part)
    both = first.unionByName(asked, allowMissingColumns=True)
    both = both.repartitionById(shards * parts, F.col("shard") * parts + F.col("part")).sortWithinPartitions("shard", "part", "kind", "at")
    found = written(both.mapInPandas(_queried(kind), "rep long, n long, to long"), "vector-links", conf=batches)
    near = components(found.where("rep <> to"), "rep", "to").withColumnRenamed("node", "rep")
    total = found.groupBy("rep").agg(F.sum("n").alias("n"))
    done = classes.join(total, "rep", "left").join(near, "rep", "left")
    done = done.select("mark", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = v.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("mark")).alias("mark")).join(done, "mark", "left")
    drop(graphs)
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
