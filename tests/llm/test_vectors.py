"""Vectors at sizes where lists, graphs and exact scans matter, and odd ones."""

import tracemalloc

import numpy as np
import pandas as pd

from chronoweave.llm import ann, vector_dedup


def frame(spark, v, ids=None):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"vec_id": ids if ids is not None else np.arange(len(v)), "embedding": [x.tolist() for x in v]}), "vec_id long, embedding array<double>")


def test_recall_with_many_lists(spark):
    """20,000 vectors, a third of them equal: more lists than a query reads, and ties."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(20_000, 24))
    v[2::3] = v[2]
    got = {}
    for r in ann.nearest(frame(spark, v), 200).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert len(got) == 100 and 20_000 // ann.PER_LIST > 2 * max(32, 20_000 // ann.PER_LIST // ann.SHARE)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        s[2::3] = u[2] @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(len(v)), -s))[:5]
        if q % 3 == 2:
            want = [i for i in range(2, 21, 3) if i != q][:5]  # its equals, smallest first
            assert [found[k][0] for k in range(1, 6)] == want
        hits += len({i for i, _ in found.values()} & set(map(int, want)))
        assert all(abs(s[i] - x) < 1e-12 for i, x in found.values())
    assert hits / 500 >= 0.9


def test_two_level_centroids():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = ann.centroids(x, 1500)
    assert 1300 <= len(c) <= 1700 and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)


def test_lengths_differ(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [1.0]), (50, [0.9, 0.1])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(v).orderBy("query_id", "rank").collect()] == [(0, 1), (0, 50), (50, 1), (50, 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(v).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 50: (2, 0), 2: (0, 2), 3: (0, 3)}


def test_hot_group_in_slices(spark, monkeypatch):
    """A group larger than any beam: exact scans, slice by slice, give every link and one component."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(4000, 16))
    v[1000:2500] = v[1000] + rng.normal(size=(1500, 16)) * 0.12
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.95
    comp = np.arange(len(v))
    while True:
        new = np.array([comp[near[i]].min() for i in range(len(v))])
        if (new == comp).all():
            break
        comp = new
    monkeypatch.setattr(vector_dedup, "PART", 900)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(frame(spark, v)).collect()}
    wrong = [i for i in range(len(v)) if got[i] != (int(near[i].sum()) - 1, int(comp[i]))]
    assert near.sum() > 200_000 and not wrong


def test_graphs_in_bounded_pieces():
    """A shard's graph is never one row, and the hits of a group larger than any beam are never held at once."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 16)).astype("<f4")
    x[:12_000] = x[0] + rng.normal(size=(12_000, 16)) * 0.02
    x = rng.permutation(x)
    ids = np.arange(len(x))
    batches = [pd.DataFrame({"shard": 0, "rep": ids[a : a + 7000], "size": 1, "x": [v.tobytes() for v in x[a : a + 7000]]}) for a in range(0, len(x), 7000)]
    rows = pd.concat(list(vector_dedup._built("<f4")(iter(batches))))
    assert len(rows) > 2 and max(len(r.xs) for r in rows.itertuples()) <= vector_dedup.PIECE and rows["total"].eq(len(x)).all()
    shard = vector_dedup._Shard(list(rows.itertuples()), "<f4")
    assert (shard.x == x).all() and (shard.ids == ids).all()
    shard.beam = 192
    hot = np.flatnonzero(vector_dedup.cosines(x, np.repeat(x[np.argmax(shard._counts(shard.graph.vectors[:50]))][None], len(x), 0)) >= 0.95)[:4096]
    tracemalloc.start()
    count, rows, _ = shard._found(shard.graph.vectors[hot])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (count >= 96).all() and not len(rows) and peak < 32 << 20


def test_graph_of_many_pieces(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(600, 8))
    v[300:] = v[:300] + rng.normal(size=(300, 8)) * 0.08
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(vector_dedup, "PIECE", 1000)
    monkeypatch.setattr(vector_dedup, "SHARD_BYTES", 5000)  # 64 bytes a vector: 8 shards
    monkeypatch.setattr(vector_dedup, "PART", 100)
    got = {r.vec_id: r.n_links for r in vector_dedup.near_vectors(frame(spark, v)).collect()}
    assert [got[i] for i in range(600)] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()
