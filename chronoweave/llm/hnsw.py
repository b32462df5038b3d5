"""Hierarchical navigable small-world graphs (Malkov and Yashunin, 2018) in numpy, many queries at a time.

Vectors are unit rows (float32); nearness is their dot product.  Node numbers go by level: the
first ones are those of the upper layers, so layer l consists of nodes 0..n_l - 1.
"""

from __future__ import annotations

import numpy as np

LINKS, BUILD_BEAM, STEP, FANOUT = 16, 32, 256, 16
#: Bytes of vectors of hubs' candidates that are held at a time.
HUBS = 32 << 20


class Graph:
    """Adjacency by layer (layer 0 has all nodes), -1 where a node has fewer neighbours."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """A graph of ``vectors`` (in random order: the first ones become the upper layers)."""
        sizes = [len(vectors)]
        while sizes[-1] > STEP:
            sizes.append(max(sizes[-1] // FANOUT, 1))
        graph = cls(vectors, [])
        for size in reversed(sizes):
            graph.layers.insert(0, graph._layer(size))
        return graph

    def _layer(self, size: int) -> np.ndarray:
        """Insert nodes in batches: beam search above and in the layer, neighbours by heuristic, links back."""
        most = 2 * LINKS
        adj = np.full((size, most), -1, np.int32)
        upper = list(self.layers)
        done = 0
        while done < size:
            new = np.arange(done, min(size, done + max(STEP // 2, min(done // 2, 4 * STEP))))
            v = self.vectors[new]
            ids = np.zeros((len(new), 0), np.int64)
            sims = np.zeros((len(new), 0), np.float32)
            if done:
                if done <= 4 * STEP:
                    s = v @ self.vectors[:done].T
                    k = min(BUILD_BEAM, done)
                    ids = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < done else np.tile(np.arange(done), (len(new), 1))
                    sims = np.take_along_axis(s, ids, 1)
                else:
                    parts = [self._found(v[a : a + STEP], [adj[:done], *upper], BUILD_BEAM) for a in range(0, len(v), STEP)]
                    ids, sims = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            # nodes of the same batch are candidates too, the nearest of those before
            s = v @ v.T
            s[np.triu_indices(len(new))] = -2
            k = min(BUILD_BEAM // 2, len(new))
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            got = np.take_along_axis(s, near, 1)
            ids, sims = np.concatenate([ids, np.where(got > -2, near + done, -1)], 1), np.concatenate([sims, got], 1)
            chosen = self._diverse(ids, sims, LINKS)
            adj[new, : chosen.shape[1]] = chosen
            self._link_back(adj, new, chosen)
            done = int(new[-1]) + 1
        return adj

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates up to ``most``: nearest first, those nearer to a chosen one than to the row last."""
        order = np.argsort(-np.where(ids >= 0, sims, -3), axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = np.full((len(ids), most), -1, np.int32)
        for a in range(0, len(ids), 256):
            i, s = ids[a : a + 256], sims[a : a + 256]
            x = self.vectors[np.maximum(i, 0)]
            between = np.einsum("bid,bjd->bij", x, x, optimize=True)
            live = i >= 0
            keep = np.zeros(i.shape, bool)
            for c in range(i.shape[1]):
                shadowed = (keep & (between[:, c, :] > s[:, c, None])).any(1)
                keep[:, c] = live[:, c] & ~shadowed & (keep.sum(1) < most)
            rank = np.where(keep, 0, np.where(live, 1, 2)) * i.shape[1] + np.arange(i.shape[1])
            best = np.argsort(rank, axis=1)[:, :most]
            out[a : a + 256, : best.shape[1]] = np.take_along_axis(np.where(live, i, -1), best, 1)
        return out

    def _link_back(self, adj: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        to, back = chosen.ravel(), np.repeat(new, chosen.shape[1])
        ok = to >= 0
        to, back = to[ok], back[ok]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        wide = int(count.max()) if len(count) else 0
        if not wide:
            return
        extra = np.full((len(nodes), wide), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = back
        both = np.concatenate([adj[nodes].astype(np.int64), extra], 1)
        full = (both >= 0).sum(1) > adj.shape[1]
        if (~full).any():
            part = both[~full]
            order = np.argsort(part < 0, axis=1, kind="stable")[:, : adj.shape[1]]
            adj[nodes[~full]] = np.take_along_axis(part, order, 1)
        # a batch of hubs holds no more than HUBS bytes of their candidates' vectors
        step = max(1, min(256, HUBS // (4 * both.shape[1] * self.vectors.shape[1])))
        for a in range(0, int(full.sum()), step):
            own, part = nodes[full][a : a + step], both[full][a : a + step]
            if part.shape[1] > 3 * adj.shape[1]:  # a hub: its nearest candidates
                s = np.where(part >= 0, np.einsum("bd,bkd->bk", self.vectors[own], self.vectors[np.maximum(part, 0)]), -3)
                part = np.take_along_axis(part, np.argpartition(-s, 3 * adj.shape[1], axis=1)[:, : 3 * adj.shape[1]], 1)
            s = np.einsum("bd,bkd->bk", self.vectors[own], self.vectors[np.maximum(part, 0)])
            adj[own] = self._diverse(part, s, adj.shape[1])

    def _found(self, q: np.ndarray, layers: list[np.ndarray], beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest nodes of layers[0] for queries, by way of the layers above it."""
        top = layers[-1]
        s = q @ self.vectors[: len(top)].T if len(top) <= 4 * STEP else None
        if s is None:
            entry = np.zeros((len(q), 1), np.int64)
        else:
            k = min(4, len(top))
            entry = np.argpartition(-s, k - 1, axis=1)[:, :k]
            if len(layers) == 1 and beam >= len(top):
                return np.tile(np.arange(len(top)), (len(q), 1)), s
        for adj in layers[-2:0:-1]:
            entry = self._beam(q, adj, entry, 8)[0][:, :4]
            entry = np.where(entry >= 0, entry, 0)
        ids, sims, _ = self._beam(q, layers[0], entry, beam)
        return ids, sims

    def _beam(self, q: np.ndarray, adj: np.ndarray, entry: np.ndarray, beam: int, hits_from: float | None = None):
        """Beam search: ``ids, sims`` of the nearest (nearest first), and all visited pairs of hits_from or more."""
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(adj)), bool)
        entry = np.where(entry < len(adj), entry, 0)
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -4, np.float32)
        open_ = np.zeros((len(q), beam), bool)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        wave = np.sort(entry, 1)
        wave[:, 1:][wave[:, 1:] == wave[:, :-1]] = -1
        live = np.arange(len(q))
        while True:
            r = rows[live]
            fresh = wave >= 0
            fresh &= ~seen[r, np.maximum(wave, 0)]
            seen[np.broadcast_to(r, wave.shape)[fresh], wave[fresh]] = True
            s = np.full(wave.shape, -4, np.float32)
            at, col = np.nonzero(fresh)
            s[at, col] = np.einsum("kd,kd->k", self.vectors[wave[at, col]], q[live[at]])
            if hits_from is not None:
                ok = s[at, col] >= hits_from
                hits.append((live[at[ok]], wave[at[ok], col[ok]]))
            all_ids = np.concatenate([ids[live], np.where(fresh, wave, -1)], 1)
            all_sims = np.concatenate([sims[live], s], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] if all_sims.shape[1] > beam else np.broadcast_to(np.arange(all_sims.shape[1]), all_sims.shape)
            ids[live], sims[live], open_[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_open))
            live = live[open_[live].any(1)]
            if not len(live):
                break
            o = np.where(open_[live], sims[live], -9)
            k = min(4, beam)
            pick = np.argpartition(-o, k - 1, axis=1)[:, :k]
            take = np.take_along_axis(o, pick, 1) > -9
            open_[live[:, None], pick] = False
            nodes = np.where(take, ids[live[:, None], pick], -1)
            wave = np.where(nodes[:, :, None] >= 0, adj[np.maximum(nodes, 0)], -1).reshape(len(live), -1).astype(np.int64)
            wave.sort(1)
            wave[:, 1:][wave[:, 1:] == wave[:, :-1]] = -1
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), hits

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """``ids, sims`` [queries, beam], nearest first, -1 beyond what there is."""
        parts = [self._search(q[a : a + STEP], beam, None)[:2] for a in range(0, len(q), STEP)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def within(self, q: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, node) of dot product ``least`` or more that a beam comes across."""
        rows, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(q), STEP):
            for r, n in self._search(q[a : a + STEP], beam, least)[2]:
                rows.append(r + a)
                nodes.append(n)
        return np.concatenate(rows), np.concatenate(nodes)

    def _search(self, q: np.ndarray, beam: int, hits_from: float | None):
        top = self.layers[-1]
        k = min(4, len(top))
        entry = np.argpartition(-(q @ self.vectors[: len(top)].T), k - 1, axis=1)[:, :k]
        for adj in self.layers[-2:0:-1]:
            entry = np.maximum(self._beam(q, adj, entry, 8)[0][:, :4], 0)
        return self._beam(q, self.layers[0], entry, beam, hits_from)
