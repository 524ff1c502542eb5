"""Hierarchical navigable small-world graph in flat arrays, built in bulk and searched in batches with numpy.

Each level holds the numbers of its nodes and one flat array of neighbours, -1 where there is none. Nodes of a level are
compared block by block, which a shard's bounded size allows; each keeps a diverse set of its nearest ones (a candidate
counts only if it is nearer to the node than to any kept one), the rest of its places go to the nearest others and to nodes that chose it.
Many copies of one vector or many ties are no special case: a node has its places, whatever the others are.
"""

from __future__ import annotations

import numpy as np

#: Nodes compared with all others of a level, and queries searched, at a time.
BATCH = 512


class HNSW:
    """Cosine similarity of unit vectors; a node keeps `m` diverse neighbours of `near` candidates, and up to `m` that chose it."""

    def __init__(self, v: np.ndarray, m: int = 12, near: int = 32, seed: int = 0):
        self.v = np.ascontiguousarray(v, np.float32)
        n = len(v)
        u = np.random.default_rng(seed).random(n)
        level = np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(int), 6)
        #: Nodes of each level, and their neighbours as node numbers, 2m each.
        self.nodes = [np.flatnonzero(level >= k) for k in range(level.max() + 1 if n else 0)]
        self.links = [self._level(nodes, m, near) for nodes in self.nodes]
        self.row = [np.full(n + 1, -1, np.int64) for _ in self.nodes]
        for row, nodes in zip(self.row, self.nodes):
            row[nodes] = np.arange(len(nodes))
        self.entry = self.nodes[-1][:1] if n else np.empty(0, np.int64)

    def _level(self, nodes: np.ndarray, m: int, near: int) -> np.ndarray:
        v, n = self.v[nodes], len(nodes)
        near = min(near, n - 1)
        own, sims = np.full((n, m), -1, np.int64), np.full((n, m), -2, np.float32)
        for i in range(0, n if near > 0 else 0, BATCH):
            s = v[i : i + BATCH] @ v.T
            rows = np.arange(len(s))
            s[rows, rows + i] = -2
            cand = np.argpartition(-s, near - 1, axis=1)[:, :near]
            cs = np.take_along_axis(s, cand, 1)
            by = np.argsort(-cs, 1, kind="stable")
            cand, cs = np.take_along_axis(cand, by, 1), np.take_along_axis(cs, by, 1)
            w = v[cand]
            between = np.matmul(w, w.transpose(0, 2, 1))
            kept, closest, number = np.zeros(cs.shape, bool), np.full(cs.shape, -2.0, np.float32), np.zeros(len(cs), int)
            for c in range(near):
                good = (closest[:, c] < cs[:, c]) & (number < m)
                kept[:, c] = good
                number += good
                np.maximum(closest, np.where(good[:, None], between[:, c], np.float32(-2)), out=closest)
            pick = np.argsort(~kept, 1, kind="stable")[:, :m]
            own[i : i + BATCH, : pick.shape[1]] = np.take_along_axis(cand, pick, 1)
            sims[i : i + BATCH, : pick.shape[1]] = np.take_along_axis(cs, pick, 1)
        # both directions: a node's own choice first, then those that chose it, the nearest of them first
        a, b, s = np.repeat(np.arange(n), m), own.reshape(-1), sims.reshape(-1)
        a, b, s = a[b >= 0], b[b >= 0], s[b >= 0]
        here = np.concatenate([a, b])
        there = np.concatenate([b, a])
        by = np.lexsort((there, -np.concatenate([s, s]), np.repeat([0, 1], len(a)), here))
        # an edge chosen from both ends comes twice; the second time it is left out
        key = here[by] * n + there[by]
        first = np.zeros(len(by), bool)
        first[np.unique(key, return_index=True)[1]] = True
        here, there = here[by][first], there[by][first]
        start = np.searchsorted(here, np.arange(n))
        place = np.arange(len(here)) - start[here]
        ok = place < 2 * m
        out = np.full((n, 2 * m), -1, np.int64)
        out[here[ok], place[ok]] = nodes[there[ok]]
        return out.astype(np.int32)

    def _search_level(self, q: np.ndarray, near: np.ndarray, k: int, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `width` nodes found from the entries `near`, best first; -1 and -2 where there are fewer. Each round
        opens the best `step` nodes of a query that are not opened yet; a query ends when all it holds are opened."""
        links, row, n, rows = self.links[k], self.row[k], len(self.v), len(q)
        seen = np.zeros((rows, n + 1), bool)
        seen[:, n] = True
        near = np.sort(near, 1)
        near = np.where(np.concatenate([np.zeros((rows, 1), bool), near[:, 1:] == near[:, :-1]], 1), -1, near)[:, :width]
        sims = np.where(near >= 0, np.einsum("ijk,ik->ij", self.v[np.maximum(near, 0)], q), np.float32(-2))
        np.put_along_axis(seen, np.where(near >= 0, near, n), True, 1)
        ids = np.full((rows, width), -1, np.int64)
        best = np.full((rows, width), -2, np.float32)
        opened = np.ones((rows, width), bool)
        by = np.argsort(-sims, 1)
        w = near.shape[1]
        ids[:, :w], best[:, :w] = np.take_along_axis(near, by, 1), np.take_along_axis(sims, by, 1)
        opened[:, :w] = ids[:, :w] < 0
        active = np.arange(rows)
        while True:
            first = np.argsort(opened[active], 1, kind="stable")[:, :step]  # held nodes are sorted: the best unopened
            live = ~np.take_along_axis(opened[active], first, 1)
            go = live.any(1)
            active, first, live = active[go], first[go], live[go]
            if not len(active):
                return ids, best
            b_ids, b_best, b_open = ids[active], best[active], opened[active]
            node = np.where(live, np.take_along_axis(b_ids, first, 1), n)
            np.put_along_axis(b_open, first, True, 1)
            nxt = links[row[node]].reshape(len(active), -1).astype(np.int64)
            nxt[np.repeat(node == n, links.shape[1], 1) | (nxt < 0)] = n
            nxt.sort(1)
            fresh = ~seen[active[:, None], nxt]
            fresh[:, 1:] &= nxt[:, 1:] != nxt[:, :-1]
            r, c = np.nonzero(fresh)
            to = nxt[r, c]
            seen[active[r], to] = True
            s = np.einsum("ij,ij->i", self.v[to], q[active[r]])
            hopeful = s > b_best[r, -1]  # others would not be held
            r, to, s = r[hopeful], to[hopeful], s[hopeful]
            most = int(np.bincount(r, minlength=1).max()) if len(r) else 0
            if most:
                at = np.arange(len(r)) - np.searchsorted(r, np.arange(len(active)))[r]
                more, more_s = np.full((len(active), most), -1, np.int64), np.full((len(active), most), -2, np.float32)
                more[r, at], more_s[r, at] = to, s
                all_s = np.concatenate([b_best, more_s], 1)
                by = np.argsort(-all_s, 1, kind="stable")[:, :width]
                b_ids = np.take_along_axis(np.concatenate([b_ids, more], 1), by, 1)
                b_best = np.take_along_axis(all_s, by, 1)
                b_open = np.take_along_axis(np.concatenate([b_open, more < 0], 1), by, 1)
            ids[active], best[active], opened[active] = b_ids, b_best, b_open

    def search(self, q: np.ndarray, width: int, start: np.ndarray | None = None, step: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the `width` best found for each query, best first; -1 and -2 where there are fewer. `start` is a node to begin at
        for each query; without it the search comes down through the levels."""
        q = np.ascontiguousarray(q, np.float32)
        ids, sims = np.full((len(q), width), -1, np.int64), np.full((len(q), width), -2, np.float32)
        for i in range(0, len(q) if len(self.v) else 0, BATCH):
            part = q[i : i + BATCH]
            near = np.repeat(self.entry[None], len(part), 0) if start is None else start[i : i + BATCH, None]
            for k in range(len(self.nodes) - 1, 0, -1) if start is None else ():
                near = self._search_level(part, near, k, 4, 2)[0]
            ids[i : i + BATCH], sims[i : i + BATCH] = self._search_level(part, near, 0, width, step)
        return ids, sims
