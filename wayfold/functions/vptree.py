"""Vantage-point tree over points of any metric, queried in batches."""

from __future__ import annotations

import numpy as np

EARTH_RADIUS_M = 6_371_008.8


def euclidean(ax, ay, bx, by):
    return np.sqrt((ax - bx) ** 2 + (ay - by) ** 2)


def great_circle(ax, ay, bx, by):
    """Metres between places given as longitude and latitude in degrees."""
    ax, ay, bx, by = np.radians(ax), np.radians(ay), np.radians(bx), np.radians(by)
    h = np.sin((ay - by) / 2) ** 2 + np.cos(ay) * np.cos(by) * np.sin((ax - bx) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def euclidean_within(ax, ay, bx, by, r):
    """Compared in squares: exact where coordinates and radius have few binary digits."""
    return (ax - bx) ** 2 + (ay - by) ** 2 <= r * r


def great_circle_within(ax, ay, bx, by, r):
    return great_circle(ax, ay, bx, by) <= r


METRICS = {"euclidean": (euclidean, euclidean_within), "great_circle": (great_circle, great_circle_within)}


class VPTree:
    """Splits by rank of distance to a vantage point, so equal points cannot unbalance it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: str = "euclidean", leaf: int = 48):
        self.x, self.y = x, y
        self.distance, self.within = METRICS[metric]
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []  # (begin, end, vantage, near_max, far_min, near, far); a leaf has vantage -1
        waiting = [(0, len(x), -1, 0)] if len(x) else []
        while waiting:
            a, b, parent, side = waiting.pop()
            me = len(self.nodes)
            if parent >= 0:
                up = list(self.nodes[parent])
                up[5 + side] = me
                self.nodes[parent] = tuple(up)
            if b - a <= leaf:
                self.nodes.append((a, b, -1, 0.0, 0.0, -1, -1))
                continue
            part = self.order[a:b]
            # the point farthest from the first one lies at the rim, which splits best
            rim = part[np.argmax(self.distance(x[part], y[part], x[part[0]], y[part[0]]))]
            d = self.distance(x[part], y[part], x[rim], y[rim])
            half = len(part) // 2
            by_rank = np.argpartition(d, half)
            self.order[a:b], d = part[by_rank], d[by_rank]
            self.nodes.append((a, b, rim, d[:half].max(), d[half:].min(), -1, -1))
            waiting += [(a, a + half, me, 0), (a + half, b, me, 1)]

    def pairs_within(self, qx: np.ndarray, qy: np.ndarray, radius) -> tuple[np.ndarray, np.ndarray]:
        """All (query, point) index pairs at most `radius` apart; `radius` is a number or one for each query."""
        r = np.broadcast_to(np.asarray(radius, float), qx.shape)
        found_q, found_p = [], []
        waiting = [(0, np.arange(len(qx)))] if self.nodes and len(qx) else []
        while waiting:
            node, q = waiting.pop()
            a, b, rim, near_max, far_min, near, far = self.nodes[node]
            if rim < 0:
                p = self.order[a:b]
                for i in range(0, len(q), 65_536):
                    part = q[i : i + 65_536]
                    hit = self.within(qx[part, None], qy[part, None], self.x[p][None], self.y[p][None], r[part, None])
                    hq, hp = np.nonzero(hit)
                    found_q.append(part[hq])
                    found_p.append(p[hp])
                continue
            d = self.distance(qx[q], qy[q], self.x[rim], self.y[rim])
            reach = r[q] + 1e-9 * (1 + d)
            inner = q[d - reach <= near_max]
            outer = q[d + reach >= far_min]
            if len(inner):
                waiting.append((near, inner))
            if len(outer):
                waiting.append((far, outer))
        if not found_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_p)


class Pivots:
    """Nearest pivots of many places. Pivots hang under some of them in two levels, so that most are never compared."""

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: str):
        self.x, self.y, self.distance = x, y, METRICS[metric][0]
        heads = np.arange(max(1, int(np.sqrt(len(x)))))
        d = self.distance(x[:, None], y[:, None], x[heads][None], y[heads][None])
        under = d.argmin(1)
        self.groups = [(x[h], y[h], g, d[g, h].max()) for h in heads if len(g := np.flatnonzero(under == h))]

    def within_nearest(self, qx: np.ndarray, qy: np.ndarray, extra, limit=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot and its distance of each place; all (place, pivot, distance) within nearest distance + `extra`.
        `limit(place, pivot)` may bound the distance further. Of equally near pivots the first is nearest."""
        n = len(qx)
        extra = np.broadcast_to(np.asarray(extra, float), (n,))
        to_head = np.stack([self.distance(qx, qy, hx, hy) for hx, hy, _, _ in self.groups], 1)
        radius = np.array([g[3] for g in self.groups])
        slack = 1e-9 * (1 + to_head)
        best = to_head.min(1) if n else np.empty(0)  # heads are pivots too
        own = to_head.argmin(1) if n else np.empty(0, int)
        for k, (_, _, g, _) in enumerate(self.groups):  # first the group of the nearest head, for a good bound
            q = np.flatnonzero(own == k)
            if len(q):
                best[q] = np.minimum(best[q], self.distance(qx[q, None], qy[q, None], self.x[g][None], self.y[g][None]).min(1))
        qs, ps, ds = [], [], []
        for k, (_, _, g, _) in enumerate(self.groups):
            q = np.flatnonzero(to_head[:, k] - radius[k] - slack[:, k] <= best + extra)
            for i in range(0, len(q), 1 + 4_000_000 // len(g)):
                part = q[i : i + 1 + 4_000_000 // len(g)]
                d = self.distance(qx[part, None], qy[part, None], self.x[g][None], self.y[g][None])
                hq, hp = np.nonzero(d <= (best[part] + extra[part])[:, None] * (1 + 1e-12))
                qs.append(part[hq])
                ps.append(g[hp])
                ds.append(d[hq, hp])
        q, p, d = (np.concatenate(v) if v else np.empty(0, t) for v, t in ((qs, int), (ps, int), (ds, float)))
        order = np.lexsort((p, d, q))
        q, p, d = q[order], p[order], d[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, int)
        home, nearest = p[first], d[first]
        keep = d <= nearest[q] + extra[q] + 1e-9 * (1 + d) if len(q) else np.empty(0, bool)
        if limit is not None and len(q):
            keep &= d <= limit(q, p) + 1e-9 * (1 + d)
        return home, nearest, q[keep], p[keep], d[keep]
