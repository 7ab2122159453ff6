"""Hierarchical navigable small-world graph over unit vectors, built and searched many vectors at a time."""

from __future__ import annotations

import numpy as np


def _dots(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of each query with its own row of ids; -2 where an id is -1."""
    out = np.einsum("qcd,qd->qc", vectors[np.maximum(ids, 0)], queries, optimize=True)
    out[ids < 0] = -2
    return out


class Graph:
    def __init__(self, vectors: np.ndarray, links: int = 16, breadth: int = 64, seed: int = 1):
        self.v = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(self.v)
        self.links = links
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.top = int(level.max()) if n else 0
        self.near = [np.full((n, 2 * links), -1, np.int32) for _ in range(self.top + 1)]
        self.entry = int(self.order[0]) if n else -1
        done = 1
        while done < n:
            wave = self.order[done : done + max(32, min(1024, done // 3))]
            wave = wave[level[wave] == level[wave[0]]]
            self._insert(wave, int(level[wave[0]]), breadth)
            done += len(wave)
        if n:
            self._join_islands()

    def _join_islands(self) -> None:
        """Pruning can leave groups of near-equal vectors that no link leads to; the nearest vertex that can be reached
        gets a link to each, in columns added for them."""
        near = self.near[0]
        reached = np.zeros(len(self.v), dtype=bool)

        def spread(front: np.ndarray) -> None:
            reached[front] = True
            while len(front):
                front = np.unique(near[front])
                front = front[front >= 0]
                front = front[~reached[front]]
                reached[front] = True

        spread(np.array([self.entry]))
        for u in self.order.tolist():
            if reached[u]:
                continue
            there = np.flatnonzero(reached)
            r = int(there[np.argmax(self.v[there] @ self.v[u])])
            free = np.flatnonzero(near[r] < 0)
            if not len(free):
                near = np.pad(near, ((0, 0), (0, 2)), constant_values=-1)
                free = [near.shape[1] - 2]
            near[r, free[0]] = u
            spread(np.array([u]))
        self.near[0] = near

    def _insert(self, wave: np.ndarray, level: int, breadth: int) -> None:
        q = self.v[wave]
        start = np.full((len(wave), 1), self.entry)
        for k in range(self.top, level, -1):
            start = self.search_level(q, start, k, 1)[0]
        among = q @ q.T
        np.fill_diagonal(among, -2)
        peers = wave[np.argsort(-among, axis=1)[:, :breadth]] if len(wave) > 1 else np.full((1, 1), -1)
        for k in range(level, -1, -1):
            found, _ = self.search_level(q, start, k, breadth)
            start = found
            both = np.concatenate([found, peers], axis=1)
            both[both == wave[:, None]] = -1
            mine = self._spread(q, both, self.links)
            self.near[k][wave, : self.links] = mine
            self._back(wave, mine, k)

    def _spread(self, q: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Half of the places go to candidates that are nearer to the row's vector than to any chosen before, so that
        links lead out of dense groups; the rest to the nearest others, so that dense groups hold together."""
        sim = _dots(self.v, ids, q)
        order = np.argsort(-sim, axis=1, kind="stable")[:, : 6 * most]
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        c = ids.shape[1]
        x = self.v[np.maximum(ids, 0)]
        between = x @ x.transpose(0, 2, 1)
        live, chosen = sim > -2, np.zeros(ids.shape, dtype=bool)
        same = (ids[:, :, None] == ids[:, None, :]) & np.tri(c, k=-1, dtype=bool)
        live &= ~same.any(axis=2)
        for k in range(c):
            fits = live[:, k] & (2 * chosen.sum(axis=1) < most) & ~((between[:, k, :] > sim[:, k, None]) & chosen).any(axis=1)
            chosen[:, k] = fits
        rank = np.where(chosen, 0, np.where(live, 1, 2)) * c + np.arange(c)
        take = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(live, take, 1), np.take_along_axis(ids, take, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _back(self, wave: np.ndarray, mine: np.ndarray, k: int) -> None:
        to, of = mine.ravel(), np.repeat(wave, mine.shape[1])
        to, of = to[to >= 0], of[to >= 0]
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        who, first, n = np.unique(to, return_index=True, return_counts=True)
        room = self.near[k].shape[1]
        for lo in range(0, len(who), 2048):
            w, f, c = who[lo : lo + 2048], first[lo : lo + 2048], np.minimum(n[lo : lo + 2048], 64)
            new = np.full((len(w), int(c.max())), -1)
            at = np.arange(new.shape[1])
            ok = at < c[:, None]
            new[ok] = of[(f[:, None] + at)[ok]]
            self.near[k][w] = self._spread(self.v[w], np.concatenate([self.near[k][w], new], axis=1), room)

    def search_level(self, q: np.ndarray, start: np.ndarray, k: int, breadth: int, hits: np.ndarray | None = None, bound: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """The `breadth` nearest vertices found from start, nearest first, and their inner products. hits (queries x
        vertices) is marked where an inner product of at least bound is met."""
        n, m = len(self.v), len(q)
        seen = np.zeros((m, n), dtype=bool)
        beam, sim = start.astype(np.int64), _dots(self.v, start, q)
        rows = np.arange(m)[:, None]
        ok = beam >= 0
        seen[np.broadcast_to(rows, beam.shape)[ok], beam[ok]] = True
        if hits is not None:
            near = ok & (sim >= bound)
            hits[np.broadcast_to(rows, beam.shape)[near], beam[near]] = True
        fresh = ok.copy()
        active = np.arange(m)
        while len(active):
            score = np.where(fresh[active], sim[active], -3)
            take = np.argsort(-score, axis=1)[:, :2]
            open_ = np.take_along_axis(score, take, 1) > -3
            some = open_.any(axis=1)
            active, take, open_ = active[some], take[some], open_[some]
            if not len(active):
                break
            a = active[:, None]
            at = np.where(open_, beam[a, take], -1)
            f = fresh[active]
            f[np.arange(len(active))[:, None], take] = False
            fresh[active] = f
            next_ = np.where(at[:, :, None] >= 0, self.near[k][np.maximum(at, 0)], -1).reshape(len(active), -1).astype(np.int64)
            next_.sort(axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            next_[(next_ >= 0) & seen[a, np.maximum(next_, 0)]] = -1
            ok = next_ >= 0
            seen[np.broadcast_to(a, next_.shape)[ok], next_[ok]] = True
            s = _dots(self.v, next_, q[active])
            if hits is not None:
                near = ok & (s >= bound)
                hits[np.broadcast_to(a, next_.shape)[near], next_[near]] = True
            ids = np.concatenate([beam[active], next_], axis=1)
            sims = np.concatenate([sim[active], s], axis=1)
            new = np.concatenate([fresh[active], ok], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :breadth]
            if beam.shape[1] < best.shape[1]:
                grow = best.shape[1] - beam.shape[1]
                beam = np.pad(beam, ((0, 0), (0, grow)), constant_values=-1)
                sim = np.pad(sim, ((0, 0), (0, grow)), constant_values=-2)
                fresh = np.pad(fresh, ((0, 0), (0, grow)))
            width = best.shape[1]
            beam[active, :width] = np.take_along_axis(ids, best, 1)
            sim[active, :width] = np.take_along_axis(sims, best, 1)
            fresh[active, :width] = np.take_along_axis(new, best, 1)
            beam[active, width:], sim[active, width:], fresh[active, width:] = -1, -2, False
        return beam, sim

    def within(self, q: np.ndarray, bound: float, breadth: int = 16, margin: float = 0.05, audit: int = 16, widest: int = 64) -> np.ndarray:
        """queries x vertices: which inner products of at least bound the graph finds. A query whose beam holds nothing
        outside the margin lies in a dense group, all of which a beam would have to hold: it is multiplied with all
        vertices instead. Beams of the others widen until no audited query misses a vertex; past `widest` they are
        multiplied too."""
        n, m = len(self.v), len(q)
        hits = np.zeros((m, n), dtype=bool)
        start = np.full((m, 1), self.entry)
        for k in range(self.top, 0, -1):
            start = self.search_level(q, start, k, 2)[0]
        todo, wide = np.arange(m), breadth
        probe = np.unique(np.linspace(0, m - 1, min(audit, m)).astype(int))
        truth = q[probe] @ self.v.T >= bound
        while len(todo):
            dense = np.ones(len(todo), dtype=bool)
            if wide <= widest and wide < n:
                part = np.zeros((len(todo), n), dtype=bool)
                _, sim = self.search_level(q[todo], start[todo], 0, wide, part, bound)
                hits[todo] |= part
                dense = sim.min(axis=1) >= bound - margin
            hits[todo[dense]] = q[todo[dense]] @ self.v.T >= bound
            todo, wide = todo[~dense], 4 * wide
            if not (truth & ~hits[probe]).any():
                break
        return hits
