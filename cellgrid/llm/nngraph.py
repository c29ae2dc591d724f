"""NN-descent and greedy search over the vectors of one shard, which fit in memory. Nearness is the inner product.

The graph starts from random hyperplane codes: rows that share a code are compared in blocks, and few
rows are one block, so they are compared exactly. A round of NN-descent lets the rows that a row is
linked with, in either direction, meet at it: those that meet are compared where one of them is new
there, and each keeps its best. A row has LINKS ends of either direction meet in a round, new ones
first; the others meet in later rounds. Rounds end when few links change.
"""

from __future__ import annotations

import math

import numpy as np

LINKS = 32
#: Hyperplane codes and rows compared at once; few rows are one block.
TREES, BLOCK = 3, 512
#: Rounds end when this share of links or less is new; ROUNDS is a guard that is not reached in practice.
ROUNDS, SETTLED = 24, 0.005
#: Centres at which rows meet at once.
CENTRES = 128
#: Rows that every query is compared with first, those of them that it starts from, and what it keeps and expands at a time.
PIVOTS, STARTS, BEAM, EXPAND = 1024, 16, 256, 32


def scaled(x: np.ndarray) -> np.ndarray:
    """`x` by one factor, in single precision where its rows are of like size; inner products keep their order."""
    size = np.abs(x).max(axis=1)
    top = size.max()
    return (x / top).astype(np.float32 if size.min() > 1e-6 * top else np.float64)


class Graph:
    """For every row its best links so far: ids (-1: none yet), their scores, and whether they have met the others."""

    def __init__(self, x: np.ndarray, links: int = LINKS, seed: int = 11):
        self.x, self.n, self.links = x, len(x), max(1, min(links, len(x) - 1))
        self.rng = np.random.default_rng(seed)
        self.ids = np.full((self.n, self.links), -1, np.int32)
        self.s = np.full((self.n, self.links), -np.inf, x.dtype)
        self.new = np.zeros((self.n, self.links), bool)

    def _keep(self, rows: np.ndarray, ids: np.ndarray, s: np.ndarray) -> int:
        """Let `rows` keep their best of what they have and of (ids, s), a row each; how many links are new."""
        k = self.links
        ids = np.concatenate([self.ids[rows], ids], axis=1)
        s = np.concatenate([self.s[rows], s], axis=1)
        new = np.ones(ids.shape, bool)
        new[:, :k] = self.new[rows]
        order = np.argsort(ids, axis=1, kind="stable")  # of equal ids the one that is there comes first
        sorted_ids = np.take_along_axis(ids, order, axis=1)
        again = np.zeros(ids.shape, bool)
        np.put_along_axis(again, order[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], axis=1)
        s[again] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        self.s[rows] = np.take_along_axis(s, best, axis=1)
        kept = self.s[rows] > -np.inf
        self.ids[rows] = np.where(kept, np.take_along_axis(ids, best, axis=1), -1)
        self.new[rows] = np.take_along_axis(new, best, axis=1) & kept
        return int(((best >= k) & kept).sum())

    def start(self) -> None:
        bits = max(0, math.ceil(math.log2(self.n / BLOCK)))
        for _ in range(TREES if bits else 1):
            planes = self.rng.normal(size=(self.x.shape[1], bits)).astype(self.x.dtype)
            order = np.argsort((self.x @ planes > 0) @ (1 << np.arange(bits)), kind="stable") if bits else np.arange(self.n)
            for at in np.array_split(order, -(-self.n // BLOCK)):
                s = self.x[at] @ self.x[at].T
                np.fill_diagonal(s, -np.inf)
                k = min(self.links, len(at))
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                self._keep(at, at[best].astype(np.int32), np.take_along_axis(s, best, axis=1))

    def _met(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows that meet at each row, -1 for none; how many columns of them are new): LINKS each of new and of old ends."""
        u = np.repeat(np.arange(self.n, dtype=np.int32), self.links)
        w, new = self.ids.ravel(), self.new.ravel().copy()
        there = w >= 0
        out = []
        for kind in (True, False):
            some = np.flatnonzero(there & (new == kind))
            at, end = np.concatenate([u[some], w[some]]), np.concatenate([w[some], u[some]])
            order = self.rng.permutation(len(at))
            order = order[np.argsort(at[order], kind="stable")]
            at, end = at[order], end[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            ok = place < self.links
            table = np.full((self.n, self.links), -1, np.int32)
            table[at[ok], place[ok]] = end[ok]
            out.append(table)
            if kind:  # a new link has met the others once it is among its own row's sample
                met = order[ok]
                self.new.ravel()[some[met[met < len(some)]]] = False
        return np.concatenate(out, axis=1), self.links

    def round(self) -> int:
        met, fresh = self._met()
        changed = 0
        worst = self.s.min(axis=1)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0
        for a in range(0, self.n, CENTRES):
            ids = met[a : a + CENTRES]
            y = self.x.take(ids, axis=0)
            s = y[:, :fresh] @ y.transpose(0, 2, 1)
            low = worst[ids]  # of -1 any row's, which is not used
            low[ids < 0] = np.inf
            missing = (ids[:, :fresh, None] < 0) | (ids[:, None, :] < 0) | (ids[:, :fresh, None] == ids[:, None, :])
            s[missing] = -np.inf
            for best, here, there in ((s > low[:, :fresh, None], 1, 2), (s > low[:, None, :], 2, 1)):
                at = np.nonzero(best)
                held.append((ids[at[0], at[here]], ids[at[0], at[there]], s[at]))
                count += len(at[0])
            if count > 2_000_000 or a + CENTRES >= self.n:
                changed += self._merge(held)
                held, count, worst = [], 0, self.s.min(axis=1)
        return changed

    def _merge(self, held) -> int:
        u, w, s = (np.concatenate(c) for c in zip(*held, strict=True))
        pair = u.astype(np.int64) * self.n + w
        order = np.argsort(pair)
        pair = pair[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        order = order[first]
        u, w, s = u[order], w[order], s[order]
        order = np.lexsort((-s, u))
        u, w, s = u[order], w[order], s[order]
        place = np.arange(len(u)) - np.searchsorted(u, u)
        ok = place < self.links
        u, w, s, place = u[ok], w[ok], s[ok], place[ok]
        rows, at = np.unique(u, return_inverse=True)
        changed = 0
        for a in range(0, len(rows), 8192):
            part = rows[a : a + 8192]
            lo, hi = np.searchsorted(u, part[0]), np.searchsorted(u, part[-1], "right")
            ids = np.full((len(part), self.links), -1, np.int32)
            best = np.full((len(part), self.links), -np.inf, s.dtype)
            ids[at[lo:hi] - a, place[lo:hi]] = w[lo:hi]
            best[at[lo:hi] - a, place[lo:hi]] = s[lo:hi]
            changed += self._keep(part, ids, best)
        return changed

    def descend(self, rounds: int = ROUNDS) -> Graph:
        self.start()
        if self.n > BLOCK:
            for _ in range(rounds):
                if self.round() <= SETTLED * self.n * self.links:
                    break
        return self

    def both(self) -> np.ndarray:
        """Each row's links and the best half as many of those that are linked with it, -1 for none."""
        u, w, s = np.repeat(np.arange(self.n, dtype=np.int32), self.links), self.ids.ravel(), self.s.ravel()
        some = w >= 0
        u, w, s = u[some], w[some], s[some]
        order = np.lexsort((-s, w))
        u, w = u[order], w[order]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        half = self.links // 2
        ok = place < half
        back = np.full((self.n, half), -1, np.int32)
        back[w[ok], place[ok]] = u[ok]
        return np.concatenate([self.ids, back], axis=1)


class Walk:
    """Greedy search of a graph: from the best of some rows, and from a query's own row, over links until the beam has no row left to expand."""

    def __init__(self, graph: Graph, beam: int = BEAM, expand: int = EXPAND, seed: int = 12):
        self.x, self.n, self.links = graph.x, graph.n, graph.both()
        self.beam, self.expand = min(beam, self.n), min(expand, self.n)
        self.pivots = np.sort(np.random.default_rng(seed).permutation(self.n)[:PIVOTS]).astype(np.int32)

    def nearest(self, q: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The beam of each query, best first, -1 for none. own: each query's own row, or -1."""
        b, rows = len(q), np.arange(len(q))[:, None]
        seen = np.full((b, self.n), -1, np.int32)
        marks = seen.ravel()
        s = q @ self.x[self.pivots].T
        k = min(self.beam if len(self.pivots) == self.n else STARTS, len(self.pivots))
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        ids, s = self.pivots[at], np.take_along_axis(s, at, axis=1)
        seen[rows, ids] = 0
        mine = np.flatnonzero(own >= 0)
        extra, extra_s = np.full((b, 1), -1, np.int32), np.full((b, 1), -np.inf, s.dtype)
        mine = mine[seen[mine, own[mine]] < 0]
        extra[mine, 0], extra_s[mine, 0] = own[mine], np.einsum("ij,ij->i", q[mine], self.x[own[mine]])
        seen[mine, own[mine]] = 0
        room = max(0, self.beam - k - 1)
        ids = np.concatenate([ids, extra, np.full((b, room), -1, np.int32)], axis=1)
        s = np.concatenate([s, extra_s, np.full((b, room), -np.inf, s.dtype)], axis=1)
        done = ids < 0
        live = np.arange(b)
        while len(live):
            open_s = np.where(done[live], -np.inf, s[live])
            at = np.argpartition(-open_s, self.expand - 1, axis=1)[:, : self.expand]
            good = np.take_along_axis(open_s, at, axis=1) > -np.inf
            some = good.any(axis=1)
            live, at, good = live[some], at[some], good[some]
            if not len(live):
                break
            turn = ids[live[:, None], at]
            done[live[:, None], at] = True
            found = self.links.take(turn, axis=0)
            found[~good] = -1
            found = found.reshape(len(live), -1)
            cell = (found + live[:, None] * self.n).ravel()  # of `seen`, as one row
            at = np.flatnonzero((found.ravel() >= 0) & (marks.take(cell) < 0))
            cell = cell.take(at)
            number = np.arange(len(at), dtype=np.int32)
            marks[cell] = number
            once = marks.take(cell) == number
            at = at[once]
            w = found.ravel().take(at)
            got = np.full(found.size, -np.inf, s.dtype)
            ends = np.searchsorted(at, np.arange(len(live) + 1) * found.shape[1])
            y = self.x.take(w, axis=0)
            for r, a, e in zip(live, ends[:-1], ends[1:], strict=True):
                got[at[a:e]] = y[a:e] @ q[r]
            got = got.reshape(found.shape)
            all_s = np.concatenate([s[live], got], axis=1)
            best = np.argpartition(-all_s, self.beam - 1, axis=1)[:, : self.beam]
            width = s.shape[1]
            s[live, : self.beam] = np.take_along_axis(all_s, best, axis=1)
            ids[live, : self.beam] = np.take_along_axis(np.concatenate([ids[live], found], axis=1), best, axis=1)
            done[live, : self.beam] = np.take_along_axis(np.concatenate([done[live], np.zeros(found.shape, bool)], axis=1), best, axis=1)
            if width > self.beam:
                s[live, self.beam :], done[live, self.beam :] = -np.inf, True
            done[s == -np.inf] = True
        ids[s == -np.inf] = -1
        order = np.argsort(-s, axis=1, kind="stable")[:, : self.beam]
        return np.take_along_axis(ids, order, axis=1)
