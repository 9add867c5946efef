"""Hierarchical navigable small-world graphs (Malkov and Yashunin 2016) over unit vectors, searched many queries at a time.

Rows are inserted in batches. A row within `join` of a node already there becomes that node's member and no node of its own,
so copies, however many, cost one search each and leave the graph as it was. Neighbours are chosen by the diversity rule:
a candidate is taken if it is closer to the node than to every neighbour taken before it; free places go to the nearest
of the rest. Levels are drawn from a hash of the row's place.
"""

from __future__ import annotations

import numpy as np

from quillspark.llm import _text as X

M, BUILD_BEAM, UPPER_BEAM, BATCH, EXPAND = 16, 48, 8, 256, 4


class Graph:
    def __init__(self, vectors: np.ndarray, join: float):
        """vectors: unit rows; join: the least cosine at which a row becomes a member."""
        self.rows = vectors
        self.leader = np.full(len(vectors), -1, np.int64)  # of each row the number of its node
        self.node_row = np.zeros(len(vectors), np.int64)
        self.points = np.zeros(vectors.shape, np.float32)
        u = (X.mix(np.arange(1, len(vectors) + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        self.level = np.minimum((-np.log(np.maximum(u, 1e-18)) / np.log(M)).astype(np.int64), 12)
        self.node_level = np.zeros(len(vectors), np.int64)
        self.links: list[np.ndarray] = []
        self.n, self.join = 0, join
        at = 0
        while at < len(vectors):
            size = min(BATCH, max(32, self.n), len(vectors) - at)
            self._insert(np.arange(at, at + size))
            at += size
        self.node_row, self.points, self.node_level = self.node_row[: self.n], self.points[: self.n], self.node_level[: self.n]
        self.links = [x[: self.n] for x in self.links]

    # ---- building

    def _insert(self, rows: np.ndarray) -> None:
        found = self._descend(self.rows[rows].astype(np.float32), BUILD_BEAM) if self.n else []
        mates = self.rows[rows] @ self.rows[rows].T
        node = np.full(len(rows), -1, np.int64)
        if found:
            nearest = found[0][0]
            close = np.einsum("ij,ij->i", self.rows[rows], self.rows[self.node_row[np.maximum(nearest[:, 0], 0)]])
            joins = (nearest[:, 0] >= 0) & (close >= self.join)
            node[joins] = nearest[joins, 0]
        free = np.flatnonzero(node < 0)
        near = mates[np.ix_(free, free)] >= self.join
        lead = np.ones(len(free), bool)
        first = np.arange(len(free))
        for i in np.flatnonzero(np.tril(near, -1).any(axis=1)).tolist():
            ahead = np.flatnonzero(near[i, :i] & lead[:i])
            if len(ahead):
                lead[i], first[i] = False, ahead[int(mates[free[i], free[ahead]].argmax())]
        new = free[lead]
        number = np.full(len(free), -1, np.int64)
        number[lead] = self.n + np.arange(len(new))
        node[free] = number[first]
        self.leader[rows] = node
        if not len(new):
            return
        ids = np.arange(self.n, self.n + len(new))
        self.node_row[ids], self.points[ids], self.node_level[ids] = rows[new], self.rows[rows[new]], self.level[rows[new]]
        self.n += len(new)
        for layer in range(int(self.node_level[ids].max()) + 1):
            if layer == len(self.links):
                self.links.append(np.full((len(self.rows), M * 2 if layer == 0 else M), -1, np.int32))
            mine = np.flatnonzero(self.node_level[ids] >= layer)
            here = found[layer] if layer < len(found) else None
            own = np.where(np.eye(len(mine), dtype=bool), -np.inf, mates[np.ix_(new[mine], new[mine])])
            top = np.argsort(-own, axis=1)[:, :M]
            cand, sim = ids[mine][top], np.take_along_axis(own, top, 1)
            if here is not None:
                cand, sim = np.concatenate([here[0][new[mine]], cand], axis=1), np.concatenate([here[1][new[mine]], sim], axis=1)
            cand = np.where(np.isfinite(sim), cand, -1)
            chosen = self._choose(cand, sim, M)
            self.links[layer][ids[mine], : chosen.shape[1]] = chosen
            self._link_back(layer, ids[mine], chosen)

    def _choose(self, cand: np.ndarray, sim: np.ndarray, room: int) -> np.ndarray:
        """Up to room of each row's candidates by the diversity rule, the nearest of the rest in free places."""
        order = np.argsort(-np.where(cand >= 0, sim, -np.inf), axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        out = np.empty((len(cand), cand.shape[1]), np.int32)
        for i in range(0, len(cand), 512):
            c, s = cand[i : i + 512], sim[i : i + 512]
            p = self.points[np.maximum(c, 0)]
            between = p @ p.transpose(0, 2, 1)
            taken, count = np.zeros(c.shape, bool), np.zeros(len(c), np.int64)
            for k in range(c.shape[1]):
                good = (c[:, k] >= 0) & (count < room) & ~(taken & (between[:, k] > s[:, k, None])).any(axis=1)
                taken[:, k] = good
                count += good
            rank = np.where(taken, 0, np.where(c >= 0, 1, 2))
            out[i : i + 512] = np.take_along_axis(c, np.argsort(rank, axis=1, kind="stable"), 1)
        return out[:, :room]

    def _link_back(self, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        links = self.links[layer]
        there = chosen >= 0
        source, target = np.repeat(nodes, chosen.shape[1])[there.reshape(-1)], chosen[there].astype(np.int64)
        fresh = ~(links[target] == source[:, None]).any(axis=1)  # batch mates may have chosen each other
        source, target = source[fresh], target[fresh]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        who, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(who), links.shape[1] + int(count.max(initial=0))), -1, np.int64)
        wide[:, : links.shape[1]] = links[who]
        wide[np.repeat(np.arange(len(who)), count), links.shape[1] + np.arange(len(source)) - np.repeat(first, count)] = source
        full = (wide >= 0).sum(axis=1) > links.shape[1]
        easy = wide[~full]
        links[who[~full]] = np.take_along_axis(easy, np.argsort(easy < 0, axis=1, kind="stable"), 1)[:, : links.shape[1]]
        for i in range(0, int(full.sum()), 512):
            some, ids = wide[full][i : i + 512], who[full][i : i + 512]
            sim = np.einsum("ijk,ik->ij", self.points[np.maximum(some, 0)], self.points[ids])
            links[ids] = self._choose(some, sim, links.shape[1])

    # ---- searching

    def _descend(self, queries: np.ndarray, beam: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each layer the (nodes, cosines) found, best first."""
        top = len(self.links) - 1
        entry = np.full((len(queries), 1), int(self.node_level[: self.n].argmax()))
        out: list = [None] * (top + 1)
        for layer in range(top, -1, -1):
            out[layer] = self._beam(queries, entry, beam if layer == 0 else UPPER_BEAM, self.links[layer])
            entry = out[layer][0]
        return out

    def _beam(self, queries: np.ndarray, entry: np.ndarray, beam: int, links: np.ndarray):
        m, n = len(queries), self.n
        seen = np.zeros((m, n), np.int32)
        ids, sims, done = np.full((m, beam), -1), np.full((m, beam), -np.inf, np.float32), np.zeros((m, beam), bool)
        k = min(beam, entry.shape[1])
        ids[:, :k] = entry[:, :k]
        sims[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("ijk,ik->ij", self.points[np.maximum(ids[:, :k], 0)], queries), -np.inf)
        r, c = np.nonzero(ids >= 0)
        seen[r, ids[r, c]] = -1
        live, stamp = np.arange(m), 1
        width = min(EXPAND, beam)
        while len(live):
            open_ = np.where(done[live], -np.inf, sims[live])
            pick = np.argpartition(-open_, width - 1, axis=1)[:, :width]
            can = np.take_along_axis(open_, pick, 1) > -np.inf
            go = can.any(axis=1)
            live, pick, can = live[go], pick[go], can[go]
            if not len(live):
                break
            done[live[:, None], pick] |= can
            cand = np.where(can[:, :, None], links[np.take_along_axis(ids[live], pick, 1)], -1).reshape(len(live), -1)
            row, col = np.nonzero(cand >= 0)
            node = cand[row, col]
            unseen = seen[live[row], node] == 0
            row, col, node = row[unseen], col[unseen], node[unseen]
            mark = stamp + np.arange(len(row), dtype=np.int32)
            stamp += len(row)
            seen[live[row], node] = mark
            once = seen[live[row], node] == mark  # two opened nodes may share a neighbour
            row, col, node = row[once], col[once], node[once]
            if not len(row):
                continue
            sim = np.full(cand.shape, -np.inf, np.float32)
            sim[row, col] = np.einsum("ij,ij->i", self.points[node], queries[live[row]])
            all_sims = np.concatenate([sims[live], sim], axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(all_sims, keep, 1)
            ids[live] = np.where(np.isfinite(sims[live]), np.take_along_axis(np.concatenate([ids[live], cand], axis=1), keep, 1), -1)
            done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(cand.shape, bool)], axis=1), keep, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def every(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all nodes at a cosine of least or more, by looking at each."""
        out = [np.zeros((2, 0), np.int64)]
        for i in range(0, len(queries), BATCH):
            q, c = np.nonzero(queries[i : i + BATCH] @ self.points.T >= least)
            out.append(np.stack([q + i, c]))
        return tuple(np.concatenate(out, axis=1))

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) found at a cosine of least or more. A query whose whole beam is that near is asked again with twice the beam."""
        queries = queries.astype(np.float32)
        out, open_ = [np.zeros((2, 0), np.int64)], np.arange(len(queries))
        while len(open_) and 4 * beam <= self.n:
            wide = []
            for i in range(0, len(open_), BATCH):
                some = open_[i : i + BATCH]
                ids, sims = self._descend(queries[some], beam)[0]
                full = sims[:, -1] >= least
                q, c = np.nonzero((sims >= least) & ~full[:, None])
                out.append(np.stack([some[q], ids[q, c]]))
                wide.append(some[full])
            open_, beam = np.concatenate(wide), 2 * beam
        if len(open_):
            q, c = self.every(queries[open_], least)
            out.append(np.stack([open_[q], c]))
        return tuple(np.concatenate(out, axis=1))

    # ---- storing

    def state(self) -> dict[str, np.ndarray]:
        return {"rows": self.rows, "leader": self.leader, "node_row": self.node_row, "node_level": self.node_level} | {f"links{i}": x for i, x in enumerate(self.links)}

    @classmethod
    def of(cls, state: dict[str, np.ndarray], join: float) -> Graph:
        out = cls.__new__(cls)
        out.rows, out.leader, out.node_row, out.node_level = (state[x] for x in ("rows", "leader", "node_row", "node_level"))
        out.links = [state[f"links{i}"] for i in range(sum(x.startswith("links") for x in state))]
        out.n, out.join, out.points = len(out.node_row), join, out.rows[out.node_row].astype(np.float32)
        return out
