"""Hierarchical navigable small-world graphs in numpy: batched insertion and batched beam search."""

from __future__ import annotations

import io
import math

import numpy as np


def _top(sims: np.ndarray, ids: np.ndarray, k: int, *more: np.ndarray):
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (sims, ids, *more))


class Hnsw:
    """Vectors are unit rows; similarity is the dot product. links[l][i] are the neighbours of i at level l, -1 empty."""

    def __init__(self, vectors: np.ndarray, degree: int = 16, build_beam: int = 48, seed: int = 7):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(self.x)
        self.degree = degree
        u = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / math.log(degree)).astype(int), 6)
        order = np.argsort(-self.level, kind="stable")  # upper levels first, so each batch finds the levels it needs
        top = int(self.level.max()) if n else 0
        self.links = [np.full((n, 2 * degree if l == 0 else degree), -1, dtype=np.int32) for l in range(top + 1)]
        self.entry = int(order[0]) if n else -1
        done = 0
        while done < n:
            size = min(max(done, 32), 512, n - done)
            self._insert(order[done : done + size], order[:done], build_beam)
            done += size

    def _choose(self, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Per row, neighbours in falling similarity that are nearer to the base than to those chosen; then the nearest rest."""
        b, c = ids.shape
        near = np.einsum("bcd,bed->bce", self.x[np.maximum(ids, 0)], self.x[np.maximum(ids, 0)])
        valid = (ids >= 0) & (ids != base[:, None])
        chosen = np.zeros((b, c), dtype=bool)
        count = np.zeros(b, dtype=int)
        for k in range(c):
            clash = (chosen & (near[:, k, :] > sims[:, k, None])).any(axis=1)
            ok = valid[:, k] & ~clash & (count < most)
            chosen[:, k] = ok
            count += ok
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.full((b, most), -1, dtype=np.int32)
        out[:, : order.shape[1]] = np.where(np.take_along_axis(valid, order, axis=1), np.take_along_axis(ids, order, axis=1), -1)
        return out

    def _insert(self, batch: np.ndarray, before: np.ndarray, beam: int) -> None:
        q = self.x[batch]
        entry = np.full(len(batch), self.entry, dtype=np.int32)
        inside = q @ q.T
        np.fill_diagonal(inside, -2)
        for l in range(len(self.links) - 1, -1, -1):
            here = self.level[batch] >= l
            if len(before):
                ids, sims = self._beam(q, entry[:, None], l, beam if here.any() else 1)
                entry = ids[:, 0]
            else:
                ids, sims = np.empty((len(batch), 0), dtype=np.int32), np.empty((len(batch), 0), dtype=np.float32)
            if not here.any():
                continue
            rows = np.flatnonzero(here)
            peers_s = np.where(here[None, :], inside[rows], -2)
            k = min(beam // 2, len(batch))
            peer = np.argsort(-peers_s, axis=1)[:, :k]
            peer_sim = np.take_along_axis(peers_s, peer, axis=1)
            peer_id = np.where(peer_sim > -2, batch[peer], -1).astype(np.int32)
            all_s, all_i = _top(np.concatenate([sims[rows], peer_sim], axis=1), np.concatenate([ids[rows], peer_id], axis=1), beam)
            new = self._choose(batch[rows], all_i, all_s, self.degree)
            self.links[l][batch[rows], : self.degree] = new
            self._back(l, np.repeat(batch[rows], new.shape[1]), new.ravel())

    def _back(self, l: int, source: np.ndarray, target: np.ndarray) -> None:
        """Add source to target's neighbours; a full list keeps a diverse choice."""
        table = self.links[l]
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        sims = np.einsum("nd,nd->n", self.x[source], self.x[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, counts)
        keep = rank < table.shape[1]
        added = np.full((len(nodes), min(int(counts.max()), table.shape[1])), -1, dtype=np.int32)
        added[np.repeat(np.arange(len(nodes)), counts)[keep], rank[keep]] = source[keep]
        for s in range(0, len(nodes), 256):
            part, own = nodes[s : s + 256], table[nodes[s : s + 256]]
            ids = np.concatenate([own, np.where((added[s : s + 256, :, None] == own[:, None, :]).any(axis=2), -1, added[s : s + 256])], axis=1)
            fits = (ids >= 0).sum(axis=1) <= table.shape[1]
            pushed = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), axis=1)[:, : table.shape[1]]
            table[part[fits]] = pushed[fits]
            if (~fits).any():
                rest = ids[~fits]
                sim = np.einsum("bcd,bd->bc", self.x[np.maximum(rest, 0)], self.x[part[~fits]])
                sim = np.where(rest >= 0, sim, -2)
                sim, rest = _top(sim, rest, rest.shape[1])
                table[part[~fits]] = self._choose(part[~fits], rest, sim, table.shape[1])

    def _beam(self, q: np.ndarray, start: np.ndarray, l: int, beam: int, width: int = 4):
        """(ids, similarities) of the `beam` best nodes found per query at level l, best first."""
        b, n = len(q), len(self.x)
        table = self.links[l]
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n), dtype=bool)
        ids = np.full((b, beam), -1, dtype=np.int32)
        sims = np.full((b, beam), -2, dtype=np.float32)
        k = min(start.shape[1], beam)
        ids[:, :k] = start[:, :k]
        sims[:, :k] = np.einsum("bkd,bd->bk", self.x[start[:, :k]], q)
        seen[rows, start[:, :k]] = True
        open_ = ids >= 0
        sims, ids, open_ = _top(sims, ids, beam, open_)
        live = np.arange(b)
        while len(live):
            at = np.argsort(~open_[live], axis=1, kind="stable")[:, : min(width, beam)]
            usable = np.take_along_axis(open_[live], at, axis=1)
            going = usable.any(axis=1)
            live, at, usable = live[going], at[going], usable[going]
            if not len(live):
                break
            open_[live[:, None], at] = False
            nodes = np.where(usable, ids[live[:, None], at], -1)
            found = np.where(nodes[:, :, None] >= 0, table[np.maximum(nodes, 0)], -1).reshape(len(live), -1)
            fresh = (found >= 0) & ~seen[live[:, None], np.maximum(found, 0)]
            found = np.where(fresh, found, -1)
            srt = np.sort(found, axis=1)
            srt[:, 1:][srt[:, 1:] == srt[:, :-1]] = -1  # the same node from two expanded ones
            wide = int((srt >= 0).sum(axis=1).max())
            if not wide:
                continue
            found = -np.sort(-srt, axis=1)[:, :wide]
            r, c = np.nonzero(found >= 0)
            seen[live[r], found[r, c]] = True
            s = np.where(found >= 0, np.einsum("bkd,bd->bk", self.x[np.maximum(found, 0)], q[live]), np.float32(-2))
            sims[live], ids[live], open_[live] = _top(
                np.concatenate([sims[live], s], axis=1), np.concatenate([ids[live], found], axis=1), beam, np.concatenate([open_[live], found >= 0], axis=1)
            )
        return ids, sims

    def search(self, q: np.ndarray, beam: int):
        """(ids, similarities), best first, -1 where fewer were found."""
        q = np.ascontiguousarray(q, dtype=np.float32)
        entry = np.full((len(q), 1), self.entry, dtype=np.int32)
        for l in range(len(self.links) - 1, 0, -1):
            entry = self._beam(q, entry, l, 1, 1)[0]
        return self._beam(q, entry, 0, min(beam, len(self.x)))

    def save(self) -> bytes:
        """The links, without the vectors. Upper levels hold the rows of their own nodes only."""
        out, parts = io.BytesIO(), {}
        for k, table in enumerate(self.links):
            nodes = np.flatnonzero(self.level >= k).astype(np.int32)
            parts |= {f"n{k}": nodes if k else nodes[:0], f"l{k}": table[nodes]}
        np.savez(out, level=self.level.astype(np.int8), entry=self.entry, **parts)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, vectors: np.ndarray) -> Hnsw:
        got, self = np.load(io.BytesIO(data)), cls.__new__(cls)
        self.x, self.level, self.entry = np.ascontiguousarray(vectors, dtype=np.float32), got["level"].astype(int), int(got["entry"])
        self.links = [got["l0"]]
        for k in range(1, sum(name[0] == "l" and name[1:].isdigit() for name in got.files)):
            table = np.full((len(self.x), got[f"l{k}"].shape[1]), -1, dtype=np.int32)
            table[got[f"n{k}"]] = got[f"l{k}"]
            self.links.append(table)
        self.degree = self.links[0].shape[1] // 2
        return self


def neighbours_above(graph: Hnsw, exact: np.ndarray, queries: np.ndarray, threshold: float, beam: int, chunk: int = 256):
    """(query, node) pairs with exact (double) similarity >= threshold; a full beam is widened until its worst is below."""
    out_q, out_n = [], []
    for s in range(0, len(queries), chunk):
        todo, wide = np.arange(s, min(s + chunk, len(queries))), beam
        while len(todo):
            ids, sims = graph.search(queries[todo], wide)
            last = (sims[:, -1] < threshold) | (wide >= len(graph.x))
            r, c = np.nonzero((ids >= 0) & (sims >= threshold - 1e-4) & last[:, None])
            if len(r):
                who, node = todo[r], ids[r, c]
                sure = np.einsum("nd,nd->n", queries[who], exact[node]) >= threshold
                out_q.append(who[sure])
                out_n.append(node[sure])
            todo, wide = todo[~last], wide * 2
    empty = np.empty(0, dtype=np.int64)
    return (np.concatenate(out_q), np.concatenate(out_n)) if out_q else (empty, empty)
