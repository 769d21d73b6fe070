"""Sampling from weights in constant time, and walks over a graph by it."""

from __future__ import annotations

import numpy as np


def alias_table(weights: list[float]) -> tuple[list[float], list[int]]:
    """For each entry the share it keeps of its 1/n and the entry that gets the rest.

    Entries below 1/n are filled up by those above it; an entry with nothing to
    give keeps its whole share and alias 0.
    """
    n, total = len(weights), float(sum(weights))
    share = [w / total for w in weights]
    keep, alias, left = [1.0 / n] * n, [0] * n, list(share)
    small, large = [i for i, s in enumerate(left) if s < 1.0 / n], [i for i, s in enumerate(left) if s >= 1.0 / n]
    while small and large:
        i, j = small.pop(), large[-1]
        keep[i], alias[i] = left[i], j
        left[j] -= 1.0 / n - left[i]
        if left[j] < 1.0 / n - 1e-12:
            small.append(large.pop())
    return keep, alias


def draw(keep: list[float], alias: list[int], rng: np.random.Generator, size: int) -> np.ndarray:
    n = len(keep)
    at = rng.integers(0, n, size)
    own = rng.random(size) < np.array(keep)[at] * n
    return np.where(own, at, np.array(alias)[at])


class Walker:
    """Alias tables of a directed graph's nodes in flat arrays: a step of any number of walks is one lookup."""

    def __init__(self, u: np.ndarray, v: np.ndarray, total: np.ndarray, n: int):
        order = np.lexsort((v, u))
        self.u, self.v, self.w = u[order], v[order], total[order].astype(float)
        self.first = np.searchsorted(self.u, np.arange(n + 1))
        self.keep, self.alias = np.zeros(len(self.u)), np.zeros(len(self.u), np.int64)
        for i in np.unique(self.u):
            a, b = self.first[i], self.first[i + 1]
            keep, alias = alias_table(self.w[a:b].tolist())
            self.keep[a:b], self.alias[a:b] = np.array(keep) * (b - a), np.array(alias) + a

    def walk(self, start: np.ndarray, rng: np.random.Generator, length: int = 20, stop: float = 0.15) -> np.ndarray:
        """One row of nodes per start, filled up with -1: a walk ends with probability ``stop`` at each node, where nothing follows, or at ``length``."""
        out = np.full((len(start), length), -1, np.int64)
        live, at = np.arange(len(start)), start.astype(np.int64)
        for k in range(length):
            out[live, k] = at
            go = (rng.random(len(at)) >= stop) & (self.first[at + 1] > self.first[at])
            live, at = live[go], at[go]
            if not len(at):
                break
            slot = self.first[at] + (rng.random(len(at)) * (self.first[at + 1] - self.first[at])).astype(np.int64)
            at = self.v[np.where(rng.random(len(at)) < self.keep[slot], slot, self.alias[slot])]
        return out


def sample_walks(u: np.ndarray, v: np.ndarray, total: np.ndarray, n: int, walks: int = 4, length: int = 20, stop: float = 0.15, seed: int = 1) -> np.ndarray:
    """Visits of each node by ``walks`` walks from every node, whose next node is drawn from the alias table of the one before."""
    found = Walker(u, v, total, n).walk(np.repeat(np.arange(n), walks), np.random.default_rng(seed), length, stop)
    return np.bincount(found[found >= 0], minlength=n).astype(float)


class WalkStore:
    """Walks of a graph that changes: only those that a change can touch are walked again.

    Nodes have names. At an update the nodes at an edge that was added, dropped
    or changed its weight are affected; walks that visit one are walked again
    from their start, those whose start is gone are dropped, and every new node
    starts ``walks`` new ones. Walking again from the start makes affected nodes
    rarer than they should be, since walks that missed them stay; with ``from_there``
    a walk keeps its way up to the first affected node, which has no such bias.
    """

    def __init__(self, walks: int = 4, length: int = 20, stop: float = 0.15, seed: int = 1, from_there: bool = False):
        self.walks, self.length, self.stop, self.rng, self.from_there = walks, length, stop, np.random.default_rng(seed), from_there
        self.names: list[str] = []
        self.edges: dict[tuple[str, str], float] = {}
        self.store = np.empty((0, length), np.int64)
        self.rewalked = self.new = 0

    def update(self, nodes: list[str], edges: dict[tuple[str, str], float]) -> None:
        names = sorted(nodes)
        at = {t: i for i, t in enumerate(names)}
        changed = {t for e in self.edges.keys() | edges.keys() if self.edges.get(e) != edges.get(e) for t in e}
        known = set(self.names)
        # Numbers of the graph before become those of the graph now; nodes that are gone become -2.
        move = np.array([at.get(t, -2) for t in self.names] + [-1], np.int64)
        old = move[self.store] if len(self.store) else self.store
        old = old[old[:, 0] >= 0] if len(old) else old
        hit = np.zeros(len(names) + 2, bool)
        hit[[at[t] for t in changed if t in at]] = True
        hit[-2] = True
        touched = hit[old].any(axis=1) if len(old) else np.zeros(0, bool)
        walker = Walker(np.array([at[a] for a, _ in edges], np.int64), np.array([at[b] for _, b in edges], np.int64), np.array(list(edges.values()), float), len(names))
        fresh = np.repeat(np.array([at[t] for t in names if t not in known], np.int64), self.walks)
        again = old[touched] if len(old) else np.empty((0, self.length), np.int64)
        kept = (hit[again].argmax(axis=1) if self.from_there else np.zeros(len(again), np.int64)) if len(again) else np.zeros(0, np.int64)
        # A node that is gone has no way on: the walk goes on from the node before it.
        kept = np.maximum(0, np.where(again[np.arange(len(again)), kept] < 0, kept - 1, kept)) if len(again) else kept
        starts = np.r_[again[np.arange(len(again)), kept], fresh].astype(np.int64)
        self.rewalked, self.new = len(again), len(fresh)
        walked = walker.walk(starts, self.rng, self.length, self.stop)
        for k in np.unique(kept[kept > 0]):
            own = np.flatnonzero(kept == k)
            walked[own] = np.hstack([again[own, :k], walked[own, : self.length - k]])
        self.store = np.vstack([old[~touched] if len(old) else np.empty((0, self.length), np.int64), walked])
        self.names, self.edges = names, edges

    def shares(self) -> np.ndarray:
        """Each node's share of all visits."""
        visits = np.bincount(self.store[self.store >= 0], minlength=len(self.names)).astype(float)
        return visits / max(1.0, visits.sum())
