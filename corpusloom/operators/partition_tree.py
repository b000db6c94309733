"""Partition trees over bounded samples: which cells of space lie within a reach of a vector.

A tree parts space along the main axes of a sample. Each node takes the axis and median that leave the fewest of its sampled
points within reach of the cut, so data that vary in few directions are cut there again and again, and directions in which
they don't vary aren't cut at all. Where the sample thins out, a leaf goes on with one cut along each axis that its
path hasn't used. A cell is named by the turns taken (a leading 1, then a bit for each level).

Of the points of a cell the nearest to a vector is as far as the axes' own distances tell (their squares add up), so a vector's cells at a level
are those within reach. A vector in the middle of many cuts would have very many: it stays at a coarser level, the
deepest of every STEP levels with no more than `limit` cells. Who stays there is met by the others' cells at that level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP, LEAF, CROWDED, DEEPEST = 4, 16, 0.8, 40
#: What a listed row costs, in comparisons of a pair.
ROW_COST = 40


@dataclass
class Tree:
    axis: np.ndarray  # -1: no cut
    cut: np.ndarray
    low: np.ndarray  # the cell's bounds along that axis
    high: np.ndarray
    below: np.ndarray
    above: np.ndarray
    reach: float


def grown(places: np.ndarray, reach: float, depth: int) -> Tree:
    """A tree over sampled places (a line for each point, a column for each axis)."""
    nodes: list[list] = []
    n_axes = places.shape[1]
    middle = np.median(places, axis=0) if len(places) else np.zeros(n_axes)
    crowd = (np.abs(places - middle) < reach).mean(axis=0) if len(places) else np.ones(n_axes)
    last = [k for k in np.argsort(crowd, kind="stable").tolist() if crowd[k] <= CROWDED]

    def node(axis=-1, cut=0.0, low=-np.inf, high=np.inf) -> int:
        nodes.append([axis, cut, low, high, len(nodes), len(nodes)])
        return len(nodes) - 1

    def chain(axes: list[int]) -> int:
        first = node(axes[0], middle[axes[0]]) if axes else node()
        at = first
        for a in [*axes[1:], None]:
            if axes:
                after = node() if a is None else node(a, middle[a])
                nodes[at][4] = nodes[at][5] = at = after
        return first

    chains: dict[tuple, int] = {}
    open_ = [(None, 0, np.arange(len(places)), 0, np.full(n_axes, -np.inf), np.full(n_axes, np.inf))]
    root = None
    while open_:
        parent, side, own, level, low, high = open_.pop()
        at = None
        if len(own) >= LEAF and level < depth:
            some = places[own]
            cuts = np.median(some, axis=0)
            within = (np.abs(some - cuts) < reach).mean(axis=0)
            a = int(within.argmin())
            if within[a] <= CROWDED:
                at = node(a, cuts[a], low[a], high[a])
                right = some[:, a] >= cuts[a]
                for turn, part in ((4, own[~right]), (5, own[right])):
                    lo, hi = low.copy(), high.copy()
                    (hi if turn == 4 else lo)[a] = cuts[a]
                    open_.append((at, turn, part, level + 1, lo, hi))
        if at is None:
            rest = tuple(k for k in last if np.isinf(low[k]) and np.isinf(high[k])) if len(own) < LEAF else ()
            if rest not in chains:
                chains[rest] = chain(list(rest))
            at = chains[rest]
        if parent is None:
            root = at
        else:
            nodes[parent][side] = at
    order = [root, *(k for k in range(len(nodes)) if k != root)]
    place = np.empty(len(nodes), dtype=np.int64)
    place[order] = np.arange(len(nodes))
    columns = [np.array([nodes[k][c] for k in order]) for c in range(6)]
    return Tree(columns[0].astype(np.int64), columns[1].astype(float), columns[2].astype(float), columns[3].astype(float), place[columns[4].astype(np.int64)], place[columns[5].astype(np.int64)], reach)


def cells(tree: Tree, places: np.ndarray, depth: int, limit: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The level of each vector, and for each level (a multiple of STEP up to depth) the (owner, cell) of those that reach it."""
    n = len(places)
    owner, at, code, left = np.arange(n), np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64), np.full(n, tree.reach**2)
    level, found = np.zeros(n, dtype=np.int64), {0: (owner, code)}
    for d in range(1, depth + 1):
        axis, cut = tree.axis[at], tree.cut[at]
        x = places[owner, np.maximum(axis, 0)] if places.shape[1] else np.zeros(len(owner))
        under, over = np.maximum(tree.low[at] - x, 0), np.maximum(x - tree.high[at], 0)
        still = left + np.maximum(under, over) ** 2
        low, high = still - np.maximum(under, np.maximum(x - cut, 0)) ** 2, still - np.maximum(over, np.maximum(cut - x, 0)) ** 2
        low, high = np.where(axis < 0, left, low), np.where(axis < 0, -1.0, high)
        a, b = np.flatnonzero(low >= 0), np.flatnonzero(high >= 0)
        owner, left = np.concatenate([owner[a], owner[b]]), np.concatenate([low[a], high[b]])
        code = np.concatenate([code[a] << 1, code[b] << 1 | 1])
        at = np.concatenate([tree.below[at[a]], tree.above[at[b]]])
        if d % STEP == 0:
            fits = np.bincount(owner, minlength=n) <= limit
            level[np.unique(owner[fits[owner]])] = d
            keep = fits[owner]
            owner, at, code, left = owner[keep], at[keep], code[keep], left[keep]
            found[d] = (owner, code)
    return level, found


@dataclass
class Plan:
    axes: np.ndarray
    offsets: np.ndarray
    trees: list[Tree]  # one for each group of axes: the g-th takes every len(trees)-th axis
    depth: int
    limit: int

    def places(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.axes.T - self.offsets

    def of_group(self, places: np.ndarray, g: int) -> np.ndarray:
        return places[:, g :: len(self.trees)]


def costs(level: np.ndarray, found: dict, depth: int, scale: float) -> tuple[float, float]:
    """Rows a vector and pairs in all, if n = scale * len(level) vectors like these are listed down to a depth."""
    mine, rows, pairs = np.minimum(level, depth), 0, 0.0
    for s in np.unique(mine):
        owner, code = found[s]
        _, place = np.unique(code, return_inverse=True)
        own, guest = (np.bincount(place[keep], minlength=place.max(initial=-1) + 1).astype(float) for keep in (mine[owner] == s, mine[owner] > s))
        rows += own.sum() + guest.sum()
        pairs += (own * own / 2 + own * guest).sum() * scale * scale
    return rows / max(len(level), 1), pairs


def plan(sample: np.ndarray, n: int, reach: float, limit: int = 192, groups: tuple[int, ...] = (1, 2, 4), probes: int = 1_000) -> Plan:
    """The number of groups and the depth that cost least for n vectors like those sampled. If two points are no farther than
    2 * reach from each other, their midpoint is within reach of both; over some of g groups of axes it is within
    reach / sqrt(g). So both are listed under its cell in that group's tree."""
    mean = sample.mean(axis=0)
    spread, axes = np.linalg.eigh((sample - mean).T @ (sample - mean) / max(len(sample), 1))
    held = np.flatnonzero(spread > max(spread.max(), 0) * 1e-12)[::-1]
    axes = axes[:, held].T
    places = (sample - mean) @ axes.T
    deepest = min(DEEPEST, -(-(n.bit_length() + 7) // STEP) * STEP)
    best = None
    for g in [g for g in groups if g <= max(1, len(held))]:
        trees = [grown(places[:, k::g], reach / g**0.5, deepest) for k in range(g)]
        tried = [cells(t, places[:probes, k::g], deepest, limit // g) for k, t in enumerate(trees)]
        for depth in range(STEP, deepest + 1, STEP):
            found = [costs(*x, depth, n / max(1, min(probes, len(places)))) for x in tried]
            rows, pairs = sum(x[0] for x in found), sum(x[1] for x in found)
            cost = rows * n * ROW_COST + pairs
            if rows <= limit and (best is None or cost < best[0]):
                best = cost, Plan(axes, axes @ mean, trees, depth, limit // g)
    return best[1]
