"""Hard-negative mining: for each anchor and each of its positives, the best rows of another label below the positive.

Vectors become integers and scores are integer inner products, so every comparison is exact. Anchors are dealt into blocks of
about ANCHORS, and each block's anchors form a minimum spanning tree by their distances. For a candidate v and anchors p and c
joined by an edge, <c, v> is <p, v> plus or minus |c - p| |v| at most. So scores at the root bound those at its children, these
bound theirs, and so on; a candidate is scored at an anchor only if its bounds overlap what is asked for there. The first pass asks for what
may be among the first positives, the second for what lies in the window below a positive and may be among its first
negatives; both limits rise while candidates are read.

Candidates are dealt evenly, whatever their labels and vectors, into parts of PART rows; each part meets every block of anchors
once (blocks are what is copied, candidates are shuffled once a pass) and gives a few rows for each anchor. A task holds a
part and one block at a time. Nothing goes through the driver but two counts.

Defined cases: rows with a null label or vector, or a component that is null or not finite, take no part; vectors of several
lengths are filled up with zeros; equal rows are rows of their own, so a repeated anchor has a repeated result, and one is the other's
positive; ties go by id, a row without one last (ids are longs below 2^63 - 1); a positive with a negative score has no negatives.
Scores beyond a long aren't defined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cell, named, written

ANCHORS, PART, CHUNK, NO_ID = 2_048, 131_072, 1_024, (1 << 63) - 1
#: Above this share of pairs to be scored a whole product is cheaper than single ones.
DENSE = 0.15


def prepared(rows: DataFrame, key: str, label: Column, vector: str, anchor: Column) -> DataFrame:
    """A written table of what takes part: rid (names the row), id, label, vec (longs) and is_anchor."""
    vec, own = named(vector), F.coalesce(named(key), F.lit(NO_ID)).cast("long")
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    some = rows.filter(vec.isNotNull() & label.isNotNull() & F.coalesce(finite, F.lit(False)))
    ints = F.transform(vec, lambda x: F.floor(x.cast("double") * 256))
    return written(some.select(F.monotonically_increasing_id().alias("rid"), own.alias("id"), label.cast("long").alias("label"), ints.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("is_anchor")), "negatives-rows")


def filled(vectors, width: int | None = None) -> np.ndarray:
    """The vectors as lines of a matrix whose products are exact: float64 where they stay below 2^53."""
    vectors = [np.asarray(v, dtype=np.int64) for v in vectors]
    width = max([width or 0, *map(len, vectors)])
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for line, v in zip(out, vectors):
        line[: len(v)] = v
    most = float(np.abs(out.astype(np.float64)).max(initial=0))
    return out.astype(np.float64 if most * most * max(width, 1) < 2**51 else np.longdouble)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, length of the edge to it) of each point in a minimum spanning tree; the root, point 0, is its own parent."""
    n = len(points)
    squares = (points * points).sum(axis=1)
    parent, near = np.zeros(n, dtype=np.int64), np.full(n, np.inf)
    edge, left, at = np.zeros(n), np.ones(n, dtype=bool), 0
    left[0] = False
    for _ in range(n - 1):
        gap = np.maximum(squares + squares[at] - 2 * (points @ points[at]), 0)
        nearer = left & (gap < near)
        near[nearer], parent[nearer] = gap[nearer], at
        at = int(np.argmin(np.where(left, near, np.inf)))
        left[at] = False
        edge[at] = np.sqrt(float(((points[at] - points[parent[at]]) ** 2).sum()))
    return parent, edge


def levels(parent: np.ndarray) -> list[np.ndarray]:
    depth = np.full(len(parent), -1)
    depth[:1] = 0
    while (depth < 0).any():
        depth = np.where((depth < 0) & (depth[parent] >= 0), depth[parent] + 1, depth)
    return [np.flatnonzero(depth == k) for k in range(depth.max(initial=-1) + 1)]


def scores(anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, rows: np.ndarray, wanted):
    """(anchors' places, rows' places, scores) of all pairs that `wanted(level, low, high)` finds by bounds, level by level."""
    norms = np.sqrt((rows * rows).sum(axis=1).astype(np.float64)) * (1 + 1e-12)
    low = np.empty((len(anchors), len(rows)), dtype=rows.dtype)
    high = np.empty_like(low)
    for k, level in enumerate(levels(parent)):
        if k:
            reach = (edge[level] * (1 + 1e-12))[:, None] * norms[None, :] + 0.5  # more than rounding takes
            below, above = low[parent[level]] - reach, high[parent[level]] + reach
        else:
            below, above = np.full((len(level), len(rows)), -np.inf, dtype=rows.dtype), np.full((len(level), len(rows)), np.inf, dtype=rows.dtype)
        hit = wanted(level, below, above)
        share = hit.mean() if hit.size else 0.0
        if not k or share > DENSE:
            below = above = anchors[level] @ rows.T
            a, b = np.nonzero(hit)
            yield level[a], b, below[a, b]
        elif share:
            a, b = np.nonzero(hit)
            found = np.empty(len(a), dtype=rows.dtype)
            for at in range(0, len(a), 1 << 16):
                x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                found[at : at + (1 << 16)] = (anchors[level[x]] * rows[y]).sum(axis=1)
            below[a, b] = above[a, b] = found
            yield level[a], b, found
        low[level], high[level] = below, above


class Firsts:
    """The first n rows of each of several lists, by score, id and rid, while rows are added."""

    def __init__(self, lists: int, n: int, floor: np.ndarray, dtype):
        self.n, self.least = n, floor.astype(dtype)  # the score that a row must reach
        self.held = (np.zeros(0, np.int64), np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, where: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        if not len(where):
            return
        where, score, ids, rids = (np.concatenate([h, x]) for h, x in zip(self.held, (where, score, ids, rids)))
        order = np.lexsort((rids, ids, -score, where))
        where = where[order]
        rank = np.arange(len(where)) - np.searchsorted(where, where)
        order = order[rank < self.n]
        last = rank == self.n - 1
        self.held = (where[rank < self.n], score[order], ids[order], rids[order])
        self.least[where[last]] = np.maximum(self.least[where[last]], self.held[1][rank[rank < self.n] == self.n - 1])


@dataclass
class Block:
    rids: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    windows: list


def _pack(f):
    """One row: a block's anchors and their tree."""
    import pandas as pd

    f = f.sort_values("rid")
    vecs = filled(f["vec"])
    parent, edge = spanning_tree(vecs.astype(np.float64))
    row = {"block": int(f["block"].iloc[0]), "rids": f["rid"].tolist(), "ids": f["id"].tolist(), "labels": f["label"].tolist(), "vecs": [list(v) for v in f["vec"]], "parent": parent.tolist(), "edge": edge.tolist()}
    return pd.DataFrame([row])


PACKED = "block int, rids array<long>, ids array<long>, labels array<long>, vecs array<array<long>>, parent array<int>, edge array<double>"


def _parts(batches, found):
    """Calls found(rows, block) for each block of anchors that follows a part's rows."""
    import pyarrow as pa

    at, rows, whole = None, [], None
    for b in batches:
        for part, kind, rids, ids, labels, vecs, parent, edge, windows in zip(*(c.to_pylist() for c in b.columns)):
            if part != at:
                at, rows, whole = part, [], None
            if not kind:
                rows.append((rids[0], ids[0], labels[0], np.array(vecs[0], dtype=np.int64)))
                continue
            if not rows:
                continue
            if whole is None:
                order = sorted(range(len(rows)), key=lambda i: rows[i][0])
                whole = tuple(np.array([rows[i][c] for i in order], dtype=np.int64) for c in range(3)), [rows[i][3] for i in order]
                rows = [None]
                matrix = filled(whole[1])
            vectors = filled(vecs, matrix.shape[1])
            if vectors.shape[1] > matrix.shape[1]:
                matrix = filled(whole[1], vectors.shape[1])
            kind_ = np.result_type(vectors, matrix)
            block = Block(np.array(rids), np.array(ids), np.array(labels), vectors.astype(kind_, copy=False), np.array(parent, dtype=np.int64), np.array(edge), windows)
            out = found(*whole[0], matrix.astype(kind_, copy=False), block)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out.values()], names=list(out))


def _chunks(n: int):
    """Small chunks first, so that later ones meet limits that are near their end."""
    at, size = 0, CHUNK // 16
    while at < n:
        yield slice(at, at + size)
        at, size = at + size, min(2 * size, CHUNK)


def _positives(n: int):
    def of(rids, ids, labels, matrix, block) -> dict:
        firsts = Firsts(len(block.rids), n, np.full(len(block.rids), -np.inf), matrix.dtype)
        for cut in _chunks(len(rids)):

            def wanted(level, low, high):
                return (block.labels[level][:, None] == labels[cut][None, :]) & (block.rids[level][:, None] != rids[cut][None, :]) & (high >= firsts.least[level][:, None])

            a, b, s = (np.concatenate(x) for x in zip(*scores(block.vecs, block.parent, block.edge, matrix[cut], wanted)))
            firsts.add(a, s, ids[cut][b], rids[cut][b])
        where, score, ids_, rids_ = firsts.held
        return {"anchor": block.rids[where], "score": score.astype(np.int64), "id": ids_, "rid": rids_}

    return lambda batches: _parts(batches, of)


def _negatives(n: int, low_percent: int, high_percent: int):
    def of(rids, ids, labels, matrix, block) -> dict:
        width = max([1, *map(len, block.windows)])
        low, high = (np.full((len(block.rids), width), f, dtype=matrix.dtype) for f in (np.inf, -np.inf))
        for k, positives in enumerate(block.windows):
            for w, s in enumerate(positives):
                low[k, w], high[k, w] = -(-low_percent * s // 100), high_percent * s // 100
        top = high.max(axis=1)
        firsts = Firsts(low.size, n, low.ravel(), matrix.dtype)
        for cut in _chunks(len(rids)):
            least = np.where(low <= high, firsts.least.reshape(low.shape), np.inf).min(axis=1)

            def wanted(level, below, above):
                return (block.labels[level][:, None] != labels[cut][None, :]) & (above >= least[level][:, None]) & (below <= top[level][:, None])

            a, b, s = (np.concatenate(x) for x in zip(*scores(block.vecs, block.parent, block.edge, matrix[cut], wanted)))
            fits = [np.flatnonzero((s >= firsts.least[a * width + w]) & (s <= high[a, w])) for w in range(width)]
            where, at = np.concatenate([a[f] * width + w for w, f in enumerate(fits)]), np.concatenate(fits)
            firsts.add(where, s[at], ids[cut][b[at]], rids[cut][b[at]])
        where, score, ids_, rids_ = firsts.held
        return {"anchor": block.rids[where // width], "place": where % width + 1, "score": score.astype(np.int64), "id": ids_, "rid": rids_}

    return lambda batches: _parts(batches, of)


def _dealt(rows: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """Each part's rows, and behind them every block of anchors."""
    one = lambda c: F.array(F.col(c))
    mine = rows.select(cell(parts, "rid").alias("part"), F.lit(0).alias("kind"), one("rid").alias("rids"), one("id").alias("ids"), one("label").alias("labels"), one("vec").alias("vecs"), *(F.lit(None).cast(t).alias(c) for c, t in (("parent", "array<int>"), ("edge", "array<double>"), ("windows", "array<array<long>>"))))
    theirs = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "rids", "ids", "labels", "vecs", "parent", "edge", "windows")
    return mine.unionByName(theirs).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")


def mined(rows: DataFrame, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: from `prepared`. An anchor's positives are
    the first `positives` other rows of its label; of the rows of other labels whose score is at least low_percent and at most
    high_percent of the positive's, the first `negatives` are returned."""
    total, anchors = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-total // PART), min(-(-total // CHUNK), 2 * parallel), 1)
    own = rows.filter("is_anchor").withColumn("block", cell(max(1, -(-anchors // ANCHORS)), F.lit("block"), "rid"))
    blocks = written(own.select("block", "rid", "id", "label", "vec").groupBy("block").applyInPandas(_pack, PACKED), "negatives-anchors")

    none = blocks.withColumn("windows", F.transform("rids", lambda r: F.array().cast("array<long>")))
    near = _dealt(rows, none, parts).mapInArrow(_positives(positives), "anchor long, score long, id long, rid long")
    first = lambda keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "rid")
    found = written(near.withColumn("place", F.row_number().over(first(["anchor"]))).filter(F.col("place") <= positives), "negatives-positives")

    listed = found.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    each = blocks.select("block", F.posexplode("rids").alias("at", "anchor")).join(listed, "anchor", "left")
    windows = each.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "scores"))), lambda x: F.coalesce(x["scores"], F.array().cast("array<long>"))).alias("windows"))
    below = _dealt(rows, blocks.join(windows, "block"), parts).mapInArrow(_negatives(negatives, low_percent, high_percent), "anchor long, place long, score long, id long, rid long")
    best = below.withColumn("rank", F.row_number().over(first(["anchor", "place"]))).filter(F.col("rank") <= negatives)

    shown = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    names = own.select(F.col("rid").alias("anchor"), shown("id").alias("anchor_id"))
    of = found.select("anchor", F.col("place").cast("long").alias("place"), shown("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.select("anchor", "place", "rank", shown("id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["anchor", "place"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
