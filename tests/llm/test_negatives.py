"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import negatives


def plain(rows, is_anchor):
    """(anchor, positive, rank, negative, scores) by all scores. rows: (id, label, vector)."""
    own = [(i, y, [math.floor(256 * float(np.float64(x))) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for at, (a, label, v) in enumerate(own):
        if a is None or not is_anchor(a):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), last(i), k) for k, (i, _, w) in enumerate(own)))
        same = [(own[k][0], -s) for s, _, k in scored if own[k][1] == label and k != at][:5]
        for p, ps in same:
            below = [(own[k][0], -s) for s, _, k in scored if own[k][1] != label and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, n + 1, i, ps, s) for n, (i, s) in enumerate(below)]
    return sorted(map(str, out))


def mined(frame, every=5):
    found = negatives.mined(negatives.prepared(frame, "vec_id", F.col("label"), "embedding", F.col("vec_id") % every == 0))
    return sorted(str(tuple(r)) for r in found.collect())


def clustered(n, centres, noise, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 8))
    return [(i, int(i * 7 % 4), (middle[i % centres] + noise * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("centres, noise", [(3, 0.05), (40, 0.3), (400, 1.0)])
def test_equals_brute_force(spark, centres, noise):
    rows = clustered(400, centres, noise, 3)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert mined(frame) == plain(rows, lambda i: i % 5 == 0)


def test_bounds_save_scores():
    """Of anchors close to each other, few pairs are scored, and none that is wanted is lost."""
    rng = np.random.default_rng(1)
    anchors = np.floor(256 * (rng.normal(size=16) + 0.01 * rng.normal(size=(60, 16))))
    rows = np.floor(256 * rng.normal(size=(500, 16)))
    whole = anchors @ rows.T
    parent, edge = negatives.spanning_tree(anchors)
    assert sorted(np.concatenate(negatives.levels(parent)).tolist()) == list(range(60))
    least = np.quantile(whole, 0.98)
    found = [(int(a), int(b), float(s)) for x in negatives.scores(anchors, parent, edge, rows, lambda level, low, high: high >= least) for a, b, s in zip(*x)]
    assert {(a, b) for a, b, _ in found} >= {(a, b) for a, b in zip(*np.nonzero(whole >= least))} and all(whole[a, b] == s for a, b, s in found)
    assert len(found) < 0.15 * whole.size


def test_spanning_tree_is_least():
    points = np.random.default_rng(2).normal(size=(40, 3))
    parent, edge = negatives.spanning_tree(points)
    gaps = sorted((float(np.linalg.norm(points[a] - points[b])), a, b) for a in range(40) for b in range(a))
    group, total = list(range(40)), 0.0
    for g, a, b in gaps:  # Kruskal
        if group[a] != group[b]:
            total += g
            group = [group[a] if x == group[b] else x for x in group]
    assert abs(edge.sum() - total) < 1e-9 and parent[0] == 0


def test_awkward(spark):
    """Nulls anywhere, ties, equal rows, one vector that most rows share, odd lengths, large numbers and clashing names."""
    rng = random.Random(4)
    same = [0.5, -0.25, 1.0]
    rows = [(i, i % 3, same) for i in range(60)] + [(i, i % 2, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(60, 120)]
    rows += [(None, 1, same), (200, None, same), (205, 1, None), (210, 1, [None, 1.0, 1.0]), (215, 1, [float("nan"), 1.0, 1.0]), (220, 1, [float("inf"), 1.0, 1.0])]
    rows += [(225, 0, []), (230, 2, [1.0]), (235, 2, [1.0, 1.0, 1.0, 1.0]), (60, 0, rows[60][2]), (60, 0, rows[60][2]), (240, 1, [3e6, 2e6, 1e6]), (245, 1, [3e6, 2e6, 1e6]), (246, 0, [2e6, 2e6, 1e6])]
    names = ["rid", "id", "vec", "is_anchor", "part", "kind", "block", "score", "place", "dotted.name"]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").select("*", *(F.lit("x").alias(c) for c in names))
    assert mined(frame) == plain(rows, lambda i: i % 5 == 0)
    assert mined(frame.filter("false")) == [] and mined(frame.filter("vec_id = 60")) == []
