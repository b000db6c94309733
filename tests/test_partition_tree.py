"""Cells of partition trees: no close pair is lost, whatever the spectrum, and few rows are listed."""

import numpy as np
import pytest

from corpusloom.operators import partition_tree, similarity

REACH = (np.sqrt(2 - 2 * 0.985) + 0.0005) / 2


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def of_rank(n, rank, dim, seed=0):
    rng = np.random.default_rng(seed)
    return unit(rng.normal(size=(n, rank)) @ rng.normal(size=(rank, dim)) if rank < dim else rng.normal(size=(n, dim)))


def with_mean(x):
    x = x.copy()
    x[7] = x.mean(axis=0)
    return unit(x)


def meeting(x, plan):
    """(rows a vector, which pairs meet)."""
    places, share, rows = plan.places(x), np.zeros((len(x), len(x)), bool), 0
    for g, tree in enumerate(plan.trees):
        level, found = partition_tree.cells(tree, plan.of_group(places, g), plan.depth, plan.limit)
        for s in np.unique(level):
            owner, cell = found[s]
            rows += len(owner)
            for c in np.unique(cell):
                here = owner[cell == c]
                share[np.ix_(here[level[here] == s], here)] = True
    return rows / len(x), share | share.T


@pytest.mark.parametrize("x", [of_rank(1_500, 64, 64), of_rank(1_500, 30, 64), of_rank(1_500, 10, 64), of_rank(1_500, 5, 64), of_rank(1_500, 3, 64), of_rank(1_500, 3, 12), with_mean(np.abs(of_rank(1_500, 64, 64))), with_mean(of_rank(1_500, 5, 64) + 0.5)], ids="random 30 10 5 3 3of12 mean lowmean".split())
def test_any_spectrum(x):
    """For a table of a million vectors like these, planned from a sample."""
    near = x @ x.T >= 0.985
    for n in (len(x), 1_000_000):
        plan = partition_tree.plan(x, n, REACH)
        rows, share = meeting(x, plan)
        assert rows < 200 and not (near & ~share).any()
    assert share.mean() < max(0.6, 4 * near.mean())


def test_close_pairs_beyond_the_sample():
    """Vectors that the sample doesn't resemble meet too."""
    rng = np.random.default_rng(2)
    plan = partition_tree.plan(of_rank(500, 3, 12), 100_000, REACH)
    x = rng.normal(size=(400, 12))
    step = rng.normal(size=x.shape)
    y = x + unit(step) * rng.uniform(0, 2 * REACH, (400, 1))
    _, share = meeting(np.concatenate([x, y]), plan)
    assert share[np.arange(400), np.arange(400, 800)].all()


def test_a_vector_in_the_middle_stays_coarse():
    """It is listed under few cells of a coarser level, where all others are guests."""
    x = of_rank(2_000, 64, 64)
    x[3] = 1e-6
    plan = partition_tree.plan(x, 10_000_000, REACH)
    places = plan.places(x)
    for g, tree in enumerate(plan.trees):
        level, found = partition_tree.cells(tree, plan.of_group(places, g), plan.depth, plan.limit)
        assert level[3] < level.max() and all((found[s][0] == 3).sum() <= plan.limit for s in found if s <= level[3])


@pytest.mark.parametrize("x", [np.tile(of_rank(1, 5, 5), (50, 1)), of_rank(1, 4, 4), np.eye(6)])
def test_degenerate_samples(x):
    plan = partition_tree.plan(x, 10_000, REACH)
    rows, share = meeting(x, plan)
    assert rows < 200 and not ((x @ x.T >= 0.985) & ~share).any()


def test_near_windows_of_few_directions(spark):
    x = np.concatenate([of_rank(150, 3, 20, 1), with_mean(of_rank(150, 4, 20, 2))])
    frame = lambda key, place: spark.createDataFrame([("c", i, v.tolist()) for i, v in enumerate(x)], f"{key} string, {place} int, vec array<double>")
    got = {(r["i"], r["j"]) for r in similarity.near_windows(frame("candidate", "i"), frame("item", "j"), 20).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.985))}
