"""Scans and the replay of one hot key over many cells and blocks, against plain Python."""

import random
import re
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import experiments, ratelimit, similarity


@pytest.mark.parametrize("cells", [1, 2, 100])
def test_longest_run(spark, cells):
    rng = random.Random(cells)
    rows = [("hot", k, rng.random() < 0.8) for k in range(2_000)] + [(f"k{k % 30}", k, bool(k % 3)) for k in range(120)] + [("all", k, True) for k in range(300)] + [("none", k, None) for k in range(50)]
    got = similarity.longest_run(spark.createDataFrame(rows, "k string, o int, hit boolean"), ["k"], "o", F.col("hit"), cells)
    found = {r["k"]: (r["longest"], r["leading"]) for r in got.collect()}
    for key, own in groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
        runs = [(hit, len(list(g))) for hit, g in groupby(bool(r[2]) for r in own)]
        assert found[key] == (max([n for hit, n in runs if hit], default=0), runs[0][1] if runs[0][0] else 0)


@pytest.mark.parametrize("cells", [1, 3, 100])
def test_running(spark, cells):
    rng = random.Random(cells)
    rows = [(None if k % 7 == 0 else f"k{min(k % 40, 3)}", k, None if rng.random() < 0.4 else float(rng.randrange(1_000)), k) for k in range(2_000)]
    got = experiments.running(spark.createDataFrame(rows, "k string, o int, v double, n int"), "k", ["o"], "v", cells)
    assert got.columns == ["k", "o", "v", "n", "peak", "latest"]
    found = {r["n"]: (r["peak"], r["latest"]) for r in got.collect()}
    state = {}
    for k, o, v, n in rows:
        peak, latest = state.get(k, (None, None))
        if v is not None:
            peak, latest = max(v, -1.0 if peak is None else peak), v
        state[k] = (peak, latest)
        assert found[n] == (peak, latest)


def test_no_window_by_the_key_alone(spark):
    rows = spark.range(1_000).select(F.lit("k").alias("k"), "id", F.col("id").cast("double").alias("v"))
    for frame in (similarity.longest_run(rows, ["k"], "id", F.col("v") > 3), experiments.running(rows, "k", ["id"], "v")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        big = [w for w in re.findall(r"Window \[(.*?)\]\n", plan) if "__n" in w or "peak" in w]
        assert all("__cell" in w for w in big)


def plain(times, per_minute, daily):
    state, out = ratelimit.Admitted(), []
    for t in times:
        state, ok = ratelimit.admit(state, t, per_minute, daily)
        out.append(ok)
    return state, out


@pytest.mark.parametrize("gap, per_minute, daily", [(1, 3, 10_000), (5, 1, 40), (20, 2, 10_000), (30, 4, 7), (900, 2, 20), (40_000, 1, 1), (10, 0, 5), (10, 5, 0)])
def test_leaps_equal_steps(gap, per_minute, daily):
    rng = random.Random(gap)
    times, t = [], 0
    for _ in range(3_000):
        t += rng.choice([0, 0, rng.randrange(2 * gap + 1)]) * 1_000_000 + rng.choice([0, 1, 60_000_000 if gap < 50 and rng.random() < 0.02 else 0])
        times.append(t)
    want, ok = plain(times, per_minute, daily)
    for block in (3_000, 30):
        state, found = ratelimit.Admitted(), []
        for at in range(0, len(times), block):
            state, some = ratelimit.leaps(state, np.array(times[at : at + block], dtype=np.int64), per_minute, daily)
            found += [at + k for k in some]
        assert found == [k for k, x in enumerate(ok) if x]


def test_one_hot_client_in_a_hundred_blocks(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randrange(400_000) * 1_000_000, k) for k in range(4_000)]
    rows += [("hot", None, 5_000), (None, None, 5_001)]
    log = spark.createDataFrame(rows, "client string, us long, event_id int").select("client", F.timestamp_micros("us").alias("ts"), "event_id", F.lit("x").alias("block"))
    got = experiments.admitted_requests(log.repartition(5), "client", "ts", 2, 60, block=28)
    assert got.columns == [*log.columns, "accepted"]
    found = {r["event_id"]: r["accepted"] for r in got.collect()}
    assert len(found) == len(rows) and not found[5_000] and not found[5_001]
    for who in ("hot", "a", "b", None):
        own = sorted((us, n) for c, us, n in rows if c == who and us is not None)
        assert [found[n] for _, n in own] == plain([us for us, _ in own], 2, 60)[1]
    assert experiments.admitted_requests(log.filter("false"), "client", "ts", 2, 60).count() == 0


def test_many_short_needles(spark):
    """100,000 needles of one word, in shards, against brute force; no nested-loop join."""
    from corpusloom.operators import joins

    rng = random.Random(8)
    docs = [(i, " ".join(f"w{rng.randrange(200_000)}" for _ in range(30))) for i in range(40)] + [(98, None), (99, "")]
    needles = [(n, f"w{n}") for n in range(100_000)] + [(200_000, ""), (200_001, None), (200_002, "w17"), (200_003, " w5")]
    t, n = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(needles, "n int, needle string")
    known = {x: [] for _, x in needles}
    for k, x in needles:
        known[x].append(k)
    want = set()
    for i, text in docs:
        if text is not None:
            cuts = {text[a:b] for a in range(len(text) + 1) for b in range(a, min(len(text), a + 8) + 1)}
            want |= {(i, k) for c in cuts if c in known for k in known[c]}
    for few in (1_000_000, 40_000):
        found = joins.containing(t, n, "id", "text", "n", "needle", few=few)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
