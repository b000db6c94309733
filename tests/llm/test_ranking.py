"""Pairwise ranking: its loss and fit by plain arithmetic, its threshold, and awkward tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries, ranking


def test_gradient_and_optimum():
    rng = np.random.default_rng(0)
    gaps = rng.normal(size=(300, 4)) + [0.5, 0, -0.3, 0]
    w = rng.normal(size=4)
    value, slope = ranking.loss(w, gaps, 0.01)
    plain = sum(math.log1p(math.exp(-float(g @ w))) for g in gaps) / len(gaps) + 0.005 * float(w @ w)
    assert abs(value - plain) < 1e-12
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        assert abs((ranking.loss(w + step, gaps, 0.01)[0] - ranking.loss(w - step, gaps, 0.01)[0]) / 2e-6 - slope[k]) < 1e-6
    best = ranking.learnt(gaps, 0.01)
    assert np.abs(ranking.loss(best, gaps, 0.01)[1]).max() < 1e-6


def test_pairs_meet_everybody():
    for good, bad in [(1, 1), (7, 3), (3, 7), (64, 8)]:
        a, b = ranking.pairs(good, bad, 5)
        assert set(a) == set(range(good)) and set(b) == set(range(bad)) and len(a) == 5 * max(good, bad)
    a, b = ranking.pairs(100, 30, 16)
    assert len(set(zip(a, b))) > 0.9 * len(a)


def test_quantile_cut():
    strengths, good = np.array([0.0, 1, 2, 3, 4, 5]), np.array([False, False, True, True, True, True])
    assert ranking.quantile_cut(strengths, good) == 1.5
    assert ranking.quantile_cut(np.array([1.0, 1, 1]), np.array([True, False, True])) in (0.0, 2.0)


def test_statistics_by_plain_counts():
    text = "ONE two,, two!\n\nA|B #&*\n" + "x" * 20 + " 漢字 1.2\nA|B #&*"
    got = dict(zip(ranking.NAMES, ranking.statistics(text)))
    words = text.split()
    assert math.isclose(got["size"], math.log1p(len(words))) and math.isclose(got["pipes"] ** 2, 2 / len(words)) and math.isclose(got["digits"] ** 2, 2 / len(words))
    assert math.isclose(got["upper"] ** 2, 7 / len(text.encode())) and math.isclose(got["repeated_lines"] ** 2, 1 / 4) and math.isclose(got["long_words"] ** 2, 1 / len(words))
    assert ranking.statistics("") == (0.0,) * len(ranking.NAMES)


def test_finds_bad_documents(spark, sf):
    """Held-out labels of the smallest table."""
    found = queries.op13_ranking(spark, sf).toPandas()
    labels = queries.table(spark, sf, "labels").filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).toPandas()
    both = found.merge(labels, on="doc_id")
    assert len(both) and found["score"].between(0, 1).all() and (both["predicted"] == both["quality"]).mean() > 0.9
    held = both[both["held_out"]]
    assert len(held) and (held["predicted"] == held["quality"]).mean() > 0.8
    assert ((found["score"] >= 0.7) == (found["predicted"] == 1)).all()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_awkward(spark, kind):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["word", "other", "text"]) for _ in range(40)) + "." if k % 3 else "#$% | " * 30) for k in range(60)]
    rows += [(None, None), (None, ""), (5, None), (5, "again"), (7, "x" * 100_000), rows[4], rows[4], (90, " \t\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    frame = frame.select("*", *(F.create_map(F.lit("k"), F.lit(1)).alias(c) for c in ("row", "stats", "quality", "key", "label", "h", "dotted.name")))
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)] + [(5, None), (None, 0), (1, 1), (6, None)], "doc_id long, quality int").withColumn("doc_id", F.col("doc_id").cast(kind))
    model = ranking.fit(frame, labels)
    found = ranking.scored(frame, model)
    back = found.select("row.*")
    assert back.dtypes == frame.dtypes and sorted(str(r.asDict(True)) for r in back.collect()) == sorted(str(r.asDict(True)) for r in frame.collect())
    got = {r["id"]: r["score"] for r in found.select(F.col("row.doc_id").cast("long").alias("id"), "quality.score").filter("id < 60 AND id NOT IN (5, 7)").collect()}
    assert all((s >= 0.7) == (k % 3 > 0) for k, s in got.items())
    assert ranking.fit(frame, labels.filter("quality = 1")).share == 1.0 and ranking.fit(frame, labels.filter("false")).share == 0.0
    assert ranking.scored(frame.filter("false"), ranking.fit(frame.filter("false"), labels)).count() == 0


def test_equal_texts_get_equal_scores(spark):
    rows = spark.createDataFrame([(k, "a good text of words." if k % 2 else "### | $$$") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 40)], "doc_id long, quality int")
    found = ranking.scored(rows, ranking.fit(rows, labels, fit_rows=9)).select("row.text", "quality.score").distinct().collect()
    assert len(found) == 2


def documents(rows: int, seed: int) -> tuple[list, list]:
    """Texts of which the good ones have more stops and fewer signs, but not always; and their labels."""
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(rows):
        good = rng.random() < 0.7
        words = [rng.choice(["word", "Other", "text", "a", "1,2", "x" * 20, "is?"]) + ("." if rng.random() < (0.3 if good else 0.15) else "") + ("#$" if rng.random() < (0.05 if good else 0.15) else "") for _ in range(rng.randint(0, 60))]
        docs.append((k, "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))))
        labels.append((k, int(good)))
    return docs, labels


def test_every_labelled_document_counts(spark):
    """The only bad document is the last by the hash that once chose 8,000 of them."""
    keys = spark.range(12_000).withColumnRenamed("id", "doc_id").withColumn("h", F.xxhash64(F.lit("ranking"), "doc_id"))
    last = keys.filter(~ranking.held_out("doc_id", 4, 2)).orderBy(F.desc("h")).first()["doc_id"]
    docs = keys.select("doc_id", F.when(F.col("doc_id") == last, "### | $$$").otherwise("a good text of words.").alias("text"))
    labels = keys.select("doc_id", (F.col("doc_id") != last).cast("int").alias("quality"))
    model = ranking.fit(docs, labels)
    assert model.share is None
    assert [r["doc_id"] for r in ranking.scored(docs, model).filter("quality.score < 0.7").select("row.doc_id").collect()] == [last]


def test_sums_over_all_pairs(spark):
    """Loss, gradient and second derivatives by strips, against all pairs listed."""
    docs, labels = documents(300, 3)
    x = np.array([ranking.statistics(t) for _, t in docs])
    good = np.array([y for _, y in labels]) == 1
    frame = spark.createDataFrame([(int(g), *map(float, row)) for g, row in zip(good, x)], "good int, " + ", ".join(f"{n} double" for n in ranking.NAMES)).repartition(3)
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), np.inf)
    pairs = ranking.AllPairs(frame.select("good", F.struct(*ranking.NAMES).alias("stats")), ranking.NAMES, x.mean(axis=0), scale, float(good.sum() * (~good).sum()))
    gaps = ((x[good][:, None] - x[~good][None]) / scale).reshape(-1, x.shape[1])
    for w in (np.zeros(x.shape[1]), np.random.default_rng(1).normal(size=x.shape[1]), 9 * np.random.default_rng(2).normal(size=x.shape[1])):
        value, curve = pairs.at(w)
        slope, bend = curve()
        p = 1 / (1 + np.exp(np.clip(gaps @ w, -500, 500)))
        plain = (gaps * (p * (1 - p))[:, None]).T @ gaps / len(gaps) + 1e-3 * np.eye(len(w))
        assert abs(value - ranking.loss(w, gaps, 1e-3)[0]) < 1e-9 and np.abs(slope - ranking.loss(w, gaps, 1e-3)[1]).max() < 1e-8
        assert np.abs(bend - plain).max() < 1e-2 * np.abs(plain).max()


@pytest.mark.parametrize("spread", [1, 30, 3000])
def test_strips_near_and_far(spread):
    """Losses, slopes and bends by series, of many strips, against plain sums."""
    rng = np.random.default_rng(spread)
    sides = [np.sort(rng.normal(0, spread, size=n)) for n in (700, 900)]
    strips = []
    for s in sides:
        places, first = np.unique(np.rint(s / ranking.STRIP).astype(np.int64), return_index=True)
        powers = (s - np.rint(s / ranking.STRIP) * ranking.STRIP)[:, None] ** np.arange(ranking.ORDERS)
        strips.append(ranking.Strips(places, np.add.reduceat(powers, first), np.ones((len(places), 2))))
    for sign, (own, other) in [(1, (0, 1)), (-1, (1, 0))]:
        series, _ = ranking.against(strips[own], strips[other], sign)
        t = sign * (sides[own][:, None] - sides[other])
        p = 1 / (1 + np.exp(np.clip(t, -500, 500)))
        assert math.isclose((series[0] * strips[own].moments).sum(), np.logaddexp(0, -t).sum(), rel_tol=1e-9)
        assert math.isclose((series[1] * strips[own].moments).sum(), -sign * p.sum(), rel_tol=1e-9)
        assert math.isclose((series[2] * strips[own].moments).sum(), (p * (1 - p)).sum(), rel_tol=1e-6)


def test_listed_and_summed_pairs_give_one_model(spark):
    docs, labels = documents(500, 4)
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    listed, summed = ranking.fit(docs, labels), ranking.fit(docs, labels, few=0)
    assert np.allclose(listed.weights, summed.weights, rtol=1e-4, atol=1e-5) and abs(listed.middle - summed.middle) < 1e-3 and abs(listed.width - summed.width) < 1e-4


def test_quantile_cut_of_a_table(spark):
    rng = np.random.default_rng(5)
    for n, values in [(400, 400), (400, 30), (40, 3), (2, 1), (3, 9)]:
        x, good = rng.integers(0, values, size=n) / 4 - 3, rng.random(n) < 0.6
        good[:2] = [True, False]
        table = spark.createDataFrame([(float(s), int(g)) for s, g in zip(x, good)], "strength double, good int")
        assert ranking.quantile_cut_of(table, int(good.sum()), int((~good).sum())) == ranking.quantile_cut(x, good)
    x = np.arange(40.0)  # the best places are many
    table = spark.createDataFrame([(float(s), int(s) % 2) for s in x], "strength double, good int")
    assert ranking.quantile_cut_of(table, 20, 20) == ranking.quantile_cut(x, x % 2 == 1)
