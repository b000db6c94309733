"""Quality by pairwise ranking: documents get Bradley-Terry scores, learnt from preferences between pairs.

Every labelled good document is preferred to every labelled bad one. A document's strength is a weighted sum of statistics of its whole
text, the probability of a preference is the logistic function of the difference of two strengths, and the weights maximise the
likelihood of all these pairs (Newton's method, with a ridge). The threshold is a quantile of the strengths of all labelled
documents, the one that parts good from bad best; a strength at the threshold has the score `cut`, others follow by a logistic curve.

All labelled documents outside the held-out fold are learnt from; `fit_rows` takes fewer only where a caller asks for that. Up to `FEW`
pairs are listed in the driver. The sums over more are never listed: tasks add up, for each side and each strip of strengths `STRIP` wide, the
powers of the distances from the strip's middle, the driver turns them into Taylor series of what a document loses against the whole
other side, and tasks add up its slopes over their documents. A pair's loss is off by less than 1e-10. The driver gets
some twenty numbers for each strip that is not empty, and 342 for each task.

Defined cases: a null or empty text has statistics of zero; without both labels the score is the share of label 1 (0 without labels); rows
with a null id are scored and never learnt from; a label that is null is no label; of several labels for an id the lowest counts, and
of several texts that with the least hash; all columns of the table, of any name, come back in the column `row`.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, held_out, named, nested, of_row, smallest, written

#: Characters that a statistic counts, each kind as a share of words or of bytes.
KINDS = {"symbols": "#*$%&|<>@^_=+~\\/", "bangs": "!", "questions": "?", "stops": ".", "commas": ",", "pipes": "|", "brackets": "{}[]()", "colons": ":;", "digits": "0123456789"}
UPPER = slice(ord("A"), ord("Z") + 1)
SIGNS = re.compile(r"[#*$%&!]{2,}")
LONG = 18
NAMES = ["size", "word_chars", "upper", *KINDS, "lines", "repeated_lines", "distinct_words", "long_words", "single_chars", "runs_of_signs"]

#: As many pairs the driver lists.
FEW = 1 << 17
#: The width of a strip of strengths, and the terms of a Taylor series within it.
STRIP, ORDERS = 1 / 16, 6
#: Strips as far apart as this have straight losses: all other terms are below 1e-17.
REACH = int(40 / STRIP)
FACTORIALS = np.array([math.factorial(k) for k in range(ORDERS)], dtype=float)


def statistics(text: str) -> tuple[float, ...]:
    """Statistics of a text in the order of NAMES; all but the first two are square roots of shares, so that texts of any length compare."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words, lines = ascii_words(text), [x for x in text.split("\n") if x.strip()]
    n, n_bytes, n_lines = max(len(words), 1), max(len(data), 1), max(len(lines), 1)
    counts = sum((np.bincount(data[k : k + (1 << 24)], minlength=256) for k in range(0, len(data), 1 << 24)), np.zeros(256, dtype=np.int64))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    shares = [counts[UPPER].sum() / n_bytes, *(sum(int(counts[ord(c)]) for c in some) / n for some in KINDS.values())]
    shares += [len(lines) / n, (len(lines) - len(set(lines))) / n_lines, len(set(text.lower().split())) / n]
    shares += [np.count_nonzero(lengths >= LONG) / n, np.count_nonzero(lengths == 1) / n, len(SIGNS.findall(text)) / n]
    return float(np.log1p(len(words))), float(np.log1p(lengths.sum() / n)), *np.sqrt(np.array(shares, dtype=float)).tolist()


def with_statistics(rows: DataFrame, text: Column) -> DataFrame:
    """rows and `stats`, a struct of the statistics of a text."""

    @F.pandas_udf(", ".join(f"{n} double" for n in NAMES))
    def count(column):
        import pandas as pd

        return pd.DataFrame([statistics(x if x is not None else "") for x in column], columns=NAMES)

    return rows.withColumn("stats", count(text.cast("string")))


@dataclass
class Ranking:
    names: list[str]
    weights: np.ndarray
    middle: float  # the strength at the threshold
    width: float
    cut: float
    share: float | None = None  # every score, where nothing could be learnt

    def strength(self, stats: Column) -> Column:
        return sum((stats.getField(n) * F.lit(float(w)) for n, w in zip(self.names, self.weights)), F.lit(0.0))

    def score(self, stats: Column) -> Column:
        if self.share is not None:
            return F.lit(float(self.share))
        level = float(np.log(self.cut / (1 - self.cut)))
        z = (self.strength(stats) - F.lit(self.middle)) / F.lit(self.width)
        return F.when(z >= 0, F.greatest(F.lit(self.cut), 1 / (1 + F.exp(-(z + level))))).otherwise(F.least(F.lit(float(np.nextafter(self.cut, 0))), 1 / (1 + F.exp(-(z + level)))))


def pairs(good: int, bad: int, meetings: int) -> tuple[np.ndarray, np.ndarray]:
    """(good, bad) places of max(good, bad) * meetings pairs; in each round every document of the larger side meets another,
    so as many rounds as the smaller side has documents give all pairs."""
    most = max(good, bad)
    i = np.arange(most * meetings)
    step = i % most + i // most
    return (i % good, step % bad) if good >= bad else (step % good, i % bad)


def loss(weights: np.ndarray, gaps: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The mean logistic loss over feature differences (preferred less other), with a ridge, and its gradient."""
    z = gaps @ weights
    p = 1 / (1 + np.exp(np.clip(z, -500, 500)))  # of the wrong order
    return float(np.logaddexp(0, -z).mean() + ridge / 2 * weights @ weights), -(gaps * p[:, None]).mean(axis=0) + ridge * weights


def descended(at: Callable, size: int, steps: int = 30) -> np.ndarray:
    """The weights of least loss, by Newton's method with halved steps. at(weights): the loss, and what gives its gradient and second
    derivatives."""
    w = np.zeros(size)
    value, curve = at(w)
    for _ in range(steps):
        slope, bend = curve()
        move, part, before = np.linalg.solve(bend, slope), 1.0, value
        value, curve = at(w - move)
        while value > before + 1e-12 and part > 1e-6:
            part /= 2
            value, curve = at(w - part * move)
        w = w - part * move
        if before - value < 1e-10:
            break
    return w


def learnt(gaps: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """The weights of least loss over listed pairs."""

    def at(w):
        value, slope = loss(w, gaps, ridge)

        def curve():
            p = 1 / (1 + np.exp(np.clip(gaps @ w, -500, 500)))
            return slope, (gaps * (p * (1 - p))[:, None]).T @ gaps / len(gaps) + ridge * np.eye(len(w))

        return value, curve

    return descended(at, gaps.shape[1], steps)


def _by_wrong(n: int) -> list[np.polynomial.Polynomial]:
    """The first n derivatives of log(1 + exp(-t)), as polynomials of the probability of the wrong order."""
    out = [np.polynomial.Polynomial([0.0, -1.0])]
    while len(out) < n:
        out.append(out[-1].deriv() * np.polynomial.Polynomial([0.0, -1.0, 1.0]))
    return out


DERIVATIVES = _by_wrong(ORDERS + 1)


@dataclass
class Strips:
    """Documents of one side by strips of their strength, in order."""

    places: np.ndarray  # the middle of a strip is STRIP times its place
    moments: np.ndarray  # sums of the powers 0 to ORDERS - 1 of the distance from the middle
    vectors: np.ndarray  # sums of the documents' features


def against(own: Strips, other: Strips, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """For each strip of own the Taylor series of a document's loss against all documents of the other side, of its slope and of its
    bend, by the document's strength; and the other side's features weighted by the bends at the strips' middles. sign: 1 where own is preferred."""
    weighted = other.moments * (-1.0) ** np.arange(ORDERS) / FACTORIALS
    series, features = np.zeros((3, len(own.places), ORDERS)), np.zeros((len(own.places), other.vectors.shape[1]))
    for k in range(0, len(own.places), 256):
        places = own.places[k : k + 256]
        near = slice(*np.searchsorted(other.places, [places[0] - REACH, places[-1] + REACH + 1]))
        beyond = slice(near.stop, None) if sign > 0 else slice(0, near.start)  # preferred beyond doubt, against the labels
        straight = {1: -weighted[beyond].sum(axis=0), 0: sign * STRIP * (other.places[beyond] @ weighted[beyond] - places[:, None] * weighted[beyond].sum(axis=0))}
        t = sign * STRIP * (places[:, None] - other.places[near])
        wrong = 1 / (1 + np.exp(np.clip(t, -500, 500)))
        for order, of in enumerate([None, *DERIVATIVES]):
            each = np.logaddexp(0, -t) if of is None else of(wrong)
            if order == 2:
                features[k : k + 256] = each @ other.vectors[near]
            sums = (each @ weighted[near] + straight.get(order, 0.0)) * float(sign) ** order
            for level, power in itertools.product(range(3), range(ORDERS)):
                if 0 <= order - level - power < ORDERS - power:
                    series[level, k : k + 256, power] += sums[:, order - level - power] / FACTORIALS[power]
    return series, features


@dataclass
class AllPairs:
    """The mean loss over all pairs of a good and a bad row of a written table: good (0 or 1), stats."""

    rows: DataFrame
    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    n_pairs: float
    ridge: float = 1e-3

    def placed(self, weights: np.ndarray) -> Callable:
        """Of a batch: side, features, place of the strip, and distance from its middle; of a row the same ones in every batch."""
        names, mean, scale = self.names, self.mean, self.scale

        def of(batch):
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            z = np.ascontiguousarray((x - mean) / scale)
            strengths = (z * weights).sum(axis=1)
            places = np.rint(strengths / STRIP).astype(np.int64)
            return batch.column("good").to_numpy(zero_copy_only=False), z, places, strengths - places * STRIP

        return of

    def strips(self, weights: np.ndarray) -> dict[int, Strips]:
        placed = self.placed(weights)

        def summed(batches):
            import pyarrow as pa

            total = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                good, z, places, offsets = placed(batch)
                keys, group = np.unique(places * 2 + good, return_inverse=True)
                order = np.argsort(group, kind="stable")
                what = np.column_stack([offsets[:, None] ** np.arange(ORDERS), z])[order]
                for key, sums in zip(keys.tolist(), np.add.reduceat(what, np.flatnonzero(np.diff(group[order], prepend=-1)))):
                    total[key] = total[key] + sums if key in total else sums
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(total), pa.int64()), "sums": pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))})

        parts = self.rows.select("good", "stats.*").mapInArrow(summed, "key long, sums array<double>")
        whole = parts.groupBy("key").agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"sum_{i}") for i in range(ORDERS + len(self.names)))).toPandas().sort_values("key")
        keys, sums = whole["key"].to_numpy(), whole.drop(columns="key").to_numpy(dtype=float)
        return {side: Strips(keys[keys & 1 == side] >> 1, sums[keys & 1 == side, :ORDERS], sums[keys & 1 == side, ORDERS:]) for side in (0, 1)}

    def at(self, weights: np.ndarray) -> tuple[float, Callable]:
        """The loss, and what gives its gradient and second derivatives (these with mixed terms by strips)."""
        strips, n, ridge = self.strips(weights), len(self.names), self.ridge
        good, features = against(strips[1], strips[0], 1)
        bad, _ = against(strips[0], strips[1], -1)
        value = float((good[0] * strips[1].moments).sum() / self.n_pairs + ridge / 2 * weights @ weights)
        placed, tables = self.placed(weights), {1: (strips[1].places, good[1], good[2]), 0: (strips[0].places, bad[1], bad[2])}

        def added(batches):
            import pyarrow as pa

            total = np.zeros(n + n * n)
            for batch in batches:
                side, z, places, offsets = placed(batch)
                for which, (listed, slopes, bends) in tables.items():
                    own = side == which
                    k, x, powers = np.searchsorted(listed, places[own]), z[own], offsets[own, None] ** np.arange(ORDERS)
                    total[:n] += (slopes[k] * powers).sum(axis=1) @ x
                    total[n:] += ((x * (bends[k] * powers).sum(axis=1)[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

        def curve():
            total = np.sum([r["sums"] for r in self.rows.select("good", "stats.*").mapInArrow(added, "sums array<double>").collect()], axis=0)
            mixed = strips[1].vectors.T @ features
            return total[:n] / self.n_pairs + ridge * weights, (total[n:].reshape(n, n) - mixed - mixed.T) / self.n_pairs + ridge * np.eye(n)

        return value, curve


def quantile_cut(strengths: np.ndarray, good: np.ndarray) -> float:
    """The quantile of the strengths below which bad rows are best told from good ones (least sum of both rates of error), halfway
    to the next strength; of several the middle one."""
    order = np.argsort(strengths, kind="stable")
    x, y = strengths[order], good[order].astype(float)
    wrong = np.concatenate([[0], np.cumsum(y)]) / y.sum() + 1 - np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    open_ = np.concatenate([[True], x[1:] > x[:-1], [True]])
    best = np.flatnonzero(open_ & (wrong <= wrong[open_].min() + 1e-12))
    return float(edges[best[len(best) // 2]])


def quantile_cut_of(rows: DataFrame, good: int, bad: int) -> float:
    """`quantile_cut` of a table of strength and good (0 or 1), of any size: counts within ranges of strengths follow those of the ranges before."""
    each = rows.groupBy("strength").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    ordered = written(each.repartitionByRange("strength").withColumn("cell", F.spark_partition_id()), "ranking-strengths")
    cells = ordered.groupBy("cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("cell").collect()
    earlier = list(itertools.accumulate(((r["good"], r["bad"]) for r in cells), lambda x, y: (x[0] + y[0], x[1] + y[1]), initial=(0, 0)))
    before = rows.sparkSession.createDataFrame([(r["cell"], *n) for r, n in zip(cells, earlier)], "cell int, good_before long, bad_before long")
    running = Window.partitionBy("cell").orderBy("strength")
    wrong = (F.col("good_before") + F.sum("good").over(running)) / good + 1 - (F.col("bad_before") + F.sum("bad").over(running)) / bad
    found = written(ordered.join(F.broadcast(before), "cell").select("cell", "strength", wrong.alias("wrong")), "ranking-errors")
    low, least = found.agg(F.min("strength"), F.least(F.min("wrong"), F.lit(1.0))).first()  # below all strengths every bad row is wrong
    best = found.filter(F.col("wrong") <= least + 1e-12)
    counts = best.groupBy("cell").count().orderBy("cell").collect()
    below = int(1.0 <= least + 1e-12)
    place = (below + sum(r["count"] for r in counts)) // 2 - below
    if place < 0:
        return low - 1
    for cell, n in counts:
        if place < n:
            break
        place -= n
    last = best.filter(F.col("cell") == cell).withColumn("place", F.row_number().over(running)).filter(F.col("place") == place + 1).first()["strength"]
    following = found.filter(F.col("strength") > last).agg(F.min("strength")).first()[0]
    return last + 1 if following is None else (last + following) / 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", unused: Column | None = None, fit_rows: int | None = None, cut: float = 0.7, few: int = FEW) -> Ranking:
    """docs ⋈ labels (key, label) where `unused` (of the column key) is false."""
    own = docs.select(named(key).alias("key"), named(text).cast("string").alias("text")).filter(F.col("key").isNotNull())
    unused = held_out("key", 4, 2) if unused is None else unused
    usable = labels.select(named(key).alias("key"), named(label).alias("label")).filter(F.col("label").isNotNull() & ~unused).groupBy(F.col("key").try_cast(own.schema["key"].dataType).alias("key")).agg(F.min("label").cast("int").alias("label"))
    if fit_rows is not None:
        usable = written(usable.join(own.select("key"), "key", "left_semi"), "ranking-usable")
        usable = written(smallest(usable, F.xxhash64(F.lit("ranking"), "key"), fit_rows), "ranking-labels")
    of_key = with_statistics(own, F.col("text")).select("key", F.struct(F.xxhash64("text").alias("h"), "stats").alias("least")).groupBy("key").agg(F.min("least").alias("least"))
    rows = written(of_key.join(usable, "key").select(F.coalesce(F.col("label") == 1, F.lit(False)).cast("int").alias("good"), "least.stats"), "ranking-statistics")
    facts = rows.agg(F.count("*"), F.sum("good"), *(f(f"stats.{n}") for n in NAMES for f in (F.avg, F.stddev_pop))).first()
    n, good = facts[0], facts[1] or 0
    if good in (0, n):
        return Ranking([], np.zeros(0), 0.0, 1.0, cut, good / n if n else 0.0)
    mean, spread = np.array(facts[2::2]), np.array(facts[3::2])
    scale = np.where(spread > 1e-9, spread, np.inf)
    if good * (n - good) <= few:
        listed = rows.select("good", "stats.*").toPandas()
        x, is_good = listed[NAMES].to_numpy(dtype=float) / scale, listed["good"].to_numpy() == 1
        a, b = pairs(good, n - good, min(good, n - good))
        weights = learnt(x[is_good][a] - x[~is_good][b])
    else:
        weights = descended(AllPairs(rows, NAMES, mean, scale, float(good) * (n - good)).at, len(NAMES))
    model = Ranking(NAMES, np.round(weights, 9) / scale, 0.0, 1.0, cut)  # rounded: sums in another order give equal weights
    strengths = written(rows.select("good", model.strength(F.col("stats")).alias("strength")), "ranking-fitted")
    model.width = max(float(strengths.agg(F.stddev_pop("strength")).first()[0]) / 4, 1e-9)
    if good * (n - good) <= few:
        listed = strengths.toPandas()
        model.middle = quantile_cut(listed["strength"].to_numpy(), listed["good"].to_numpy() == 1)
    else:
        model.middle = quantile_cut_of(strengths, good, n - good)
    return model


def scored(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """row (all of docs), `quality`: score and strength."""
    rows = with_statistics(nested(docs), of_row(text))
    return rows.select("row", F.struct(model.score(F.col("stats")).alias("score"), model.strength(F.col("stats")).alias("strength")).alias("quality"))
