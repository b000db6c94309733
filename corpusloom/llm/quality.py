"""Quality rules: an isolation forest on rule statistics.

Every whole text gets rule statistics (`statistics`). Rows that break a fixed base rule are rejected at
once. For the others, isolation forests (random splits; rows that few splits isolate are anomalous) give a
score for each family of statistics (symbols, repetition, word shape), and each family's threshold is calibrated
from rows with a quality label. A family that doesn't tell good from bad rows gets no threshold; so rare but
good rows (long lists, refrains) stay.

Each tree's subsample of `SAMPLE` rows is drawn by place from all rows, and thresholds are calibrated on all labelled
rows outside the held-out fold; neither depends on the partitioning. The driver gets the subsamples (`trees` times
SAMPLE rows) and counts of `CELLS` cells.

Defined cases: a null text is an empty text; empty and short texts fail the base rule (n_words < 50), as
every table without words does; without usable labels the threshold keeps every row that passes the base
rules; ids may be null or repeat (each row is judged by itself); all columns of the table, of any name, come back
untouched in the column `row`.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, cell, held_out, nested, of_row, written

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
NAMES = [x.split()[0] for x in STATISTICS.split(", ")]
MIN_WORDS, SAMPLE, CELLS = 50, 256, 1024
SYMBOLS = re.compile(r"[#*$%&|<>]")
HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def count_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    words = ascii_words(text)
    lines = [x for x in text.split("\n") if HAS_WORD.search(x)]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            ends = 0  # words before this place are counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, ends)
                    ends = i + 3
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (all of docs) and the columns of STATISTICS (nested in `rules`), over every whole text."""

    @F.pandas_udf(STATISTICS)
    def rules(column):
        import pandas as pd

        found = [count_rules(x if x is not None else "") for x in column]
        return pd.DataFrame(found, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return nested(docs).withColumn("rules", rules(of_row(text).cast("string")))


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * 50)


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios of the statistics, by which rows of any length compare."""
    n, chars, symbols, dup_lines, repeats = (stats[:, i].astype(float) for i in range(5))
    n = np.maximum(n, 1)
    return np.stack([symbols / n, symbols / np.maximum(chars, 1), dup_lines / n, repeats / n, chars / n], axis=1)


#: The columns of `features` by family.
FAMILIES = {"symbols": [0, 1], "repetition": [2, 3], "shape": [4]}


@dataclass
class IsolationForest:
    """Trees of random splits as flat arrays. A node's value is its split, a leaf's its path length."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    roots: np.ndarray
    norm: float

    @staticmethod
    def usual_depth(n: int) -> float:
        """The mean depth of a row in a random tree over n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    @classmethod
    def fit(cls, parts: list[np.ndarray], seed: int = 7) -> IsolationForest:
        """A tree for each of the equally large subsamples."""
        rng = np.random.default_rng(seed)
        size = len(parts[0])
        limit = int(np.ceil(np.log2(max(size, 2))))
        feature, value, child, roots = [], [], [], []

        def grow(part: np.ndarray, depth: int) -> int:
            at = len(feature)
            feature.append(-1)
            value.append(depth + cls.usual_depth(len(part)))
            child.append(0)
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth < limit and len(part) > 1 and len(open_):
                f = int(rng.choice(open_))
                cut = rng.uniform(low[f], high[f])
                left = part[:, f] <= cut
                feature[at], value[at] = f, cut
                grow(part[left], depth + 1)
                child[at] = grow(part[~left], depth + 1)  # the left child follows its parent
            return at

        for part in parts:
            roots.append(grow(part, 0))
        return cls(np.array(feature), np.array(value), np.array(child), np.array(roots), max(cls.usual_depth(size), 1e-9))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1 for each row; the shorter its paths, the nearer to 1."""
        total = np.zeros(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                f = self.feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                here = at[inner]
                left = rows[inner, f[inner]] <= self.value[here]
                at[inner] = np.where(left, here + 1, self.child[here])
            total += self.value[at]
        return 2.0 ** (-total / len(self.roots) / self.norm) if len(self.roots) else np.zeros(len(rows))


@dataclass
class QualityModel:
    forests: dict[str, IsolationForest]
    thresholds: dict[str, float]

    def excess(self, stats: np.ndarray) -> np.ndarray:
        """For each row, by how much its worst family exceeds the threshold; over 0 is a rejection."""
        worst = np.full(len(stats), -1.0)
        rows = features(stats)
        for name, forest in self.forests.items():
            if np.isfinite(self.thresholds[name]) and len(rows):
                distinct, back = np.unique(rows[:, FAMILIES[name]], axis=0, return_inverse=True)  # copies are scored once
                worst = np.maximum(worst, (forest.score(distinct) - self.thresholds[name])[back.reshape(-1)])
        return worst


def subsamples(open_: DataFrame, trees: int, seed: int = 7) -> list[np.ndarray]:
    """For each tree the statistics of SAMPLE rows (all, if there are fewer), drawn without replacement from all rows of
    open_. Equal statistics share a range of places, so a range is a row whatever its count."""
    values = open_.select("rules.*").groupBy(*NAMES).agg(F.count("*").alias("n")).withColumn("cell", cell(CELLS, *NAMES))
    values = written(values, "quality-values")
    sizes = sorted(tuple(r) for r in values.groupBy("cell").agg(F.sum("n")).collect())
    total = sum(n for _, n in sizes)
    if total < 2:
        return []
    starts = np.zeros(CELLS, dtype=np.int64)
    before = 0
    for at, n in sizes:
        starts[at], before = before, before + n
    rng = np.random.default_rng(seed)
    drawn = np.stack([rng.choice(total, min(SAMPLE, total), replace=False) for _ in range(trees)])
    places = np.unique(drawn)

    def picked(batches):
        import pandas as pd

        for b in batches:
            end = starts[b["cell"].to_numpy()] + b["upto"].to_numpy()
            first, last = np.searchsorted(places, end - b["n"].to_numpy()), np.searchsorted(places, end)
            at = np.repeat(np.arange(len(b)), last - first)
            own = [places[i:j] for i, j in zip(first, last) if j > i]
            out = b[NAMES].iloc[at].reset_index(drop=True)
            yield out.assign(place=np.concatenate(own) if own else pd.Series(dtype="int64"))

    upto = F.sum("n").over(Window.partitionBy("cell").orderBy(*NAMES).rowsBetween(Window.unboundedPreceding, 0))
    got = values.withColumn("upto", upto).mapInPandas(picked, f"{STATISTICS}, place long").toPandas().sort_values("place")
    return list(got[NAMES].to_numpy(dtype=np.int64)[np.searchsorted(places, drawn)])


def calibrate(scored: DataFrame, score: str, lost: float = 0.002, cells: int = 4096) -> float:
    """The threshold that rejects most bad rows among those that reject at most a share `lost` of the good
    ones; of equal ones the highest. Infinity (keep all) if that rejects no larger share of the bad than of the good.
    scored: scores and how many good and bad rows have them."""
    goods, bads, low, high = scored.agg(F.sum("good"), F.sum("bad"), F.min(score), F.max(score)).first()
    if not goods or not bads:
        return float("inf")
    left = int(lost * goods + 1e-9)  # so many good scores may lie above the threshold: find the next one
    while low < high:  # each round counts the cells of a narrower range
        at = F.least(F.floor((F.col(score) - low) / (high - low) * cells), F.lit(cells - 1))
        counts = scored.filter(F.col(score).between(low, high)).groupBy(at.alias("at")).agg(F.sum("good"), F.min(score), F.max(score))
        for _, n, low, high in sorted(counts.collect(), reverse=True):
            if n > left:
                break
            left -= n
    above = F.col(score) > low
    good, bad, cut = scored.filter(above).agg(F.sum("good"), F.sum("bad"), F.min(F.when(F.col("bad") > 0, F.col(score)))).first()
    if not bad or bad / bads <= (good or 0) / goods:
        return float("inf")
    return (cut + scored.filter(F.col(score) < cut).agg(F.max(score)).first()[0]) / 2


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", trees: int = 100) -> QualityModel:
    """stats: from `statistics`, best written before. labels: key and quality (1 is good)."""
    open_ = stats.filter(~base_failed(F.col("rules.n_words"), F.col("rules.n_repeat_words"))).select(of_row(key).alias(key), "rules")
    parts = [features(x) for x in subsamples(open_, trees)]
    if not parts:
        return QualityModel({}, {})
    forests = {name: IsolationForest.fit([x[:, own] for x in parts]) for name, own in FAMILIES.items()}
    mine = labels.filter(F.col("quality").isNotNull() & ~held_out(key)).groupBy(F.col(key).try_cast(open_.schema[key].dataType).alias(key)).agg(F.min("quality").cast("long").alias("quality"))
    good = F.col("quality") == 1
    known = open_.join(mine, key).select("rules.*", "quality").groupBy(*NAMES).agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))

    def scores(batches):
        for b in batches:
            rows = features(b[NAMES].to_numpy(dtype=np.int64))
            yield b[["good", "bad"]].assign(**{name: forest.score(rows[:, FAMILIES[name]]) for name, forest in forests.items()})

    left = known.mapInPandas(scores, "good long, bad long, " + ", ".join(f"{name} double" for name in forests))
    left = written(left.groupBy(*forests).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "quality-scores")
    thresholds = {}
    for name in forests:  # each on what the families before it have left
        thresholds[name] = calibrate(left, name)
        left = left.filter(F.col(name) <= thresholds[name])
    return QualityModel(forests, thresholds)


def judged(stats: DataFrame, model: QualityModel) -> DataFrame:
    """stats with base_failed, excess (over 0: some family is anomalous) and kept. No shuffle."""

    @F.pandas_udf("double")
    def excess(rules):
        import pandas as pd

        return pd.Series(model.excess(rules.to_numpy(dtype=np.int64)))

    failed = base_failed(F.col("rules.n_words"), F.col("rules.n_repeat_words"))
    scored = stats.withColumns({"base_failed": failed, "excess": excess("rules")})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("excess") <= 0))
