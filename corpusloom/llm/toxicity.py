"""Toxicity by multiple-instance learning: documents are bags of sentences.

Only documents are labelled. Each sentence has a logistic score over its words and their beginnings, a
document's score is the noisy-or of its sentences (toxic if any of them is), and the weights maximise the
likelihood of the document labels. The sentence scores then locate the offending sentences.

Bounds: the model is fitted on `fit_rows` labelled documents (those with the smallest hash of their id) of at most
`fit_chars` characters, and has `n_features` features, those most associated with the label. So the driver, which
trains, gets a few numbers for each feature of each of their sentences. Every whole text is scored, of any length,
sentence by sentence, without a shuffle.

Defined cases: a null or empty text has one empty sentence; without both labels the score is the share of
label 1 (0 without labels); rows with a null id are scored and never learnt from; a label that is null is no
label; of several labels for an id the highest counts, and of several texts that with the least hash; all columns of the table, of any name, come back in the
column `row`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, held_out, named, nested, of_row, smallest, texts, written

SENTENCE = re.compile(r"[.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6, 7)


def sentences(text: str) -> list[str]:
    """The sentences with a word, in order; an empty text has one empty sentence."""
    return [s for s in SENTENCE.split(text) if TOKEN.search(s)] or [""]


def word_features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    cache: dict[str, tuple] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def sentence_scores(self, text: str) -> np.ndarray:
        cache, out = self.cache, []
        if len(cache) > 150_000:
            cache.clear()
        for s in SENTENCE.split(text.lower()):
            words = TOKEN.findall(s)
            if not words:
                continue
            found = set()
            for w in words:
                hit = cache.get(w)
                if hit is None:
                    hit = cache[w] = tuple(f for f in word_features(w) if f in self.weights)
                if hit:
                    found.update(hit)
            out.append(self.bias + sum(self.weights[f] for f in sorted(found)))
        return 1 / (1 + np.exp(-np.clip(np.array(out or [self.bias]), -30, 30)))

    def score(self, text: str) -> tuple[float, np.ndarray]:
        each = self.sentence_scores(text)
        return float(1 - np.exp(np.log1p(-each).sum())), each


def _bags(batches, lookup: dict[str, int] | None):
    """(label, features of the document) or, with a lookup, (label, sentences, sentence and feature pairs)."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for text, y in zip(texts(batch), column(batch, "toxic")):
            pairs, names, n = [], set(), 0
            for n, s in enumerate(sentences(text.lower()), 1):
                found = {f for w in TOKEN.findall(s) for f in word_features(w)}
                if lookup is None:
                    names |= found
                else:
                    pairs += [(n - 1) << 20 | lookup[f] for f in sorted(found) if f in lookup]
            rows.append((y, sorted(names)) if lookup is None else (y, n, pairs))
        if lookup is None:
            yield pa.RecordBatch.from_pydict({"toxic": pa.array([r[0] for r in rows], pa.int32()), "names": pa.array([r[1] for r in rows], pa.list_(pa.string()))})
        else:
            yield pa.RecordBatch.from_pydict({"toxic": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([r[1] for r in rows], pa.int32()), "pairs": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = 8_000, fit_chars: int = 20_000, n_features: int = 1_024, steps: int = 400, positive_weight: float = 2.0) -> ToxicityModel:
    """docs ⋈ labels (key, toxic) outside the held-out fold."""
    own = docs.select(named(key).alias("key"), named(text).cast("string").alias("text")).filter(F.length(F.coalesce("text", F.lit(""))) <= fit_chars)
    usable = labels.select(named(key).alias("key"), "toxic").filter(F.col("toxic").isNotNull() & ~held_out("key")).groupBy(F.col("key").try_cast(own.schema["key"].dataType).alias("key")).agg(F.max("toxic").cast("int").alias("toxic"))
    usable = written(usable.join(own.select("key"), "key", "left_semi"), "toxicity-usable")
    picked = written(smallest(usable, F.xxhash64(F.lit("toxicity"), "key"), fit_rows), "toxicity-labels")
    of_key = own.join(F.broadcast(picked), "key").groupBy("key").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"), F.first("toxic").alias("toxic"))
    sample = written(of_key.select("least.text", "toxic"), "toxicity-sample")  # fit_rows at most, however often an id repeats
    total = sample.agg(F.sum(F.col("toxic")), F.count("*")).first()
    positive, n = total[0] or 0, total[1]
    if positive in (0, n):
        p = min(max(positive / n if n else 0.0, 1e-9), 1 - 1e-9)
        return ToxicityModel({}, float(np.log(p / (1 - p))))
    listed = sample.mapInArrow(lambda b: _bags(b, None), "toxic int, names array<string>")
    counted = listed.select("toxic", F.explode("names").alias("name")).groupBy("name").agg(F.sum("toxic").alias("a"), F.count("*").alias("m"))
    share = positive / n
    z = F.abs(F.col("a") - F.col("m") * share) / F.sqrt(F.col("m") * F.lit(share * (1 - share)) * (1 - F.col("m") / (n + 1)) + 0.5)
    best = counted.filter("m >= 4").select("name", z.alias("z")).filter("z > 3").orderBy(F.desc("z"), "name").limit(n_features).collect()
    names = [r["name"] for r in best]
    lookup = {x: i for i, x in enumerate(names)}
    bags = sample.mapInArrow(lambda b: _bags(b, lookup), "toxic int, n int, pairs array<long>").toPandas()
    weights, bias = train(bags["toxic"].to_numpy(), bags["n"].to_numpy(), [np.asarray(p, dtype=np.int64) for p in bags["pairs"]], len(names), steps, positive_weight)
    return ToxicityModel({x: float(w) for x, w in zip(names, weights)}, float(bias))


class NoisyOr:
    """The likelihood of document labels under the noisy-or of sentence scores. Sentences without a feature are counted, not
    listed. pairs: for each document, sentence << 20 | feature."""

    def __init__(self, labels: np.ndarray, n_sentences: np.ndarray, pairs: list[np.ndarray], n_features: int, positive_weight: float = 2.0, l2: float = 1e-4):
        doc = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        flat = np.concatenate(pairs) if len(pairs) else np.zeros(0, np.int64)
        order = np.lexsort((flat & 0xFFFFF, flat >> 20, doc))
        doc, sent, self.feat = doc[order], (flat >> 20)[order], (flat & 0xFFFFF)[order]
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (sent[1:] != sent[:-1])
        self.row = np.cumsum(first) - 1  # of the listed sentences
        self.owner = doc[first]
        self.plain = n_sentences - np.bincount(self.owner, minlength=len(labels))
        self.y = labels.astype(float)
        self.weight = np.where(self.y == 1, positive_weight, 1.0)
        self.n_features, self.l2 = n_features, l2

    def loss(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        """The mean loss, and its gradient by the weights and (last) the bias."""
        z = np.bincount(self.row, w[self.feat], len(self.owner)) + b
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-b))
        log_none = np.minimum(np.bincount(self.owner, np.log1p(-p), len(self.y)) + self.plain * np.log1p(-p0), -1e-9)
        none = np.exp(log_none)
        total = -(self.weight * np.where(self.y == 1, np.log1p(-none), log_none)).mean() + self.l2 / 2 * (w * w).sum()
        slope = self.weight * np.where(self.y == 1, none / (1 - none), -1.0)  # of the loss by log_none
        by_z = -slope[self.owner] * p
        by_w = np.bincount(self.feat, by_z[self.row], self.n_features) / len(self.y) + self.l2 * w
        return float(total), np.append(by_w, (by_z.sum() - (slope * self.plain).sum() * p0) / len(self.y))


def train(labels: np.ndarray, n_sentences: np.ndarray, pairs: list[np.ndarray], n_features: int, steps: int = 400, positive_weight: float = 2.0, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or likelihood."""
    model = NoisyOr(labels, n_sentences, pairs, n_features, positive_weight)
    w, b = np.zeros(n_features), float(np.log(max(model.y.mean(), 1e-6) / max(n_sentences.mean(), 1)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        _, grad = model.loss(w, b)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """row (all of docs) and `toxicity`: score, n_sentences, worst_sentence (its index) and offending (the indexes of all
    sentences whose own score is 0.5 or more)."""

    @F.pandas_udf("score double, n_sentences int, worst_sentence int, offending array<int>")
    def score(texts_):
        import pandas as pd

        rows = []
        for x in texts_:
            total, each = model.score(x or "")
            rows.append((total, len(each), int(each.argmax()), np.flatnonzero(each >= 0.5).astype(np.int32)))
        return pd.DataFrame(rows, columns=["score", "n_sentences", "worst_sentence", "offending"])

    return nested(docs).withColumn("toxicity", score(of_row(text).cast("string")))
