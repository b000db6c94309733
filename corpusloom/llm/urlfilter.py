"""URL filters by a Bloom filter cascade.

Level 0 encodes the listed keys, level 1 the other keys of the universe that level 0 lets through, level 2 the
listed keys that level 1 lets through, and so on until a level lets nothing wrong through. For every key of the
universe the cascade's answer is exact: the first level without the key decides, by its parity. The universe is
every key that the corpus holds, so pages are judged in one pass without a join.

The levels are built by Spark (bits OR-ed by word) while the sets are large, and by numpy once both hold
`LOCAL` hashes or fewer. The bits are broadcast if they take `max_bytes` or less; for longer lists `listed`
falls back to a join on the keys, with the same answers.

Rules come first: a rule (host, path) fits its host and all subdomains if the url's path starts with the rule's;
of several the longest wins. Where no rule fits, a url is blocked if its host or a parent of it is listed.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule and is allowed; an empty
list allows all; an empty table gives no rows; repeated urls are judged each by itself; all columns of the table, of any
name, come back in the column `row`.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import nested, of_row, written

LOCAL, LEVELS = 200_000, 64

#: The rules of the query: fixed values.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: First labels of domains that are listed: fixed values.
LISTED = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def split_url(url):
    """(host, path) columns."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def host_keys(host):
    """The host and its parent domains; none for an empty host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    keys = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def hashes(key):
    """Two hashes, from which all bit positions of a key follow."""
    return F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("cascade")).alias("h2")


def shape(n: int, rate: float) -> tuple[int, int]:
    """(bits, hashes a key) for n keys at a rate of false positives."""
    bits = max(64, int(np.ceil(1.4427 * np.log2(1 / rate) * max(n, 1))))
    return -(-bits // 64) * 64, max(1, round(np.log2(1 / rate)))


def places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, k: int) -> np.ndarray:
    """Bit positions, keys by hashes."""
    a = (h1.astype(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1))[:, None]
    b = (h2.astype(np.int64).view(np.uint64) | np.uint64(1))[:, None]
    x = a + np.arange(1, k + 1, dtype=np.uint64)[None, :] * b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)) % np.uint64(bits)


def has(level: tuple, number: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    words, bits, k = level
    at = places(h1, h2, number, bits, k)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


class Cascade:
    def __init__(self, levels: list[tuple] | None = None):
        self.levels = levels or []  # (words, bits, hashes a key) each

    @property
    def n_bytes(self) -> int:
        return sum(words.nbytes for words, _, _ in self.levels)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        answer = np.zeros(len(h1), dtype=bool)
        open_ = np.arange(len(h1))
        for number, level in enumerate(self.levels):
            inside = has(level, number, h1[open_], h2[open_])
            answer[open_[~inside]] = number % 2 == 1
            open_ = open_[inside]
        answer[open_] = len(self.levels) % 2 == 1
        return answer


def rate_of(level: int, n_in: int, n_out: int) -> float:
    return float(np.clip(n_in / (2 * max(n_out, 1)), 1e-4, 0.25)) if level == 0 else 1 / 16


def finish(levels: list, ins: np.ndarray, outs: np.ndarray) -> None:
    """Adds the remaining levels. ins, outs: the hashes, n by 2, that the next level encodes and must not let through."""
    while len(ins):
        if len(levels) >= LEVELS:
            raise ValueError("two keys have equal hashes")
        number = len(levels)
        bits, k = shape(len(ins), rate_of(number, len(ins), len(outs)))
        words = np.zeros(bits // 64, dtype=np.uint64)
        at = places(ins[:, 0], ins[:, 1], number, bits, k).ravel()
        np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        levels.append((words, bits, k))
        ins, outs = outs[has(levels[-1], number, outs[:, 0], outs[:, 1])] if len(outs) else outs, ins


def _level(ins: DataFrame, number: int, bits: int, k: int) -> tuple:
    """One level built by Spark."""

    def words(frames):
        import pandas as pd

        for f in frames:
            at = places(f["h1"].to_numpy(), f["h2"].to_numpy(), number, bits, k).ravel()
            value = np.uint64(1) << (at & np.uint64(63))
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "value": value.view(np.int64)})

    got = ins.mapInPandas(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[got["word"].to_numpy()] = got["value"].to_numpy().view(np.uint64)
    return out, bits, k


def build(universe: DataFrame, max_bytes: int = 64 << 20) -> Cascade | None:
    """universe: distinct keys, as a written table of h1, h2 and is_listed. None if the cascade would be too large."""
    n = {r["is_listed"]: r["count"] for r in universe.groupBy("is_listed").count().collect()}
    ins, outs, n_in, n_out = universe.filter("is_listed"), universe.filter("not is_listed"), n.get(True, 0), n.get(False, 0)
    levels: list[tuple] = []
    hashed = lambda df: df.select("h1", "h2").toPandas().to_numpy(dtype=np.int64).reshape(-1, 2)  # noqa: E731  of LOCAL rows at most
    while n_in + n_out > LOCAL and n_in:
        number = len(levels)
        bits, k = shape(n_in, rate_of(number, n_in, n_out))
        if number >= LEVELS or sum(x[0].nbytes for x in levels) + bits // 8 > max_bytes:
            return None
        levels.append(_level(ins, number, bits, k))
        level = universe.sparkSession.sparkContext.broadcast(levels[-1])  # max_bytes at most

        def through(frames, level=level, number=number):
            for f in frames:
                yield f[has(level.value, number, f["h1"].to_numpy(), f["h2"].to_numpy())]

        passed = written(outs.mapInPandas(through, outs.schema), "url-survivors")  # else each level would run all before it
        ins, outs, n_out = passed, ins, n_in
        n_in = ins.count()
    if n_in:
        finish(levels, hashed(ins), hashed(outs))
    cascade = Cascade(levels)
    return cascade if cascade.n_bytes <= max_bytes else None


def judged(pages: DataFrame, listed_key, rules: list[tuple[str, str, str]] = RULES, url: str = "url", max_bytes: int = 64 << 20) -> DataFrame:
    """row (all of pages), host, path, rule and verdict. listed_key: a column function that says of a key whether it is
    listed (or a DataFrame of listed keys, column `key`)."""
    host, path = split_url(of_row(url).cast("string"))
    rows = nested(pages).withColumns({"host": host, "path": path})
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule = F.lit(None).cast("string")
    choice = F.lit(None).cast("string")
    for h, p, verdict in reversed(ordered):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, choice = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(choice)
    keys = rows.select("host").distinct().select(F.explode(host_keys(F.col("host"))).alias("key")).distinct()
    if isinstance(listed_key, DataFrame):
        mine = listed_key.select("key").distinct().withColumn("is_listed", F.lit(True))
        universe = keys.join(mine, "key", "left").select("key", *hashes(F.col("key")), F.coalesce("is_listed", F.lit(False)).alias("is_listed"))
    else:
        universe = keys.select("key", *hashes(F.col("key")), listed_key(F.col("key")).alias("is_listed"))
    universe = written(universe, "url-keys")
    cascade = build(universe, max_bytes)
    if cascade is None:  # a list too long to broadcast
        hosts = rows.select("host").distinct().select("host", F.explode(host_keys(F.col("host"))).alias("key"))
        blocked = hosts.join(universe.filter("is_listed").select("key"), "key", "left_semi").select("host").distinct().withColumn("is_listed", F.lit(True))
        found = rows.join(blocked, "host", "left").withColumn("is_listed", F.coalesce("is_listed", F.lit(False)))
    else:
        held = pages.sparkSession.sparkContext.broadcast(cascade.levels)

        @F.pandas_udf("boolean")
        def is_listed(h1, h2):
            import pandas as pd

            counts = h1.map(len).to_numpy()
            if not counts.sum():
                return pd.Series(np.zeros(len(h1), dtype=bool))
            hit = Cascade(held.value).listed(np.concatenate(h1.to_list()).astype(np.int64), np.concatenate(h2.to_list()).astype(np.int64))
            return pd.Series(np.bincount(np.repeat(np.arange(len(h1)), counts), hit, len(h1)) > 0)

        keys_of = host_keys(F.col("host"))
        found = rows.withColumn("is_listed", is_listed(F.transform(keys_of, lambda k: hashes(k)[0]), F.transform(keys_of, lambda k: hashes(k)[1])))
    method = F.when(F.col("is_listed"), "block").otherwise("allow")
    return found.select("row", "host", "path", rule.alias("rule"), F.coalesce(choice, method).alias("verdict"))
