"""SimHash near-duplicates: pigeonhole blocks, joins on blocks, verified Hamming distances.

A text's fingerprint (64 bits) is the majority of the XXH64 hashes of its word shingles. Two fingerprints
link at `radius` or fewer differing bits. The 64 bits are cut into `blocks` blocks; a close pair shares at
least blocks - radius of them, so each fingerprint is keyed by every choice of that many blocks. Pairs that
share a key are verified by the Hamming distance of the whole fingerprints.

Distinct fingerprints are linked, never rows: exact copies collapse before any join. A key with more than
`hot` distinct fingerprints doesn't emit its pairs. Its members are linked exactly through hubs instead: a
member is listed under every value within one bit of it, and two values within two bits of each other share
such a hub, so the work of m members is 65 * m rows, not m * m. (This holds for radius 2, the one built.)

Components are found by alternating minimum-label stars with written tables between rounds, until a round changes
nothing (a few rounds more than the logarithm of the longest chain), and each row gets the smallest id of its component.

Defined cases: a null text is an empty text; a text without words has fingerprint zero and links like any
other; fewer words than a shingle make one shingle of them all; equal rows share a component; rows with a
null id get a fingerprint, and a null component only if no id of their component is set; ids may be of any type that
sorts; other columns of any name come back untouched from `fingerprints` (in the column `row`) and `deduplicated`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.addresses import addressed, flagged
from .common import LOWER_AZ, ascii_words, joined, named, nested, of_row, written

RADIUS, BLOCKS, HOT, SHINGLE, SEED = 2, 5, 48, 3, 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = ascii_words(text.translate(LOWER_AZ) if not text.isascii() else text.lower())
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(" ".join(words), SEED)], dtype=np.uint64)
    else:
        whole = " ".join(words).encode()
        blanks = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
        starts = [0, *(blanks[: len(words) - shingle] + 1).tolist()]
        ends = [*blanks[shingle - 1 :].tolist(), len(whole)]
        digest, seed = xxhash.xxh64_intdigest, SEED
        hashes = np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 14):  # the bits of very long texts are counted in parts
        bits = np.unpackbits(hashes[part : part + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """row (all of docs) and `fp`, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(column):
        import pandas as pd

        last: dict[str, int] = {}  # of this batch
        out = []
        for x in column:
            x = x or ""
            if x not in last:
                last[x] = fingerprint(x, shingle)
            out.append(last[x])
        return pd.Series(np.array(out, dtype=np.uint64).view(np.int64))

    return nested(docs).withColumn("fp", fp(of_row(text).cast("string")))


def _keys(blocks: int, radius: int) -> list:
    """For each choice of blocks, the fingerprint with all other bits cleared."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    out = []
    for chosen in combinations(masks, blocks - radius):
        mask = sum(chosen)
        out.append(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return out


def links(fps: DataFrame, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """(a, b): which distinct fingerprints are connected. A hub of a hot key stands for its members by the
    smallest of them, so every row joins two true fingerprints."""
    keyed = fps.select("fp", F.posexplode(F.array(*_keys(blocks, RADIUS))).alias("choice", "key"))
    sizes = written(keyed.groupBy("choice", "key").agg(F.count("*").alias("m")).filter("m > 1"), "simhash-keys")
    few = keyed.join(sizes.filter(F.col("m") <= hot), ["choice", "key"])
    a, b = few.select("choice", "key", F.col("fp").alias("a")), few.select("choice", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = a.join(b, ["choice", "key"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)))
    crowd = keyed.join(sizes.filter(F.col("m") > hot), ["choice", "key"]).select("fp").distinct()
    hubs = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    least = hubs.groupBy("hub").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # a hub has 65 neighbours at most
    starred = least.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b")
    return pairs.union(starred).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with an edge. edges: a, b.

    Each round hangs the larger neighbours of every node on its smallest neighbour (large star), then the
    smaller ones (small star); it ends when a round changes nothing."""
    edges = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, now = None, ()
    while now != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        edges = written(edges.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def roots(fps: DataFrame) -> DataFrame:
    """fp and root, a fingerprint that names its component, of distinct fingerprints (a written table, column fp)."""
    found = components(links(fps.select("fp")))
    member = found.union(found.select("root", "root")).distinct()
    return fps.select("fp").join(member, fps["fp"] == member["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def clustered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (long) and component (the smallest key reachable) of each row."""
    rows = written(fingerprints(docs.select(named(key).alias("key"), named(text).alias("text"))).select(of_row("key").alias("key"), "fp"), "simhash-rows")
    fps = written(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")), "simhash-fps")
    member = written(fps.join(roots(fps), "fp"), "simhash-roots")
    component = member.groupBy("root").agg(F.min("least").alias("component"))
    facts = written(member.join(component, "root").select("fp", "n", "component"), "simhash-components")
    return joined(rows, facts, "fp").select(F.col("key").alias(key), "fp", "component")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all columns of docs: that with the smallest key, of several rows with that key the one
    with the least hash of its text, then that with the least address. Rows with a null key stay only where their component
    has no key, one for each. Only fingerprints, keys and addresses are shuffled; the rows that stay are read again where they lie."""
    at = addressed(docs)
    key_, text_ = of_row(key), of_row(text).cast("string")
    columns = [(of_row(f.name), "map<" in f.dataType.simpleString()) for f in docs.schema if f.name != text]
    rest = F.xxhash64(*(x for c, has_map in columns for x in (c.isNull(), F.to_json(F.struct(c)) if has_map else c)))  # tells where nulls stand
    order = F.struct(key_.isNull().alias("absent"), key_.alias("key"), F.xxhash64(text_).alias("text_hash"), rest.alias("rest_hash"), "file", "place")
    rows = written(fingerprints(at.select(text_.alias("text"), order.alias("order"))).select("fp", of_row("order").alias("order")), "simhash-rows")
    best = written(rows.groupBy("fp").agg(F.min("order").alias("best")), "simhash-fps")
    wanted = best.join(roots(best), "fp").groupBy("root").agg(F.min("best").alias("best")).select("best.file", "best.place")
    return flagged(at, wanted, keeps=True).filter("kept").select("row.*")
