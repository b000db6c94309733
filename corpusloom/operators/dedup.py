"""Exact duplicates by hash. Null and empty hashes are never duplicates, and are filtered before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .addresses import ADDRESS, addressed, flagged, others
from .settled import settled


def hashed(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.coalesce(F.col(key), F.lit("")) != "")


def keep_first(rows: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """rows with `kept`: the first of each hash in the order (of rows equal in it, one), and every row without a hash. Only hashes,
    orders and addresses are shuffled; the rows themselves are read again where they lie."""
    at = addressed(rows)
    orders = [F.col("row").getField(c) if isinstance(c, str) else c for c in order]
    if any(not isinstance(c, str) for c in order):  # columns of rows, not of the nested row
        at = addressed(rows.withColumns({f"__o{i}": c for i, c in enumerate(order) if not isinstance(c, str)}))
        orders = [F.col("row").getField(c if isinstance(c, str) else f"__o{i}") for i, c in enumerate(order)]
    narrow = at.select(F.col("row").getField(key).alias("hash"), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(orders)), *ADDRESS).alias("rank"), *ADDRESS).filter(F.coalesce("hash", F.lit("")) != "")
    first = narrow.groupBy("hash").agg(F.min("rank").alias("least"), F.count("*").alias("n")).select("hash", "n", F.col("least.file").alias("first_file"), F.col("least.place").alias("first_place"))
    found = flagged(at, others(narrow.select("hash", *ADDRESS), first, ["hash"]))
    return found.select(*(F.col("row").getField(c).alias(c) for c in rows.columns), "kept")


def unique_by_path(manifests: list[DataFrame], path: str = "path") -> DataFrame:
    """The rows of several manifests, one for each path (an `all` file repeats the split files): the first manifest's, and its first
    by address."""
    from functools import reduce

    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    at = [addressed(m) for m in manifests]
    narrow = [m.select(F.col("row").getField(path).alias("path"), F.lit(k).alias("manifest"), *ADDRESS) for k, m in enumerate(at)]
    first = union(narrow).groupBy("path").agg(F.min(F.struct("manifest", *ADDRESS)).alias("least"), F.count("*").alias("n"))
    first = settled(first.filter("n > 1").select("path", "least"), "repeated-paths")
    kept = []
    for m, rows, small in zip(manifests, at, narrow):
        kept.append(flagged(rows, _later(small, first)).filter("kept").select(*(F.col("row").getField(c).alias(c) for c in m.columns)))
    return union(kept)


def _later(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Addresses of the rows of one manifest whose path another row has first."""
    met = rows.alias("r").join(first.alias("f"), F.col("r.path").eqNullSafe(F.col("f.path")))
    return met.filter(F.struct("manifest", *ADDRESS) != F.col("least")).select(*ADDRESS)


def spanning(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Hashes that occur in more than one group (dataset, split): key, n_rows, n_groups and the groups."""
    pairs = hashed(rows, key).groupBy(key, group).agg(F.count("*").alias("n"))
    return pairs.groupBy(key).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.array_sort(F.collect_list(group)).alias("groups")).filter("n_groups > 1")


def report(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """One row: fingerprinted rows, duplicate groups, rows in them, groups across splits, and whether there is none of
    those."""
    pairs = hashed(rows, key).groupBy(key, split).agg(F.count("*").alias("n"))
    groups = pairs.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("splits"))
    many, across = F.col("n") > 1, F.col("splits") > 1
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fingerprinted"), count(many).alias("duplicate_groups"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("rows_in_groups"), count(across).alias("cross_split_groups")).withColumn("ok", F.col("cross_split_groups") == 0)


def examples(rows: DataFrame, key: str, split: str = "split", n: int = 5) -> DataFrame:
    """The first n hashes that occur in several splits, for a report."""
    return spanning(rows, key, split).orderBy(key).limit(n)
