"""Exact distinct counts that merge: values get dense numbers, and sets of them are bitmaps.

A dictionary numbers the distinct values of a column; it only grows, so yesterday's numbers hold today. A group's set is a
bitmap for each bucket of 32,768 numbers (4 KB), built by partial aggregates. Bitmaps of several days, or of several groups, are
OR-ed, and their bits counted: no row is expanded for each count, and nothing is counted again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settled import settled

CELLS = 256


def numbered_values(rows: DataFrame, column: str, old: DataFrame | None = None) -> DataFrame:
    """column and number: gapless from 0 over the distinct values, after those of an older dictionary, which are kept. Values are numbered
    within hashed cells, behind the counts of earlier cells."""
    fresh = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    first = 0
    if old is not None:
        fresh = fresh.join(old.select(column), column, "left_anti")
        first = (old.agg(F.max("number")).first()[0] if old.count() else -1) + 1
    placed = settled(fresh.withColumn("cell", F.pmod(F.xxhash64(column), F.lit(CELLS)).cast("int")), "values")
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"))
    before = counts.select("cell", (F.sum("n").over(Window.orderBy("cell")) - F.col("n")).alias("before"))  # a row for each cell
    number = F.row_number().over(Window.partitionBy("cell").orderBy(column)) - 1
    new = placed.withColumn("nth", number).join(F.broadcast(before), "cell").select(column, (F.col("nth") + F.col("before") + first).cast("long").alias("number"))
    return new if old is None else old.select(column, "number").unionByName(new)


def bitmaps(rows: DataFrame, groups: list[str], column: str, numbers: DataFrame | None = None) -> DataFrame:
    """groups, bucket and bits: the set of column's values (nulls aside) in each group."""
    pairs = rows.filter(F.col(column).isNotNull()).select(*groups, column).distinct()
    numbers = numbered_values(rows, column) if numbers is None else numbers
    placed = pairs.join(numbers, column)
    return placed.groupBy(*groups, F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def merged(parts: list[DataFrame], groups: list[str]) -> DataFrame:
    """Bitmaps of several parts (by one dictionary) as one; with fewer groups than they have, of their unions."""
    return reduce(DataFrame.unionByName, parts).groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(sets: DataFrame, groups: list[str], name: str) -> DataFrame:
    """groups and how many values each has; without groups one row."""
    small = sets if groups else merged([sets], [])
    return small.groupBy(*groups).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))
