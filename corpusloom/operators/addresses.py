"""Addresses of rows: the file that a row lies in and its place there, by which equal rows differ.

A choice among wide rows is made on narrow ones (keys, orders, addresses); what it keeps or rejects becomes a bitmap for each file, and a second
scan of the same files applies the bitmaps where the rows are read. So no wide row is shuffled. Bitmaps are
broadcast while they are small (BOUND words of 64 rows). Beyond that the files are dealt into groups whose bitmaps are;
each group's result is written before the next one's bitmaps are sent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .settled import settled

BUCKET, WORD, BOUND = 32_768, 64, 1_000_000
ADDRESS = ["file", "place"]


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def addressed(df: DataFrame) -> DataFrame:
    """row (all of df), file (a hash of its path) and place. df reads Parquet files, with filters and columns of its own at most;
    anything else is written as a table first."""
    whole = F.struct(*(named(c) for c in df.columns)).alias("row")
    try:
        meta = df.metadataColumn("_metadata")
        return df.select(whole, F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("place"))
    except AnalysisException:
        return addressed(settled(df, "addressed"))


def flagged(rows: DataFrame, named_rows: DataFrame, bound: int = BOUND, keeps: bool = False) -> DataFrame:
    """The rows of `addressed` with `kept`: false for the named addresses (file, place), or true for them alone."""
    bit = F.expr(f"shiftleft(1L, cast(place % {WORD} AS int))")
    words = named_rows.groupBy("file", F.floor(F.col("place") / BUCKET).alias("bucket"), (F.floor(F.col("place") / WORD) % (BUCKET // WORD)).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    words = settled(words, "named-rows")
    n = words.count()
    if n <= bound:
        return _applied(rows, words, keeps)
    groups = -(-n // bound) * 2
    group = lambda column: F.pmod(F.xxhash64(F.lit("group"), column), F.lit(groups))
    parts = [settled(_applied(rows.filter(group(F.col("file")) == g), words.filter(group(F.col("file")) == g), keeps), "flagged-rows") for g in range(groups)]
    return reduce(DataFrame.unionByName, parts)


def _applied(rows: DataFrame, words: DataFrame, keeps: bool) -> DataFrame:
    maps = words.groupBy("file", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    placed = rows.withColumn("bucket", F.floor(F.col("place") / BUCKET)).join(F.broadcast(maps), ["file", "bucket"], "left")
    word = (F.floor(F.col("place") / WORD) % (BUCKET // WORD)).cast("int")
    bits = F.coalesce(F.try_element_at("words", word), F.lit(0).cast("long"))
    return placed.withColumn("kept", F.getbit(bits, (F.col("place") % WORD).cast("int")) == int(keeps)).drop("bucket", "words")


def others(rows: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """Addresses of the rows (keys, file, place) that aren't the first of their keys. first: keys, n (how many rows have them), and the
    address as first_file and first_place. Keys that hold over a thousandth of all rows are fewer than a thousand, so these are broadcast."""
    some = settled(first.filter("n > 1"), "repeated-keys")
    total = some.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * 1000 > total
    few = F.broadcast(some.filter(hot))
    usual = rows.join(few.select(*keys), keys, "left_anti").join(some.filter(~hot), keys)
    meeting = usual.unionByName(rows.join(few, keys))
    return meeting.filter((F.col("file") != F.col("first_file")) | (F.col("place") != F.col("first_place"))).select(*ADDRESS)
