"""What the operators of this subpackage share: tables, scratch folders, hashing."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only where that is unset (tests on one
    machine) a local temporary folder takes its place. An application's folders lie in one, which Hadoop's file system
    deletes when the driver ends; outputs that are to stay get a folder of the caller's."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/corpusloom-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWN.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


_OWN: set[str] = set()


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def nested(df: DataFrame) -> DataFrame:
    """One column `row` that holds the whole rows of df. What an operator adds beside it can't clash with a column of df,
    and `row.*` gives df's columns back."""
    return df.select(F.struct(*(named(c) for c in df.columns)).alias("row"))


def of_row(name: str) -> Column:
    """A column of the nested row."""
    return F.col("row").getField(name)


def smallest(df: DataFrame, order: Column, n: int) -> DataFrame:
    """The n rows that come first by `order`, a hash (long). Rows above a cut are left out before the sort, so that about
    2 n rows meet in one place, however many partitions hold them."""
    total = df.count()
    share = 2.0 * n / max(total, 1)
    while share < 1:
        some = df.filter(order < F.lit(int(-(1 << 63) + share * (1 << 64))))
        if some.count() >= n:
            return some.orderBy(order).limit(n)
        share *= 2
    return df.orderBy(order).limit(n)


def joined(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows ⋈ facts on key, without facts' count n. facts: a written table, a row for each key and n, how many of rows have it. Keys
    that hold over a thousandth of all rows are fewer than a thousand, so these are broadcast; the others are shuffled."""
    total = facts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * 1000 > total
    hot = F.broadcast(facts.filter(is_hot).drop("n"))
    usual = rows.join(hot.select(key), key, "left_anti").join(facts.filter(~is_hot).drop("n"), key)
    return usual.unionByName(rows.join(hot, key))


def shipped(spark: SparkSession, path: str) -> str:
    """path, whose file every executor gets too: workers read it by `local_path`."""
    if not any(x.rsplit("/", 1)[-1] == os.path.basename(path) for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return path


def local_path(path: str) -> str:
    """In a task: the file at path, or the copy that `shipped` has sent."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def ascii_words(text: str) -> list[str]:
    """The words of a text; str.split() alone would also split at other white space."""
    if text.isascii():
        odd = any(c in text for c in _OTHER_SPACE[:4])
    else:
        odd = any(c in text for c in _OTHER_SPACE)
    return [w for w in text.translate(_BLANKS).split(" ") if w] if odd else text.split()


#: What str.split() takes for white space beside ASCII_SPACE; the first four are ASCII.
_OTHER_SPACE = [c for c in map(chr, range(0x10000)) if c.isspace() and c not in ASCII_SPACE]
_BLANKS = {ord(c): " " for c in ASCII_SPACE}

#: Lower-cases A to Z alone.
LOWER_AZ = {c: c + 32 for c in range(65, 91)}


def column(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts(batch, name: str = "text") -> Iterator[str]:
    return (x if x is not None else "" for x in column(batch, name))


def held_out(key: str = "doc_id", folds: int = 5, rest: int = 0):
    """True for the rows that no model may learn labels from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == rest, F.lit(True))


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each 64-bit value (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def cell(n: int, *columns: str | Column):
    """A number below n that depends on the given columns, for dealing rows out evenly."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
