"""Tables that several steps of an operator read: written below spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

_OWN: set[str] = set()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; only on one machine, where that is unset, below a temporary one. All of an
    application's lie in one folder, which Hadoop's file system deletes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/corpusloom-tables-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWN.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """df, computed once and written: it cuts the lineage, survives lost executors, and its rows have addresses."""
    path = shared_folder(df.sparkSession, name)
    nothing = [f.name for f in df.schema if isinstance(f.dataType, NullType)]  # columns of nulls alone, which Parquet has no type for
    typed = df.withColumns({c: F.lit(None).cast("string") for c in nothing}) if nothing else df
    typed.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(typed.schema).parquet(path)
    return found.withColumns({c: F.lit(None) for c in nothing}) if nothing else found
