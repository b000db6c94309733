"""Tables that streams keep: upserts by key, increments with a commit log, and files that are retired.

Each batch of a stream writes folders named by its id, and then commits by an entry in a log beside them. A batch that is tried
again after a failure, or replayed, finds its entry and does nothing, or finds none and writes its folders anew; readers
take what is committed. So whatever is interrupted, a table holds every batch once. The log has a small file for each batch, which
each batch lists.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parsed_log
from ..operators.settled import settled

LOG, BUCKETS = "_commits", 64


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def commits(spark: SparkSession, table: str) -> dict[int, dict]:
    """The log of a table: an entry for each committed batch."""
    fs, where = _hadoop(spark, f"{table}/{LOG}")
    if not fs.exists(where):
        return {}
    names = [x.getPath().toString() for x in fs.listStatus(where) if x.getPath().getName().endswith(".json")]
    entries = (json.loads(r["value"]) for r in spark.read.text(names, wholetext=True).collect()) if names else ()
    return {e["batch"]: e for e in entries}


def commit(spark: SparkSession, table: str, batch: int, **facts) -> None:
    """Adds an entry, whole or not at all: a file under another name is renamed."""
    fs, final = _hadoop(spark, f"{table}/{LOG}/{batch}.json")
    _, draft = _hadoop(spark, f"{table}/{LOG}/.{batch}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"batch": batch, **facts}).encode()))
    out.close()
    fs.rename(draft, final)


# Upserts


def upsert(batch: DataFrame, number: int, table: str, key: str, merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Merges the rows of a batch into a table with a row for each key. merge: from rows, several for a key, to one for each. Keys lie in
    buckets; a batch writes the buckets that it changes, each in a folder for the batch, from those that the batches before it left."""
    spark = batch.sparkSession
    log = commits(spark, table)
    if number in log:
        return
    rows = settled(merge(batch).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "upsert")
    touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # `buckets` at most
    old = _latest(spark, table, log)
    if old is not None:
        rows = rows.unionByName(old.filter(F.col("bucket").isin(touched)), allowMissingColumns=True)
    new = merge(rows.drop("bucket")).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={number}")
    commit(spark, table, number, buckets=touched)


def _latest(spark: SparkSession, table: str, log: dict[int, dict]) -> DataFrame | None:
    newest: dict[int, int] = {}
    for number in sorted(log):
        newest.update(dict.fromkeys(log[number]["buckets"], number))
    paths = [f"{table}/batch={n}/bucket={b}" for b, n in sorted(newest.items())]
    return spark.read.option("basePath", table).parquet(*paths).drop("batch") if paths else None


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of an upserted table; None before the first batch that had any."""
    found = _latest(spark, table, commits(spark, table))
    return None if found is None else found.drop("bucket")


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Removes buckets that none of the last `keep` states of an upserted table reads. How many."""
    log = commits(spark, table)
    numbers = sorted(log)
    read: set[tuple[int, int]] = set()
    for upto in numbers[-keep:]:
        newest: dict[int, int] = {}
        for n in numbers:
            if n <= upto:
                newest.update(dict.fromkeys(log[n]["buckets"], n))
        read |= {(n, b) for b, n in newest.items()}
    gone = [(n, b) for n in numbers for b in log[n]["buckets"] if (n, b) not in read]
    return sum(fs.delete(where, True) for fs, where in (_hadoop(spark, f"{table}/batch={n}/bucket={b}") for n, b in gone))


# The monitor's table


def summarized(lines: DataFrame, n: int = 3, chars: int = 300) -> DataFrame:
    """What of each run's lines can be merged: the latest numbers with their lines, peaks, counts, and the last n errors."""
    p = parsed_log(lines)
    latest = [F.max(F.when(F.col(c).isNotNull(), F.struct("line_no", F.col(c).alias("value")))).alias(c) for c in ("step", "epoch", "loss", "grad_norm")]
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("line_no")))
    errors = p.filter("is_error").select("run_id", "line_no", F.expr(f"right(trim(line), {chars})").alias("line")).withColumn("rank", rank).filter(F.col("rank") <= n)
    last = errors.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("last_errors"))
    out = p.groupBy("run_id").agg(*latest, F.max("loss").alias("peak_loss"), F.max("grad_norm").alias("peak_grad_norm"), F.sum(F.col("is_error").cast("long")).alias("n_errors"))
    return out.join(last, "run_id", "left").withColumn("last_errors", F.coalesce("last_errors", F.array().cast("array<struct<line_no:long,line:string>>")))


def joined_summaries(rows: DataFrame, n: int = 3) -> DataFrame:
    """Summaries of several parts of a run's lines as one."""
    tops = [F.max(c).alias(c) for c in ("step", "epoch", "loss", "grad_norm", "peak_loss", "peak_grad_norm")]
    errors = F.slice(F.reverse(F.array_sort(F.array_distinct(F.flatten(F.collect_list("last_errors"))))), 1, n)
    return rows.groupBy("run_id").agg(*tops, F.sum("n_errors").alias("n_errors"), F.reverse(errors).alias("last_errors"))


def monitor_table(lines: DataFrame, table: str, checkpoint: str):
    """Keeps the monitor's state of a stream of log lines (run_id, line_no long, line) as an upserted table. The query, which stops once
    all lines present are done."""

    def step(batch: DataFrame, number: int) -> None:
        upsert(summarized(batch), number, table, "run_id", joined_summaries)

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monitored(spark: SparkSession, table: str) -> DataFrame:
    """run_id, the monitor's columns, stage and errors, as `jobs.monitor` and `jobs.last_errors` give them for all lines."""
    rows = current(spark, table)
    stage = F.when((F.col("n_errors") == 0) & F.col("step").isNotNull(), "training").when(F.col("n_errors") > 0, "failed").when(F.col("step").isNotNull(), "stopped").otherwise("starting")
    return rows.select("run_id", *(F.col(f"{c}.value").alias(c) for c in ("step", "epoch", "loss", "grad_norm")), "peak_loss", "peak_grad_norm", "n_errors", F.transform("last_errors", lambda x: x["line"]).alias("errors")).withColumn("stage", stage)


# Increments


def increment(batch: DataFrame, number: int, table: str, key: str, work: Callable[[DataFrame], DataFrame], problem: str = "problem") -> dict:
    """Appends the work on a batch's new keys to a table, once. work may add a column `problem`: rows that have one there go
    to quarantine (`table`/_quarantine), as do rows without a key, and their keys may come again. The commit's entry."""
    spark = batch.sparkSession
    log = commits(spark, table)
    if number in log:
        return log[number]
    fresh = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
    done = [f"{table}/batch={n}" for n, e in sorted(log.items()) if e["done"]]
    if done:
        fresh = fresh.join(spark.read.parquet(*done).select(key), key, "left_anti")
    found = work(fresh)
    found = settled(found if problem in found.columns else found.withColumn(problem, F.lit(None).cast("string")), "increment")
    keyless = batch.filter(F.col(key).isNull()).withColumn(problem, F.lit("no key"))
    failed = settled(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [found.filter(F.col(problem).isNotNull()), keyless]), "quarantine")
    good = found.filter(F.col(problem).isNull()).drop(problem)
    good.write.mode("overwrite").parquet(f"{table}/batch={number}")
    failed.write.mode("overwrite").parquet(f"{table}/_quarantine/batch={number}")
    counts = failed.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    n = spark.read.parquet(f"{table}/batch={number}").count()
    commit(spark, table, number, done=n, failed=counts[0] - counts[1], without_key=counts[1])
    return commits(spark, table)[number]


def committed(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of a table of increments, without those of a batch that stopped before its commit; None if there are none."""
    paths = [f"{table}/batch={n}" for n, e in sorted(commits(spark, table).items()) if e["done"]]
    return spark.read.parquet(*paths) if paths else None


# Retention


def marked(files: DataFrame, old: Column, log: str, number: int) -> int:
    """First phase: tombstones. Writes the paths of the old files (column path) and commits them; nothing is removed yet. How many."""
    spark = files.sparkSession
    entries = commits(spark, log)
    if number not in entries:
        files.filter(old).select("path").distinct().write.mode("overwrite").parquet(f"{log}/marked={number}")
        commit(spark, log, number, files=spark.read.parquet(f"{log}/marked={number}").count())
        entries = commits(spark, log)
    return entries[number]["files"]


def removed(spark: SparkSession, log: str, at_once: int = 1_000) -> int:
    """Second phase: tasks remove the files of committed tombstones that aren't done yet, and list what is gone. A run that was stopped
    is finished by the next; a file that is gone already counts as removed. How many."""
    numbers = sorted(commits(spark, log))
    if not numbers:
        return 0
    paths = reduce(DataFrame.unionByName, [spark.read.parquet(f"{log}/marked={n}") for n in numbers]).distinct()
    fs, where = _hadoop(spark, f"{log}/_removed")
    if fs.exists(where):
        paths = paths.join(spark.read.schema("path string").parquet(f"{log}/_removed"), "path", "left_anti")
    n = paths.count()
    if n:
        gone = paths.repartition(-(-n // at_once)).mapInArrow(_remove, "path string")
        gone.write.mode("append").parquet(f"{log}/_removed")
    return n


def _remove(batches):
    import pyarrow as pa

    from ..sources.readers import located

    for b in batches:
        for uri in b.column(0).to_pylist():
            system, path = located(uri)
            if system.get_file_info(path).is_file:
                system.delete_file(path)
        yield pa.RecordBatch.from_arrays([b.column(0)], names=["path"])
