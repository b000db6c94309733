"""Checks of manifests: problems by row, problems of sets of rows, and ordered gates where the first failure counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import licences


def missing(column: Column) -> Column:
    """Null and empty text count as missing. (A zero does only in numeric fields, which callers test as numbers.)"""
    return F.coalesce(column.cast("string"), F.lit("")) == ""


def record_problems(rows: DataFrame, required: list[str]) -> DataFrame:
    """id and problem: empty required fields (a number that is zero is empty), an id with several paths (one row for each record whose path isn't the
    least), and durations that don't follow from the samples."""
    gone = lambda c: missing(F.col(c)) | (F.col(c) == 0) if isinstance(rows.schema[c].dataType, NumericType) else missing(F.col(c))
    empty = rows.select("id", F.explode(F.array_compact(F.array(*(F.when(gone(c), f"missing {c}") for c in required)))).alias("problem"))
    several = rows.groupBy("id").agg(F.min("path").alias("least"), F.max("path").alias("most")).filter("least <> most").select("id", "least")  # few
    by_id = rows.join(several, "id").filter("path <> least").select("id", F.lit("id with several paths").alias("problem"))
    off = F.abs(F.col("duration_seconds") - F.col("num_samples") / F.col("sample_rate")) > 1e-3
    return empty.unionAll(by_id).unionAll(rows.filter(off).select("id", F.lit("duration differs from samples").alias("problem")))


def provenance_gaps(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with a provenance field missing, and the first such field."""
    return rows.select("id", F.coalesce(*(F.when(missing(F.col(c)), F.lit(c)) for c in fields)).alias("field")).filter("field is not null")


def corpus_problem() -> Column:
    """The first reason for which a corpus record isn't valid, else null."""
    required = ["dataset", "track_id", "audio_path", "licence", "source_url", "duplicate_hash"]
    checks = [F.when(missing(F.col(c)), f"missing required field {c}") for c in required]
    checks += [
        F.when(~F.coalesce(F.col("split").isin("train", "val", "test"), F.lit(False)), "bad split"),
        F.when(~F.coalesce(F.col("licence_class").isin("permissive", "research-only"), F.lit(False)), "bad licence class"),
        F.when((F.col("licence_class") == "permissive") & ~F.col("licence").isin(licences.PERMISSIVE), "licence is not on the allowlist"),
        F.when(~F.col("quality_score").between(0, 1), "quality score outside [0, 1]"),
    ]
    return F.coalesce(*checks)


def refuse_invalid(rows: DataFrame) -> DataFrame:
    """rows, whose evaluation fails at the first invalid corpus record."""
    problem = corpus_problem()
    return rows.withColumn("dataset", F.when(problem.isNull(), F.col("dataset")).otherwise(F.raise_error(F.concat_ws(": ", F.col("track_id"), problem))))


def leaking(rows: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """Groups in more than one split: key, n_splits and the splits."""
    pairs = rows.select(key.alias("key"), split).distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("n_splits"), F.array_sort(F.collect_list(split)).alias("splits")).filter("n_splits > 1")


def leaking_singers(rows: DataFrame) -> DataFrame:
    """Singers in training and in any evaluation split; rows without a singer don't count."""
    seen = rows.filter("singer_id is not null").groupBy("singer_id").agg(F.bool_or(F.col("split") == "train").alias("train"), F.bool_or(F.col("split").isin("val", "valid", "validation", "test")).alias("eval"))
    return seen.filter("train and eval").select("singer_id")


def first_failure(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate whose condition (of passing) isn't true; null if all are."""
    return F.coalesce(*(F.when(~F.coalesce(passes, F.lit(False)), name) for name, passes in gates))


def funnel(judged: DataFrame, gates: list[str], failed: str = "failed_gate") -> DataFrame:
    """gate_no, gate, n_in, n_failed for every gate in order, and the admitted rows at the end."""
    counts = judged.groupBy(F.coalesce(failed, F.lit("admitted")).alias("gate")).agg(F.count("*").alias("n"))
    spark = judged.sparkSession
    order = spark.createDataFrame([(i, g) for i, g in enumerate([*gates, "admitted"])], "gate_no int, gate string")
    joined = order.join(counts, "gate", "left").select("gate_no", "gate", F.coalesce("n", F.lit(0)).cast("long").alias("n_failed"))
    rest = Window.orderBy(F.desc("gate_no")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each gate
    return joined.withColumn("n_in", F.sum("n_failed").over(rest))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included: each row counts by its sign, and no count is left."""
    both = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0").isEmpty()


def single_run(curve: DataFrame, file: str = "file") -> DataFrame:
    """Files that mix runs or repeat steps."""
    found = curve.groupBy(file).agg(F.count_distinct("run_id").alias("n_runs"), (F.count("step") - F.count_distinct("step")).alias("n_repeated"))
    return found.filter("n_runs > 1 or n_repeated > 0")


def not_deployable(rows: DataFrame, key: str, licence: str, n: int | None = None) -> DataFrame:
    """key and licence of the rows that may not be deployed; with n, the first n by key, for a report."""
    found = rows.filter(~licences.bucket(F.coalesce(F.col(licence), F.lit(""))).isin(licences.DEPLOYABLE_BUCKETS)).select(key, licence)
    return found if n is None else found.orderBy(key).limit(n)
