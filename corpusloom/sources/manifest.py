"""Manifests as JSON Lines, catalogues and sheets as CSV, audio trees as binary files, registries and prompts as small
tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import review, validate
from ..operators.reports import manifest_summary
from ..schemas import CORPUS
from . import readers

JUNK = r"(^|/)(\._[^/]*|__MACOSX(/.*)?)$|(^|/)__MACOSX/"


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a JSON Lines manifest. Blank lines are passed over; unknown keys are kept as JSON text in
    `extra`; missing optional keys are null. Rejects carry the file, the number of the line (from 1, blank ones counted) and
    its text; only the files that have any are numbered."""
    fields = StructType.fromDDL(schema)
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    held = StructType([*fields.fields, *StructType.fromDDL("_corrupt string").fields])

    def parsed(rows: DataFrame) -> DataFrame:
        raw = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
        rec = F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        return rows.withColumns({"raw": raw, "rec": rec}).withColumn("bad", F.col("raw").isNull() | F.col("rec").isNull() | F.col("rec._corrupt").isNotNull())

    full = F.trim("value") != ""
    known = F.array(*map(F.lit, fields.names))
    extra = F.map_filter("raw", lambda k, v: ~F.array_contains(known, k))
    columns = [F.col(f"rec.{n}").alias(n) if n != "extra" else F.map_concat(F.coalesce("rec.extra", F.create_map().cast("map<string,string>")), extra).alias("extra") for n in fields.names]
    every = parsed(lines.filter(full))
    files = every.filter("bad").select("file").distinct()
    own = lines.join(files, "file", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    sizes = own.groupBy("file", "block").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).drop("n")
    rejects = parsed(own.filter(full)).filter("bad").join(starts, ["file", "block"])
    return every.filter("not bad").select(*columns), rejects.select("file", (F.col("start") + F.col("place")).cast("long").alias("line_no"), F.col("value").alias("line"))


def refuse_rejects(rejects: DataFrame) -> None:
    """Fails at the first malformed line, naming its file and number."""
    first = rejects.orderBy("file", "line_no").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['file']}:{first[0]['line_no']}: malformed line {first[0]['line'][:80]!r}")


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON Lines with sorted keys and explicit nulls."""
    rows.select(*sorted(rows.columns)).write.option("ignoreNullFields", "false").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report's row as nested JSON, nulls and all."""
    report.coalesce(1).write.option("ignoreNullFields", "false").json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report's row again, structs and maps as they were."""
    return spark.read.schema(schema).json(path)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each split below `path`/manifests (readers of all splits read that), and the summary of all and of each
    beside them."""
    rows.repartition(split, F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(16))).write.option("ignoreNullFields", "false").partitionBy(split).json(f"{path}/manifests")
    manifest_summary(rows).coalesce(1).write.option("ignoreNullFields", "false").json(f"{path}/summary")


def write_corpus(rows: DataFrame, path: str) -> int:
    """Writes a corpus manifest, or fails at the first invalid row. The number of rows."""
    from pyspark.sql import Observation

    seen = Observation("corpus")
    write_lines(validate.refuse_invalid(rows).observe(seen, F.count("*").alias("n")), path)
    return int(seen.get["n"])


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """A corpus manifest. A malformed line fails at once, an invalid record when it is read."""
    good, bad = read_lines(spark, path, schema)
    refuse_rejects(bad)
    return validate.refuse_invalid(good)


def read_catalogue(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """CSV files with two header rows (group, field) and a row of index labels, as `group.field` string columns. Headers are told
    by place: a data row may equal one. The third row is data if any cell behind the first is filled; strict keeps rows
    with a numeric id only."""
    readers.register(spark)
    return spark.read.format("catalogue").option("strict", strict).load(path)


def find_audio(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """path, length, modificationTime, content of the audio files below a root, without what archives leave behind.
    Spark's source doesn't list empty files; `audio_tree` does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ending = F.lower(F.regexp_extract("path", r"\.[^./]*$", 0))
    return files.filter(ending.isin(suffixes) & ~F.col("path").rlike(JUNK))


def audio_tree(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """path, length, modificationTime, place, content of the audio files below a root in order of their paths (`place`, from 0), empty
    ones too. Needs a root that Arrow's file systems open."""
    readers.register(spark)
    return spark.read.format("audio_tree").option("suffixes", ",".join(suffixes)).load(root)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A review sheet as strings; `review.long_sheet` reads its cells."""
    sheet = spark.read.csv(path, header=True, inferSchema=False)
    return sheet.withColumnRenamed(sheet.columns[0], "track")


def bad_cells(sheet: DataFrame) -> DataFrame:
    """The cells of a sheet that are neither blank, N/A nor a score: track, dimension, cell."""
    return review.long_sheet(sheet, keep_cell=True).filter("state = 'bad'").select("track", "dimension", "cell")


def read_history(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the JSON Lines history of a run."""
    return read_lines(spark, path, schema)


def read_curve(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A training curve; cells that aren't numbers are null. The file's name is kept."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(F.col("_metadata.file_path").alias("file"), *(F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in raw.columns))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """The prompt file itself: JSON with `defaults` and `prompts`, or a list of entries. The driver reads it: a file that people write."""
    content = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    entries, defaults = (content.get("prompts", []), content.get("defaults", {})) if isinstance(content, dict) else (content, {})
    return load_prompts(spark, entries, defaults)


def load_prompts(spark: SparkSession, entries: list[dict], defaults: dict) -> DataFrame:
    """Prompt entries with defaults applied and white space collapsed. Repeated ids are an error."""
    ids = [e["id"] for e in entries]
    if len(set(ids)) < len(ids):
        raise ValueError(f"repeated ids: {sorted({i for i in ids if ids.count(i) > 1})}")
    rows = [json.dumps(defaults | e) for e in entries]
    text = spark.createDataFrame([(r,) for r in rows], "value string")
    out = text.select(F.from_json("value", "id string, title string, category string, heldout boolean, prompt string, lyrics string, seed long, duration_seconds double, bpm int, key string, genre array<string>, mood array<string>, instruments array<string>").alias("p")).select("p.*")
    return out.withColumn("prompt", F.trim(F.regexp_replace("prompt", r"\s+", " "))).withColumn("heldout", F.coalesce("heldout", F.lit(False)))


def load_registry(spark: SparkSession, datasets: dict[str, dict], default_order: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(datasets, problems) of a registry: dataset_id, problem for missing fields and unknown ids of the order."""
    schema = "dataset_id string, name string, source_url string, license_name string, requires_user_acceptance boolean, gated boolean"
    table = spark.createDataFrame([(i, d.get("name"), d.get("source_url"), d.get("license_name"), bool(d.get("requires_user_acceptance")), bool(d.get("gated"))) for i, d in sorted(datasets.items())], schema)
    lacking = table.select("dataset_id", F.explode(F.array_compact(F.array(*(F.when(validate.missing(F.col(c)), f"missing {c}") for c in ("source_url", "license_name"))))).alias("problem"))
    order = spark.createDataFrame([(i,) for i in default_order], "dataset_id string")
    return table.withColumn("name", F.coalesce("name", "dataset_id")), lacking.union(order.join(table, "dataset_id", "left_anti").select("dataset_id", F.lit("unknown dataset in order").alias("problem")))


def needing_acceptance(registry: DataFrame) -> DataFrame:
    return registry.filter("requires_user_acceptance or gated").select("dataset_id")


def with_provenance(rows: DataFrame, registry: DataFrame, dataset: str = "source") -> DataFrame:
    """rows with a provenance struct of their dataset; the name defaults to the id."""
    known = registry.select(F.col("dataset_id").alias(dataset), F.struct("dataset_id", "name", "source_url", "license_name", (F.col("requires_user_acceptance") | F.col("gated")).alias("requires_user_acceptance")).alias("provenance"))
    return rows.join(known, dataset, "left")


def export_training(rows: DataFrame, path: str) -> None:
    """Trainer rows (sharded JSON) and, beside them, one row of metadata."""
    out = rows.select("audio_path", F.element_at(F.split("audio_path", "/"), -1).alias("filename"), "caption", "lyrics", (F.coalesce("lyrics", F.lit("")) == "").alias("is_instrumental"), F.col("duration_seconds").alias("duration"), "language", (F.coalesce("caption", F.lit("")) != "").alias("labeled"))
    out.write.json(f"{path}/samples")
    out.agg(F.count("*").alias("num_samples"), F.round(F.sum("duration"), 3).alias("total_seconds"), F.sum(F.col("is_instrumental").cast("long")).alias("instrumental")).write.json(f"{path}/metadata")
