"""The three workloads end to end: raw audio to a leak-free manifest, a catalogue to a captioned training set, and
admission with an originality screen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import stable_id, track_from_path
from ..functions.text import humanise, narrative_caption
from ..operators import audio, dedup, gates, select, similarity, splits, validate
from ..sources import manifest


def segment_manifest(spark: SparkSession, root: str, out: str, dataset: str, licence: str, rate: int = 8000, seconds: float = 1.0, ratios: dict[str, float] = splits.RATIOS) -> dict[str, DataFrame]:
    """Audio below a root to segments with splits by weight. The decoded table is written once; what follows reads narrow
    columns of it."""
    files = manifest.find_audio(spark, root, [".wav"])
    audio.preprocessed(files, rate=rate, seconds=seconds).write.mode("overwrite").parquet(f"{out}/decoded")
    decoded = spark.read.parquet(f"{out}/decoded")
    rejects = decoded.filter("not ok").select("path", "stage", "reason", "segment_index")
    own = decoded.filter("ok").drop("ok", "stage", "reason")
    rows = own.withColumns({"track_id": track_from_path(F.col("path")), "source": F.lit(dataset), "license": F.lit(licence), "source_path": F.col("path")})
    rows = rows.withColumn("id", stable_id(F.col("source"), F.col("track_id"), F.col("source_path"), F.col("segment_index"), F.col("start_sample")))
    plan = splits.by_weight(rows, "track_id", "duration_seconds", ratios=ratios)
    assigned = splits.assign(rows, plan, "track_id")
    return {"segments": assigned, "rejects": rejects, "leaks": validate.leaking(assigned, F.col("track_id")), "duplicates": dedup.report(assigned, "audio_sha256")}


def training_set(catalogue: DataFrame, listing: DataFrame, target: int) -> DataFrame:
    """Cleared, available and value-ranked tracks with captions. catalogue: track_id, licence, duration, bit_rate,
    genre_top, score, instruments."""
    cleared = gates.reject_reason(catalogue).filter("reject_reason is null")
    chosen = select.value_ranked(cleared.join(listing.select("track_id").distinct(), "track_id", "left_semi"), target)
    return chosen.withColumn("caption", narrative_caption(F.col("track_id"), F.lit("medium"), F.col("genre_top"), F.lit(None).cast("string"), F.col("instruments"))).withColumn("listed", humanise(F.col("instruments")))


def admission(records: DataFrame, candidates: DataFrame, db: DataFrame, windows: DataFrame, db_windows: DataFrame, dim: int = 12) -> tuple[DataFrame, DataFrame]:
    """(records with the first failed gate, verdicts of the screen)."""
    found = similarity.by_blocks(windows, db_windows, dim)
    return gates.admitted(records), similarity.screen(candidates, found, similarity.exact(candidates, db))
