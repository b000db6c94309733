"""Admission: ten gates for each record, and seven for a whole manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import licences
from . import dedup, validate

GATES = ["licence", "provenance", "cross_corpus_duplicate", "integrity_decode", "silence", "clipping_quality", "split_leakage", "metadata", "rich_caption", "deployability"]
#: The fields a goal needs: fixed values.
GOALS = {"instrument-realism": ["instrument_family"], "arrangement": ["instrument_family"], "vocal": ["singer_id"], "genre": [], "generic": []}


def admitted(records: DataFrame, min_seconds: float = 1.0, max_clipping: float = 0.01, min_words: int = 4) -> DataFrame:
    """records with `failed_gate`, the first of the ten that a record fails, else null. records: id, dataset, licence,
    source_url, duplicate_hash, track_id, split, duration_seconds, silent, clipping_ratio, quality_score, caption.

    Two facts need other records: in how many datasets a hash occurs, and in how many splits a track. Both are
    aggregated to narrow rows and joined back; a hash or track that many records share is one row by then."""
    hashes = dedup.spanning(records, "duplicate_hash", "dataset").select("duplicate_hash", F.lit(True).alias("repeated"))
    tracks = validate.leaking(records, F.col("track_id")).select(F.col("key").alias("track_id"), F.lit(True).alias("leaks"))
    joined = records.join(hashes, "duplicate_hash", "left").join(tracks, "track_id", "left")
    bucket = licences.bucket(F.col("licence"))
    checks = [
        ("licence", bucket != "other_unknown"),
        ("provenance", ~validate.missing(F.col("dataset")) & ~validate.missing(F.col("source_url"))),
        ("cross_corpus_duplicate", F.col("repeated").isNull()),
        ("integrity_decode", F.col("duration_seconds") >= min_seconds),
        ("silence", ~F.col("silent")),
        ("clipping_quality", F.col("clipping_ratio") <= max_clipping),
        ("split_leakage", F.col("leaks").isNull()),
        ("metadata", F.col("quality_score").isNotNull()),
        ("rich_caption", F.size(F.split(F.trim(F.coalesce("caption", F.lit(""))), " +")) >= min_words),
        ("deployability", bucket.isin(licences.DEPLOYABLE_BUCKETS)),
    ]
    return joined.withColumn("failed_gate", validate.first_failure(checks)).drop("repeated", "leaks")


def dataset_gates(rows: DataFrame, goal: str = "generic", min_seconds: float = 1.0) -> DataFrame:
    """gate, passed, n_bad of the seven gates over a manifest, from one pass of conditional counts and three grouped
    checks."""
    bad = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    gone = validate.missing
    one = rows.agg(
        F.count("*").alias("n"),
        bad(~F.coalesce(F.col("license").isin(licences.DEPLOYABLE), F.lit(False))).alias("LICENSE"),
        bad(gone(F.col("license")) | gone(F.col("source"))).alias("PROVENANCE"),
        bad(F.col("silent") | (F.col("clipping_ratio") > 0.01)).alias("QUALITY"),
        *(bad(~gone(F.col(c))).alias(f"has_{c}") for c in GOALS[goal]),
        bad(~gone(F.col("source_path"))).alias("sources"),
        bad(~gone(F.col("instrument_family")) | (F.size("tags") > 0)).alias("captionable"),
    )
    duplicates = dedup.spanning(rows, "audio_sha256", "split").agg(F.count("*").alias("DUPLICATE"))
    tracks = validate.leaking(rows, F.col("track_id")).agg(F.count("*").alias("t"))
    singers = validate.leaking_singers(rows).agg(F.count("*").alias("s"))
    whole = one.crossJoin(duplicates).crossJoin(tracks).crossJoin(singers)  # one row each
    lacking = reduce(lambda a, b: a + b, ((F.col(f"has_{c}") / F.greatest("n", F.lit(1)) < 0.95).cast("long") for c in GOALS[goal]), F.lit(0).cast("long"))
    n_bad: dict[str, Column] = {
        "LICENSE": F.col("LICENSE"), "PROVENANCE": F.col("PROVENANCE"), "DUPLICATE": F.col("DUPLICATE"), "QUALITY": F.col("QUALITY"), "METADATA": lacking, "SPLIT-LEAKAGE": F.col("t") + F.col("s"),
        "FORMAT": ((F.col("sources") == 0) | (F.col("captionable") == 0)).cast("long"),
    }
    return whole.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), c.cast("long").alias("n_bad")) for g, c in n_bad.items()))).alias("x")).select("x.gate", (F.col("x.n_bad") == 0).alias("passed"), "x.n_bad")


def verdict(gates: DataFrame) -> DataFrame:
    """all-pass; research-only if the licence alone fails; else blocked."""
    failed = gates.agg(F.sum((~F.col("passed")).cast("int")).alias("n"), F.bool_or((F.col("gate") == "LICENSE") & ~F.col("passed")).alias("licence"))
    return failed.select(F.when(F.col("n") == 0, "all-pass").when((F.col("n") == 1) & F.col("licence"), "research-only").otherwise("blocked").alias("verdict"))


def reject_reason(tracks: DataFrame, excluded: list[str] = ("Spoken",)) -> DataFrame:
    """tracks with the first reason against a catalogue track, else null. tracks: licence, duration, bit_rate, genre_top."""
    return tracks.withColumn(
        "reject_reason",
        validate.first_failure(
            [
                ("license", licences.bucket(F.col("licence")).isin(licences.DEPLOYABLE_BUCKETS)),
                ("duration", F.col("duration").between(30, 600)),
                ("bitrate", ~((F.col("bit_rate") > 0) & (F.col("bit_rate") < 128_000))),
                ("genre_excluded", ~F.trim(F.coalesce("genre_top", F.lit(""))).isin(list(excluded))),
            ]
        ),
    )


def trainer_filter(rows: DataFrame, present: DataFrame, min_seconds: float, key: str = "track_id") -> DataFrame:
    """rows with the first reason against training on them: licence, short, missing audio."""
    there = rows.join(present.select(key).distinct().withColumn("__there", F.lit(True)), key, "left")
    passes = [("licence", F.col("licence").isin(licences.PERMISSIVE)), ("short", F.col("duration_seconds") >= min_seconds), ("missing_audio", F.col("__there").isNotNull())]
    return there.withColumn("reject_reason", validate.first_failure(passes)).drop("__there")

