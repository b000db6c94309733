"""Training items made of segments: one for each recording (or segment), with a caption of its labels only, and a card that
says what the items rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import licences
from ..functions.text import label_caption

MIXTURE = "Mixture"


def _by_frequency(small: DataFrame, name: str) -> DataFrame:
    """source and its values of `name`, the most frequent first, of equals the one that comes first by path."""
    counts = small.filter(F.col(name).isNotNull()).groupBy("source", name).agg((-F.sum("n")).alias("n"), F.min("first").alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("n", F.col("first").getField("path").alias("path"), F.col(name).alias("value"))))
    return counts.groupBy("source").agg(F.transform(listed, lambda x: x["value"]).alias(f"{name}_list"))


def items(records: DataFrame, mode: str = "sources", min_seconds: float = 10.0) -> DataFrame:
    """source, stem, caption, track_id, license, segments, seconds and families of each item. records: path, source_path,
    track_id, license, instrument_family, instrument_name, duration_seconds. In mode `segments` each row is an item, and
    those shorter than min_seconds are left out. The track and licence are those of an item's first row by path. Rows are
    counted by (source, family, name) first, so a recording of very many segments is a few rows by the time it is joined."""
    if mode not in ("sources", "segments"):
        raise ValueError(f"unknown mode {mode!r}")
    key = F.coalesce(F.nullif(F.col("source_path"), F.lit("")), F.col("path")) if mode == "sources" else F.col("path")
    label = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = records.select(key.alias("source"), label("instrument_family").alias("family"), label("instrument_name").alias("name"), "duration_seconds", F.struct("path", "track_id", "license").alias("row"))
    small = rows.groupBy("source", "family", "name").agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("seconds"), F.min("row").alias("first"))
    whole = small.groupBy("source").agg(F.sum("n").alias("segments"), F.sum("seconds").alias("seconds"), F.min("first").alias("first"), F.array_sort(F.collect_set("family")).alias("families"))
    found = whole.join(_by_frequency(small, "family"), "source", "left").join(_by_frequency(small, "name"), "source", "left")
    none = F.array().cast("array<string>")
    counted = F.filter(F.coalesce("family_list", none), lambda f: f != MIXTURE)
    file = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"(?<=.)\.[^.]*$", "")
    stem = F.replace(F.concat_ws("__", F.col("first.track_id"), file), F.lit(" "), F.lit("_"))
    out = found.select("source", stem.alias("stem"), label_caption(counted, F.coalesce("name_list", none)).alias("caption"), "first.track_id", "first.license", "segments", "seconds", "families")
    return out.filter(F.col("seconds") >= min_seconds) if mode == "segments" else out


def card(records: DataFrame, made: DataFrame, goal: str, mode: str = "sources") -> DataFrame:
    """One row about `made`, the items of records: goal, mode, items, tracks, licences (with their classes), whether any of
    them encumbers what is trained, and the sum of seconds."""
    kind = licences.licence_class(F.col("license"))
    named = records.groupBy("license").agg(F.count("*").alias("n")).withColumn("class", kind)
    one = named.agg(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce("license", F.lit("")), "class", F.col("n").cast("string")))).alias("licences"), F.coalesce(F.bool_or(F.col("class") != "permissive"), F.lit(False)).alias("encumbered"))
    counts = made.agg(F.count("*").alias("items"), F.count_distinct("track_id").alias("tracks"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 3).alias("seconds"))
    return counts.crossJoin(one).select(F.lit(goal).alias("goal"), F.lit(mode).alias("mode"), "items", "tracks", "seconds", "licences", "encumbered")  # one row each


def refuse_encumbered(records: DataFrame, licence: Column | None = None) -> None:
    """Fails, naming them, if any licence isn't permissive."""
    name = licence if licence is not None else F.col("license")
    bad = records.select(name.alias("l")).distinct().filter(licences.licence_class(F.col("l")) != "permissive")
    names = sorted(str(r["l"]) for r in bad.orderBy("l").limit(10).collect())
    if names:
        raise ValueError(f"licences that encumber what is trained: {', '.join(names)}")
