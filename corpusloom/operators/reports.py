"""Counts and shares over manifests and catalogues. Distincts are exact; several of them are counted after a
pre-aggregation to their combinations, so rows aren't expanded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import licences
from .distincts import bitmaps, counted
from .settled import settled


def licence_census(tracks: DataFrame) -> DataFrame:
    """bucket, tracks, hours, gigabytes: every bucket, empty ones too. tracks: licence, duration, bit_rate (0: 320000)."""
    rate = F.coalesce(F.nullif(F.col("bit_rate"), F.lit(0.0)), F.lit(320_000.0))
    sums = tracks.groupBy(licences.bucket(F.col("licence")).alias("bucket")).agg(F.count("*").alias("tracks"), F.sum("duration").alias("s"), F.sum(F.col("duration") * rate).alias("b"))
    whole = tracks.sparkSession.createDataFrame([(b,) for b in licences.ALL_BUCKETS], "bucket string")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return whole.join(sums, "bucket", "left").select("bucket", F.coalesce("tracks", F.lit(0)).cast("long").alias("tracks"), F.round(zero(F.col("s")) / 3600, 1).alias("hours"), F.round(zero(F.col("b")) / 8 / 1e9, 3).alias("gigabytes"))


def rollup_top(rows: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """group, item, count, rank: the n most frequent items of each group (by name if equal) and the group's total, whose
    item is null and rank 0."""
    counts = rows.groupBy(group, item).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item))).filter(F.col("rank") <= n)
    total = counts.groupBy(group).agg(F.sum("n").alias("n")).select(group, F.lit(None).cast("string").alias(item), "n", F.lit(0).alias("rank"))
    return ranked.unionByName(total)


def rollup_set(rows: DataFrame, group: str, chosen: list[str], tops: dict[str, int], seconds: str = "duration", size: Column | None = None) -> DataFrame:
    """dimension, item, n, rank, hours and gigabytes of several groups taken together: for each dimension of `tops` its most frequent
    items (by name if equal; blank ones as `(none)`), and a row with rank 0 and no dimension for the whole. One pass: rows are counted by
    all dimensions first."""
    names = list(tops)
    label = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("(none)")).alias(c)
    some = rows.filter(F.col(group).isin(chosen)).select(*map(label, names), F.col(seconds).alias("s"), (F.lit(0.0) if size is None else size).alias("b"))
    counts = some.groupBy(*names).agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("b").alias("b"))
    items = counts.unpivot(["n"], names, "dimension", "item").groupBy("dimension", "item").agg(F.sum("n").alias("n"))
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "item")))
    most = F.coalesce(*(F.when(F.col("dimension") == c, F.lit(k)) for c, k in tops.items()))
    best = ranked.filter(F.col("rank") <= most).select("dimension", "item", "n", "rank", F.lit(None).cast("double").alias("hours"), F.lit(None).cast("double").alias("gigabytes"))
    none = F.lit(None).cast("string")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return best.unionByName(counts.agg(none.alias("dimension"), none.alias("item"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.lit(0).alias("rank"), F.round(zero("s") / 3600, 1).alias("hours"), F.round(zero("b") / 1e9, 3).alias("gigabytes")))


def selection_report(selection: DataFrame, rejected: dict[str, int], criteria: dict[str, str], genre: str = "genre_top") -> DataFrame:
    """One nested row on a selection: counts, hours, gigabytes, genres by frequency, rejects and criteria. `write_report` stores it."""
    named = F.coalesce(F.nullif(F.trim(F.col(genre)), F.lit("")), F.lit("(untagged)"))
    rate = F.coalesce(F.nullif(F.col("bit_rate").cast("double"), F.lit(0.0)), F.lit(320_000.0))
    sums = selection.groupBy(named.alias("genre")).agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("s"), F.sum(F.col("duration_seconds") * rate / 8).alias("b"), F.count_if("needs_license_reverify").alias("r"))
    by = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "genre", "n")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    pairs = lambda d, kind: F.map_from_entries(F.array(*(F.struct(F.lit(k), F.lit(v)) for k, v in d.items()))) if d else F.lit(None).cast(f"map<string,{kind}>")
    out = sums.agg(total("n").alias("selected"), F.round(total("s") / 3600, 1).alias("hours"), F.round(total("b") / 1e9, 1).alias("estimated_gb"), total("r").alias("needing_reverify"), F.transform(by, lambda x: F.struct(x["genre"].alias("genre"), x["n"].alias("n"))).alias("per_genre"))
    return out.withColumns({"rejected": pairs(rejected, "int"), "criteria": pairs(criteria, "string")})


def manifest_summary(rows: DataFrame) -> DataFrame:
    """Segments, tracks, singers, seconds and silent segments, overall (split null) and by split; sources and licences
    overall only. Distincts are bits of each split's sets, and of their union."""
    sums = rows.groupBy("split").agg(F.count("*").alias("segments"), F.sum("duration_seconds").alias("s"), F.sum(F.col("silent").cast("int")).alias("q"), F.collect_set("source").alias("sources"), F.collect_set("license").alias("licences"))
    sets = {"tracks": settled(bitmaps(rows, ["split"], "track_id"), "tracks"), "singers": settled(bitmaps(rows, ["split"], "singer_id"), "singers")}
    by_split, all_ = sums, sums.agg(F.sum("segments").alias("segments"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"), F.array_distinct(F.flatten(F.collect_list("licences"))).alias("licences"))
    for name, bits in sets.items():
        mine = counted(bits, ["split"], name).withColumnRenamed("split", "of")
        by_split = by_split.join(mine, F.col("split").eqNullSafe(F.col("of")), "left").drop("of").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
        all_ = all_.crossJoin(counted(bits, [], name))  # one row each
    text = lambda c: F.array_join(F.sort_array(c), ",").alias(c)
    shown = [F.col("segments"), F.col("tracks"), F.col("singers"), F.round("s", 3).alias("seconds")]
    overall = all_.filter("segments > 0").select(F.lit(None).cast(rows.schema["split"].dataType).alias("split"), *shown, F.col("q").alias("silent"), text("sources"), text("licences"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    return by_split.select("split", *shown, none("silent", "long"), none("sources", "string"), none("licences", "string")).unionByName(overall)


def describe(rows: DataFrame, family: str, group: str) -> DataFrame:
    """Segments and seconds of each group with their shares of the whole, and the share of labelled segments."""
    sums = rows.groupBy(group).agg(F.count("*").alias("segments"), F.count_distinct("track_id").alias("tracks"), F.sum("duration_seconds").alias("seconds"), F.sum((F.coalesce(F.col(family), F.lit("")) != "").cast("int")).alias("labelled"))
    total = Window.partitionBy()  # over one row for each group
    return sums.select(group, "segments", "tracks", F.round("seconds", 3).alias("seconds"), F.round(F.col("segments") / F.sum("segments").over(total), 6).alias("share_segments"), F.round(F.col("seconds") / F.sum("seconds").over(total), 6).alias("share_seconds"), F.round(F.col("labelled") / F.col("segments"), 6).alias("labelled_fraction"))


def family_counts(rows: DataFrame, family: str) -> DataFrame:
    """Counts by family, with those that have none apart as `(unlabelled)`."""
    return rows.groupBy(F.coalesce(F.nullif(F.col(family), F.lit("")), F.lit("(unlabelled)")).alias("family")).agg(F.count("*").alias("n"))


def track_profile(stems: DataFrame, aliases: dict[str, str], floor: float, min_stems: int) -> DataFrame:
    """track_id, families, audible (loud enough, or of unknown loudness), stems and eligible. stems: track_id, family,
    loudness, rendered."""
    name = F.col("family")
    merged = F.coalesce(*(F.when(name == a, b) for a, b in aliases.items()), name) if aliases else name
    heard = F.col("rendered") & (F.col("loudness").isNull() | (F.col("loudness") >= floor))
    return stems.withColumn("f", merged).groupBy("track_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("rendered"), F.col("f")))).alias("families"), F.array_sort(F.collect_set(F.when(heard, F.col("f")))).alias("audible"), F.count("*").alias("stems"), ((F.count("*") >= min_stems) & F.bool_and("rendered")).alias("eligible")
    )


def quota_coverage(chosen: DataFrame, quotas: dict[str, int], audible: str = "audible") -> DataFrame:
    """family, quota, got and unmet of a selection."""
    got = chosen.select(F.explode(audible).alias("family")).groupBy("family").agg(F.count("*").alias("got"))
    wanted = chosen.sparkSession.createDataFrame(sorted(quotas.items()), "family string, quota int")
    return wanted.join(got, "family", "left").select("family", "quota", F.coalesce("got", F.lit(0)).alias("got"), F.greatest(F.col("quota") - F.coalesce("got", F.lit(0)), F.lit(0)).alias("unmet"))


def length_stats(rows: DataFrame, length: Column) -> DataFrame:
    """n, shortest, upper median (the row n // 2 in order) and longest. The median comes from counts by length."""
    counts = rows.select(length.alias("l")).filter("l is not null").groupBy("l").agg(F.count("*").alias("n"))
    w = Window.orderBy("l")  # a row for each length
    upto = counts.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy())})
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("l")))
    return upto.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("l").alias("shortest"), middle.alias("median"), F.max("l").alias("longest"))


def genre_coverage(tracks: DataFrame, genre_top: str, fine: str, names: DataFrame) -> DataFrame:
    """Fine genres of tracks without a main genre: title (unknown ids as they are) and count."""
    blank = tracks.filter(F.trim(F.coalesce(F.col(genre_top), F.lit(""))) == "")
    ids = blank.select(F.explode(fine).alias("genre_id"))
    return ids.join(names, "genre_id", "left").groupBy(F.coalesce("title", "genre_id").alias("genre")).agg(F.count("*").alias("n"))


def preprocess_stats(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row over both outputs of a preprocessing job: files used and skipped (silence isn't a skipped file), segments, tracks,
    singers, instrument families and seconds. Rows meet by combination first, so that each distinct is counted over few."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    small = accepted.groupBy("source_path", "track_id", text("singer_id").alias("singer_id"), text("instrument_family").alias("family")).agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("s"))
    a = small.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("segments"), F.count_distinct("source_path").alias("files_used"), F.count_distinct("track_id").alias("tracks"), F.count_distinct("singer_id").alias("singers"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("instrument_families"), F.round(F.coalesce(F.sum("s"), F.lit(0.0)), 3).alias("seconds"))
    r = rejected.agg(F.count_distinct(F.when(F.col("stage") != "silence", F.col("source_path"))).alias("skipped_files"), F.count("*").alias("skipped"))
    return a.crossJoin(r)  # one row each
