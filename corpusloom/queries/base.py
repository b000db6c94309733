"""Registration, and the views that map the driver's tables to manifests, catalogues and logs: each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_position, stable_id

QUERIES: dict = {}
ORACLES: dict = {}

#: Licence spellings dealt to rows by their key: fixed values.
SPELLINGS = ["Attribution 4.0 International", "CC0 1.0 Universal", "Attribution-NonCommercial 3.0", "Attribution-ShareAlike 3.0", "Attribution-Non-Commercial", "No Derivatives", "CC-BY-4.0", "", "Archive-Limited: Download Only", "Attribution-NonCommercial-ShareAlike 3.0"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spelled(key):
    return F.element_at(F.array(*map(F.lit, SPELLINGS)), (key % 10).cast("int") + 1)


SPELLED = "[" + ", ".join(f"'{s}'" for s in SPELLINGS) + "][(%s %% 10) + 1]"
#: SPL-1's place of a key, and PRJ-1's id.
PLACE = "(('0x' || substr(sha256('42:song:' || {k}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
SPLIT = "CASE WHEN " + PLACE + " < 0.8 THEN 'train' WHEN " + PLACE + " < 0.9 THEN 'val' ELSE 'test' END"
BUCKET = """CASE WHEN lower(trim({l})) = '' THEN 'other_unknown'
 WHEN regexp_matches(replace(lower({l}), '_', '-'), 'by-nc|noncommercial|non-commercial') THEN 'cc_by_nc'
 WHEN regexp_matches(replace(lower({l}), '_', '-'), 'by-nd|noderiv|no derivatives') THEN 'cc_by_nd'
 WHEN regexp_matches(replace(lower({l}), '_', '-'), 'by-sa|sharealike|share alike') THEN 'cc_by_sa'
 WHEN regexp_matches(replace(lower({l}), '_', '-'), 'zero|cc0|public domain|publicdomain') THEN 'cc0_public_domain'
 WHEN regexp_matches(replace(lower({l}), '_', '-'), '/by/|attribution') OR lower(trim({l})) IN ('cc by', 'cc-by') THEN 'cc_by' ELSE 'other_unknown' END"""


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """documents as corpus records."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    junk = F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))
    quality = labels.groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality_score"))
    rows = docs.join(quality, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"), F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("track_id"), "lang", "text", "n_chars", spelled(F.col("doc_id")).alias("licence"),
        F.when(F.col("doc_id") % 23 != 0, F.concat(F.lit("https://data.example/"), F.col("source"))).alias("source_url"), F.sha2("text", 256).alias("duplicate_hash"),
        F.when(F.col("doc_id") % 40 == 0, "val").otherwise("train").alias("split"), (F.col("n_chars") / 15.0).alias("duration_seconds"), (F.col("n_chars") < 40).alias("silent"),
        (junk / F.greatest(F.col("n_chars"), F.lit(1))).alias("clipping_ratio"), "quality_score", F.when(F.col("doc_id") % 13 == 0, " few words ").when(F.col("doc_id") % 11 != 0, F.concat(F.lit("spoken text in "), F.col("lang"))).alias("caption"),
    )


CORPUS = f"""corpus AS (SELECT d.doc_id AS id, source AS dataset, d.doc_id::VARCHAR AS track_id, lang, text, n_chars, {SPELLED % "d.doc_id"} AS licence,
 CASE WHEN d.doc_id % 23 <> 0 THEN 'https://data.example/' || source END AS source_url, sha256(text) AS duplicate_hash, CASE WHEN d.doc_id % 40 = 0 THEN 'val' ELSE 'train' END AS split,
 n_chars::DOUBLE / 15.0 AS duration_seconds, n_chars < 40 AS silent, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::DOUBLE / greatest(n_chars, 1) AS clipping_ratio,
 q.quality_score, CASE WHEN d.doc_id % 13 = 0 THEN ' few words ' WHEN d.doc_id % 11 <> 0 THEN 'spoken text in ' || lang END AS caption
 FROM documents d LEFT JOIN (SELECT doc_id, max(quality)::DOUBLE AS quality_score FROM labels GROUP BY doc_id) q ON d.doc_id = q.doc_id)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """conversations as a segment manifest."""
    c = table(spark, d, "conversations")
    track = F.col("conv_id").cast("string")
    place = hash_position(42, "song", track)
    return c.select(
        stable_id(track, F.col("turn")).alias("id"), F.concat_ws("/", track, F.col("turn").cast("string")).alias("path"), F.when(place < 0.8, "train").when(place < 0.9, "val").otherwise("test").alias("split"),
        F.concat(F.lit("set"), (F.col("conv_id") % 3).cast("string")).alias("source"), F.when(F.col("conv_id") % 25 == 0, "CC-BY-NC-4.0").otherwise("CC-BY-4.0").alias("license"), track.alias("track_id"),
        F.when(F.col("role") == "user", F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string"))).alias("singer_id"), F.array(F.col("role")).alias("tags"), F.concat(F.lit("raw/"), track).alias("source_path"),
        F.col("turn").cast("int").alias("segment_index"), (F.length("text") / 15.0).alias("duration_seconds"), (F.length("text") * 10).alias("num_samples"), F.lit(150).alias("sample_rate"),
        F.lit(0.0).alias("clipping_ratio"), (F.length("text") < 40).alias("silent"), F.when(F.col("role") != "system", F.col("role")).alias("instrument_family"), F.sha2("text", 256).alias("audio_sha256"), "text",
    )


SEGMENTS = f"""segments AS (SELECT substr(sha256(conv_id::VARCHAR || chr(31) || turn::VARCHAR), 1, 16) AS id, conv_id::VARCHAR || '/' || turn::VARCHAR AS path, {SPLIT.format(k="conv_id::VARCHAR")} AS split,
 'set' || (conv_id % 3)::VARCHAR AS source, CASE WHEN conv_id % 25 = 0 THEN 'CC-BY-NC-4.0' ELSE 'CC-BY-4.0' END AS license, conv_id::VARCHAR AS track_id,
 CASE WHEN role = 'user' THEN 'u' || (conv_id % 7)::VARCHAR END AS singer_id, 'raw/' || conv_id::VARCHAR AS source_path, turn::INT AS segment_index, length(text)::DOUBLE / 15.0 AS duration_seconds,
 length(text) < 40 AS silent, CASE WHEN role <> 'system' THEN role END AS instrument_family, sha256(text) AS audio_sha256, text, role FROM conversations)"""


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """part as a track catalogue."""
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    rate = F.element_at(F.array(*map(F.lit, [0.0, 96_000.0, 128_000.0, 192_000.0, 256_000.0, 320_000.0])), (key % 6).cast("int") + 1)
    digits = F.regexp_replace("p_brand", "[^0-9]", "")
    return p.select(
        key.cast("string").alias("track_id"), spelled(key).alias("licence"), (F.col("p_size") * 12.0).alias("duration"), rate.alias("bit_rate"), F.when(key % 9 != 0, F.col("p_type")).otherwise("").alias("genre_top"),
        F.concat(F.lit("["), F.regexp_replace(digits, "(.)(?=.)", "$1, "), F.lit("]")).alias("genres_all"), F.when(key % 4 == 0, "en").otherwise("").alias("language"), F.col("p_retailprice").alias("listens"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"),
    )


CATALOGUE = f"""catalogue AS (SELECT p_partkey::VARCHAR AS track_id, {SPELLED % "p_partkey"} AS licence, p_size * 12.0::DOUBLE AS duration, [0.0, 96000.0, 128000.0, 192000.0, 256000.0, 320000.0][(p_partkey % 6) + 1]::DOUBLE AS bit_rate,
 CASE WHEN p_partkey % 9 <> 0 THEN p_type ELSE '' END AS genre_top, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, CASE WHEN p_partkey % 4 = 0 THEN 'en' ELSE '' END AS language, p_retailprice AS listens, p_brand AS artist, p_name AS title FROM part)"""


def curve(spark: SparkSession, d: str) -> DataFrame:
    """events as training curves: a tenth of the steps repeats the one before."""
    e = table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("run_id"), (n - F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)).cast("long").alias("step"), n.cast("long").alias("row_no"), F.col("value").alias("loss"), (F.col("event_type") == "error").alias("flag"), "event_id", "ts", "event_type")


CURVE = """curve AS (SELECT user_id AS run_id, row_number() OVER w - CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS step, row_number() OVER w AS row_no, value AS loss, event_type = 'error' AS flag, event_id, ts, event_type
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
