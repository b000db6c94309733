"""Queries over corpora and manifests: licences, admission, duplicates, splits, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns, licences
from ..operators import dedup, gates, joins, reports, select, splits, training, validate
from .base import BUCKET, CORPUS, PLACE, SEGMENTS, SPLIT, corpus, query, segments, table

B = BUCKET.format(l="licence")


@query(f"""WITH {CORPUS}, t AS (SELECT {B} AS bucket, duration_seconds AS s, CASE WHEN id % 5 = 0 THEN 320000.0 ELSE 128000.0 END AS rate FROM corpus),
a AS (SELECT bucket, count(*) AS n, sum(s) AS s, sum(s * rate) AS b FROM t GROUP BY bucket)
SELECT bucket, coalesce(n, 0)::BIGINT AS tracks, round(coalesce(s, 0.0) / 3600, 1)::DOUBLE AS hours, round(coalesce(b, 0.0) / 8 / 1e9, 3)::DOUBLE AS gigabytes
FROM (SELECT unnest(['cc0_public_domain', 'cc_by', 'cc_by_sa', 'cc_by_nc', 'cc_by_nd', 'other_unknown']) AS bucket) LEFT JOIN a USING (bucket)""")
def licence_census(spark: SparkSession, d: str) -> DataFrame:
    rate = F.when(F.col("id") % 5 == 0, 0.0).otherwise(128_000.0)
    return reports.licence_census(corpus(spark, d).select("licence", F.col("duration_seconds").alias("duration"), rate.alias("bit_rate")))


@query(f"""WITH {CORPUS}, c AS (SELECT {B} AS bucket, lang, count(*) AS n FROM corpus GROUP BY ALL),
r AS (SELECT bucket, lang, n, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, lang) AS rank FROM c)
SELECT bucket, lang, n, rank::INT AS rank FROM r WHERE rank <= 3 UNION ALL SELECT bucket, NULL, sum(n)::BIGINT, 0 FROM c GROUP BY bucket""")
def census_rollup_topn(spark: SparkSession, d: str) -> DataFrame:
    return reports.rollup_top(corpus(spark, d).withColumn("bucket", licences.bucket(F.col("licence"))), "bucket", "lang", 3)


@query(f"""WITH {CORPUS}, p AS (SELECT licence, {B} AS bucket,
 trim(licence) <> '' AND NOT regexp_matches(lower(licence), 'noncommercial|-nc|sharealike|-sa|noderivative|noderivs|-nd') AND regexp_matches(lower(licence), 'attribution|public domain|cc0|zero|cc by') AS strict,
 trim(licence) <> '' AND NOT regexp_matches(lower(licence), 'noncommercial|no derivative|noderiv|share-alike|sharealike|-nc|nc-| nd') AND regexp_matches(lower(licence), 'attribution|public domain|cc0|zero') AS on_disk FROM corpus)
SELECT licence, bucket, strict, on_disk, (bucket IN ('cc0_public_domain', 'cc_by') <> strict) OR (bucket IN ('cc0_public_domain', 'cc_by') <> on_disk) AS disagree, count(*) AS n FROM p GROUP BY ALL""")
def licence_policy_disagreement(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("licence")
    return corpus(spark, d).groupBy("licence", licences.bucket(c).alias("bucket"), licences.strictly_deployable(c).alias("strict"), licences.deployable_on_disk(c).alias("on_disk"), licences.disagreement(c).alias("disagree")).agg(F.count("*").alias("n"))


@query(f"""WITH {CORPUS} SELECT licence, CASE WHEN licence = '' THEN 'unknown' WHEN contains(replace(replace(upper(licence), '-', ''), ' ', ''), 'NC') THEN 'non-commercial'
 WHEN licence IN ('CC-BY-4.0') OR starts_with(upper(licence), 'CC-BY-4') THEN 'permissive' ELSE 'other' END AS licence_class, count(*) AS n FROM corpus GROUP BY ALL""")
def licence_classes(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).groupBy("licence", licences.licence_class(F.col("licence")).alias("licence_class")).agg(F.count("*").alias("n"))


ADMITTED = f"""{CORPUS}, h AS (SELECT duplicate_hash FROM corpus GROUP BY 1 HAVING count(DISTINCT dataset) > 1), t AS (SELECT track_id FROM corpus GROUP BY 1 HAVING count(DISTINCT split) > 1),
judged AS (SELECT id, {B} AS bucket, CASE WHEN {B} = 'other_unknown' THEN 'licence' WHEN coalesce(source_url, '') = '' THEN 'provenance' WHEN duplicate_hash IN (SELECT duplicate_hash FROM h) THEN 'cross_corpus_duplicate'
 WHEN duration_seconds < 1 THEN 'integrity_decode' WHEN silent THEN 'silence' WHEN clipping_ratio > 0.01 THEN 'clipping_quality' WHEN track_id IN (SELECT track_id FROM t) THEN 'split_leakage' WHEN quality_score IS NULL THEN 'metadata'
 WHEN len(string_split_regex(trim(coalesce(caption, '')), ' +')) < 4 THEN 'rich_caption' WHEN {B} NOT IN ('cc0_public_domain', 'cc_by') THEN 'deployability' END AS failed_gate FROM corpus)"""


@query(f"""WITH {ADMITTED}, g AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{g}')" for i, g in enumerate([*gates.GATES, "admitted"]))}) AS v(gate_no, gate)),
c AS (SELECT coalesce(failed_gate, 'admitted') AS gate, count(*) AS n FROM judged GROUP BY 1), j AS (SELECT gate_no, gate, coalesce(n, 0) AS n_failed FROM g LEFT JOIN c USING (gate))
SELECT gate_no, gate, n_failed::BIGINT AS n_failed, (sum(n_failed) OVER (ORDER BY gate_no DESC))::BIGINT AS n_in FROM j""")
def admission_funnel(spark: SparkSession, d: str) -> DataFrame:
    return validate.funnel(gates.admitted(corpus(spark, d)), gates.GATES)


@query(f"WITH {ADMITTED} SELECT id, failed_gate FROM judged")
def admitted_records(spark: SparkSession, d: str) -> DataFrame:
    return gates.admitted(corpus(spark, d)).select("id", "failed_gate")


GATE_SQL = f"""WITH {SEGMENTS}, d AS (SELECT * REPLACE (CASE WHEN segment_index % 13 = 5 THEN '' WHEN segment_index % 17 = 6 THEN NULL ELSE source END AS source, CASE WHEN segment_index % 19 = 7 THEN '' ELSE license END AS license, CASE WHEN segment_index % 2 = 0 THEN '' ELSE source_path END AS source_path, CASE WHEN segment_index % 4 = 1 THEN NULL ELSE instrument_family END AS instrument_family), CASE WHEN segment_index % 23 = 3 THEN 0.5 ELSE 0 END AS clip FROM segments),
one AS (SELECT count(*) FILTER (license NOT IN ('CC-BY-4.0')) AS lic, count(*) FILTER (silent OR clip > 0.01) AS q, count(*) FILTER (coalesce(license, '') = '' OR coalesce(source, '') = '') AS prov, (count(*) FILTER (source_path <> '') = 0 OR count(instrument_family) = 0)::BIGINT AS fmt FROM d),
dup AS (SELECT count(*) AS n FROM (SELECT audio_sha256 FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1)), t AS (SELECT count(*) AS n FROM (SELECT track_id FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1)),
s AS (SELECT count(*) AS n FROM (SELECT singer_id FROM d WHERE singer_id IS NOT NULL GROUP BY 1 HAVING bool_or(split = 'train') AND bool_or(split IN ('val', 'test')))),
c AS (SELECT (count(singer_id)::DOUBLE / count(*) < 0.95)::BIGINT AS n FROM d),
g AS (SELECT 'LICENSE' AS gate, lic AS n_bad FROM one UNION ALL SELECT 'PROVENANCE', prov FROM one UNION ALL SELECT 'DUPLICATE', n FROM dup UNION ALL SELECT 'QUALITY', q FROM one UNION ALL SELECT 'METADATA', n FROM c
 UNION ALL SELECT 'SPLIT-LEAKAGE', t.n + s.n FROM t, s UNION ALL SELECT 'FORMAT', fmt FROM one)"""


def damaged(spark: SparkSession, d: str) -> DataFrame:
    """Segments of which some lack what the gates ask for."""
    i = F.col("segment_index")
    return segments(spark, d).withColumns({
        "source": F.when(i % 13 == 5, "").when(i % 17 != 6, F.col("source")), "license": F.when(i % 19 == 7, "").otherwise(F.col("license")), "source_path": F.when(i % 2 == 0, "").otherwise(F.col("source_path")),
        "instrument_family": F.when(i % 4 != 1, F.col("instrument_family")), "clipping_ratio": F.when(i % 23 == 3, 0.5).otherwise(0.0), "tags": F.array().cast("array<string>"),
    })


@query(GATE_SQL + " SELECT gate, n_bad = 0 AS passed, n_bad::BIGINT AS n_bad FROM g")
def dataset_gates(spark: SparkSession, d: str) -> DataFrame:
    return gates.dataset_gates(damaged(spark, d), "vocal")


@query(GATE_SQL + " SELECT CASE WHEN count(*) FILTER (n_bad > 0) = 0 THEN 'all-pass' WHEN count(*) FILTER (n_bad > 0) = 1 AND bool_or(gate = 'LICENSE' AND n_bad > 0) THEN 'research-only' ELSE 'blocked' END AS verdict FROM g")
def dataset_verdict(spark: SparkSession, d: str) -> DataFrame:
    return gates.verdict(gates.dataset_gates(damaged(spark, d), "vocal"))


@query(f"""WITH {SEGMENTS} SELECT split, count(*) AS segments, count(DISTINCT track_id) AS tracks, count(DISTINCT singer_id) AS singers, round(sum(duration_seconds), 3) AS seconds,
 CASE WHEN grouping(split) = 1 THEN sum(silent::INT)::BIGINT END AS silent, CASE WHEN grouping(split) = 1 THEN string_agg(DISTINCT source, ',' ORDER BY source) END AS sources,
 CASE WHEN grouping(split) = 1 THEN string_agg(DISTINCT license, ',' ORDER BY license) END AS licences FROM segments GROUP BY GROUPING SETS ((split), ())""")
def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.manifest_summary(segments(spark, d))


@query(f"""WITH {SEGMENTS}, a AS (SELECT split, count(*) AS segments, count(DISTINCT track_id) AS tracks, sum(duration_seconds) AS seconds, count(instrument_family) AS lab FROM segments GROUP BY split)
SELECT split, segments, tracks, round(seconds, 3) AS seconds, round(segments::DOUBLE / sum(segments) OVER (), 6)::DOUBLE AS share_segments, round(seconds / sum(seconds) OVER (), 6) AS share_seconds, round(lab::DOUBLE / segments, 6) AS labelled_fraction FROM a""")
def corpus_description(spark: SparkSession, d: str) -> DataFrame:
    return reports.describe(segments(spark, d), "instrument_family", "split")


@query(f"WITH {SEGMENTS} SELECT coalesce(instrument_family, '(unlabelled)') AS family, count(*) AS n FROM segments GROUP BY 1")
def family_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.family_counts(segments(spark, d), "instrument_family")


@query(f"SELECT doc_id, round({PLACE.format(k='doc_id::VARCHAR')}, 9) AS place, {SPLIT.format(k='doc_id::VARCHAR')} AS split FROM documents")
def split_hash(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", F.round(columns.hash_position(42, "song", key), 9).alias("place"), splits.by_hash(key).alias("split"))


QUOTA = f"""{SEGMENTS}, k AS (SELECT DISTINCT track_id FROM segments), r AS (SELECT track_id, row_number() OVER (ORDER BY {PLACE.format(k="track_id")}, track_id) AS n, count(*) OVER () AS total FROM k),
plan AS (SELECT track_id, CASE WHEN n <= round_even(total * 0.8, 0) THEN 'train' WHEN n <= round_even(total * 0.8, 0) + round_even(total * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM r)"""


@query(f"WITH {QUOTA} SELECT track_id, split FROM plan")
def split_quota(spark: SparkSession, d: str) -> DataFrame:
    return splits.by_quota(segments(spark, d), "track_id")


@query(f"""WITH {QUOTA} SELECT p.split, count(*) AS segments, count(DISTINCT s.track_id) AS groups, count(DISTINCT s.track_id) AS tracks, count(DISTINCT singer_id) AS singers FROM segments s JOIN plan p USING (track_id) GROUP BY p.split""")
def split_report(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d).drop("split")
    return splits.report(splits.assign(rows, splits.by_quota(rows, "track_id"), "track_id"), F.col("track_id"))


@query(f"""WITH RECURSIVE {CORPUS}, k AS (SELECT dataset, sum(CASE WHEN coalesce(duration_seconds, 0) = 0 THEN 1 ELSE duration_seconds END) AS w FROM corpus GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY w DESC, {PLACE.format(k="dataset")}, dataset) AS n, sum(w) OVER () AS total FROM k),
r AS (SELECT 0::BIGINT AS n, ''::VARCHAR AS dataset, ''::VARCHAR AS split, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c
 UNION ALL SELECT n, dataset, split, a + CASE WHEN split = 'train' THEN w ELSE 0 END, b + CASE WHEN split = 'val' THEN w ELSE 0 END, c + CASE WHEN split = 'test' THEN w ELSE 0 END
 FROM (SELECT o.n, o.dataset, o.w, a, b, c, CASE WHEN a / (total * 0.8) <= b / (total * 0.1) AND a / (total * 0.8) <= c / (total * 0.1) THEN 'train' WHEN b <= c THEN 'val' ELSE 'test' END AS split FROM r JOIN o ON o.n = r.n + 1))
SELECT dataset, split FROM r WHERE n > 0""")
def split_weighted(spark: SparkSession, d: str) -> DataFrame:
    return splits.by_weight(corpus(spark, d), "dataset", "duration_seconds")


@query("""WITH k AS (SELECT lpad(doc_id::VARCHAR, 3, '0') || source AS path FROM documents) SELECT path, CASE WHEN row_number() OVER (ORDER BY path DESC) <= least(greatest(1, round_even(count(*) OVER () * 0.1, 0)), count(*) OVER () - 1) THEN 'val' ELSE 'train' END AS split FROM k""")
def split_tail(spark: SparkSession, d: str) -> DataFrame:
    """Documents in order of a path that isn't in order of their ids."""
    path = F.concat(F.when(F.length(F.col("doc_id").cast("string")) < 3, F.lpad(F.col("doc_id").cast("string"), 3, "0")).otherwise(F.substring(F.col("doc_id").cast("string"), 1, 3)), "source")
    return splits.tail(table(spark, d, "documents").select(path.alias("path")), "path")


@query("""SELECT source AS path, CASE WHEN row_number() OVER (ORDER BY source DESC) <= least(greatest(1, round_even(count(*) OVER () * 0.1, 0)), count(*) OVER () - 1) THEN 'val' ELSE 'train' END AS split FROM documents""")
def split_tail_ties(spark: SparkSession, d: str) -> DataFrame:
    """By source alone, so that the cut runs through equal rows."""
    return splits.tail(table(spark, d, "documents").select(F.col("source").alias("path")), "path")


@query(f"""WITH {CORPUS} SELECT duplicate_hash AS key, count(DISTINCT split)::BIGINT AS n_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM corpus GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def group_leakage(spark: SparkSession, d: str) -> DataFrame:
    return validate.leaking(corpus(spark, d), F.col("duplicate_hash")).withColumn("splits", F.array_join("splits", ","))


@query(f"WITH {SEGMENTS} SELECT singer_id FROM segments WHERE singer_id IS NOT NULL GROUP BY 1 HAVING bool_or(split = 'train') AND bool_or(split IN ('val', 'valid', 'validation', 'test'))")
def singer_leakage(spark: SparkSession, d: str) -> DataFrame:
    return validate.leaking_singers(segments(spark, d))


@query(f"""WITH {CORPUS}, g AS (SELECT duplicate_hash, count(*) AS n, count(DISTINCT split) AS s FROM corpus GROUP BY 1)
SELECT sum(n)::BIGINT AS fingerprinted, count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_groups, count(*) FILTER (s > 1) AS cross_split_groups, count(*) FILTER (s > 1) = 0 AS ok FROM g""")
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    return dedup.report(corpus(spark, d), "duplicate_hash")


@query(f"""WITH {CORPUS} SELECT duplicate_hash, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM corpus GROUP BY 1 HAVING count(DISTINCT split) > 1 ORDER BY 1 LIMIT 5""")
def duplicate_examples(spark: SparkSession, d: str) -> DataFrame:
    """Five (a report's limit)."""
    return dedup.examples(corpus(spark, d), "duplicate_hash").select("duplicate_hash", F.array_join("groups", ",").alias("splits"))


@query(f"""WITH {CORPUS}, g AS (SELECT duplicate_hash, count(DISTINCT split) AS s FROM corpus GROUP BY 1) SELECT count(*) FILTER (s > 1) AS leaking_groups, count(*) FILTER (s > 1) = 0 AS ok FROM g""")
def split_verdict(spark: SparkSession, d: str) -> DataFrame:
    return splits.verdict(corpus(spark, d), F.col("duplicate_hash"))


@query(f"WITH {CORPUS} SELECT id, row_number() OVER (PARTITION BY duplicate_hash ORDER BY dataset, id) = 1 AS kept FROM corpus")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("dataset"), F.sha2("text", 256).alias("duplicate_hash"))
    return dedup.keep_first(rows, "duplicate_hash", ["dataset", "id"]).select("id", "kept")


@query("""WITH h AS (SELECT source AS dataset, sha256(text) AS hash FROM documents), t AS (SELECT * FROM h UNION ALL SELECT * FROM h), n AS (SELECT dataset, hash, count(*) AS n_rows FROM t GROUP BY 1, 2)
SELECT dataset, hash, n_rows, CASE WHEN hash IS NULL THEN n_rows WHEN dataset = min(dataset) OVER (PARTITION BY hash) THEN 1 ELSE 0 END AS n_kept FROM n""")
def dedup_equal_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table that holds every row twice, in an order that tells none of a dataset's copies apart: one of each hash stays."""
    rows = table(spark, d, "documents").select(F.col("source").alias("dataset"), F.sha2("text", 256).alias("hash"))
    found = dedup.keep_first(rows.union(rows), "hash", ["dataset"])
    return found.groupBy("dataset", "hash").agg(F.count("*").alias("n_rows"), F.count_if("kept").alias("n_kept"))


def _spanning(group: str) -> str:
    return f"WITH {CORPUS} SELECT duplicate_hash, count(*)::BIGINT AS n_rows, count(DISTINCT {group})::BIGINT AS n_groups, string_agg(DISTINCT {group}, ',' ORDER BY {group}) AS groups FROM corpus GROUP BY 1 HAVING count(DISTINCT {group}) > 1"


@query(_spanning("dataset"))
def cross_corpus_dups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.spanning(corpus(spark, d), "duplicate_hash", "dataset").withColumn("groups", F.array_join("groups", ","))


@query(_spanning("split"))
def cross_split_dups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.spanning(corpus(spark, d), "duplicate_hash", "split").withColumn("groups", F.array_join("groups", ","))


@query(f"WITH {SEGMENTS} SELECT path, split FROM segments")
def unique_paths(spark: SparkSession, d: str) -> DataFrame:
    """An `all` manifest and its split files, read together."""
    rows = segments(spark, d).select("path", "split")
    return dedup.unique_by_path([rows, *(rows.filter(F.col("split") == s) for s in ("train", "val", "test"))])


@query(f"""WITH {SEGMENTS}, r AS (SELECT id, role, CASE WHEN segment_index % 50 = 0 THEN '' ELSE license END AS license, CASE WHEN segment_index = 3 THEN track_id ELSE id END AS id2, path, duration_seconds + CASE WHEN segment_index = 2 THEN 1 ELSE 0 END AS dur, length(text) * 10 AS n FROM segments),
m AS (SELECT *, min(path) OVER (PARTITION BY id2) AS least FROM r)
SELECT id2 AS id, 'missing license' AS problem FROM r WHERE license = '' UNION ALL SELECT id2, 'id with several paths' FROM m WHERE path <> least UNION ALL SELECT id2, 'duration differs from samples' FROM r WHERE abs(dur - n / 150.0) > 1e-3""")
def validate_records(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows with some damage done to them."""
    i = F.col("segment_index")
    bad = segments(spark, d).withColumns({"license": F.when(i % 50 == 0, "").otherwise(F.col("license")), "id": F.when(i == 3, F.col("track_id")).otherwise(F.col("id")), "duration_seconds": F.col("duration_seconds") + F.when(i == 2, 1).otherwise(0)})
    return validate.record_problems(bad, ["path", "split", "source", "license", "track_id"])


@query(f"""WITH {CORPUS}, r AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'permissive' WHEN id % 3 = 1 THEN 'research-only' ELSE 'mine' END AS licence_class FROM corpus)
SELECT id, CASE WHEN licence = '' THEN 'missing required field licence' WHEN source_url IS NULL THEN 'missing required field source_url' WHEN licence_class = 'mine' THEN 'bad licence class'
 WHEN licence_class = 'permissive' AND licence <> 'CC-BY-4.0' THEN 'licence is not on the allowlist' WHEN quality_score NOT BETWEEN 0 AND 1 THEN 'quality score outside [0, 1]' END AS problem FROM r""")
def corpus_record_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 3
    rows = corpus(spark, d).withColumns({"licence_class": F.when(k == 0, "permissive").when(k == 1, "research-only").otherwise("mine")}).withColumn("audio_path", F.concat(F.lit("a/"), F.col("track_id")))
    return rows.select("id", validate.corpus_problem().alias("problem"))


@query(f"WITH {CORPUS} SELECT id, CASE WHEN licence = '' THEN 'licence' ELSE 'source_url' END AS field FROM corpus WHERE licence = '' OR source_url IS NULL")
def provenance_gaps(spark: SparkSession, d: str) -> DataFrame:
    return validate.provenance_gaps(corpus(spark, d), ["licence", "dataset", "source_url"])


@query(f"WITH {CORPUS} SELECT id, licence FROM corpus WHERE {B} NOT IN ('cc0_public_domain', 'cc_by') ORDER BY id LIMIT 10")
def deployable_offenders(spark: SparkSession, d: str) -> DataFrame:
    """The first ten (a report's limit)."""
    return validate.not_deployable(corpus(spark, d), "id", "licence", 10)


@query(f"WITH {CORPUS} SELECT id, licence FROM corpus WHERE {B} NOT IN ('cc0_public_domain', 'cc_by')")
def not_deployable(spark: SparkSession, d: str) -> DataFrame:
    return validate.not_deployable(corpus(spark, d), "id", "licence")


@query(f"""WITH {CORPUS}, r AS (SELECT CASE WHEN licence <> 'CC-BY-4.0' THEN 'licence' WHEN duration_seconds < 30 THEN 'short' WHEN l.doc_id IS NULL THEN 'missing_audio' END AS reject_reason FROM corpus c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON c.id = l.doc_id)
SELECT reject_reason, count(*) AS n FROM r GROUP BY 1""")
def trainer_filter(spark: SparkSession, d: str) -> DataFrame:
    present = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("track_id"))
    return gates.trainer_filter(corpus(spark, d), present, 30.0).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(f"""WITH {CORPUS}, p AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS n FROM corpus)
SELECT id, dataset FROM p WHERE n <= 3 OR i IN (SELECT floor(k * (n / 3.0::DOUBLE)) FROM range(3) t(k))""")
def stratified_segments(spark: SparkSession, d: str) -> DataFrame:
    return select.stratified(corpus(spark, d).select("id", "dataset"), F.col("dataset"), ["id"], 3)


SHARES = {"en": 0.35, "fr": 0.27, "de": 0.20, "es": 0.18}


_W = "[" + ", ".join(f"{s}::DOUBLE" for s in SHARES.values()) + "]"
_L = list(SHARES)
ASSEMBLY = f"""RECURSIVE {CORPUS}, n AS (SELECT count(*) AS total, {", ".join(f"count(*) FILTER (lang = '{f}') AS p{k}" for k, f in enumerate(_L))} FROM corpus),
t AS (SELECT greatest(total, 1) AS target, [p0, p1, p2, p3]::BIGINT[] AS pool, list_transform({_W}, lambda w: round_even(greatest(total, 1) * w, 0)::BIGINT) AS quota, list_transform({_W}, lambda w: floor(greatest(total, 1) * w * 1.35::DOUBLE)::BIGINT) AS most FROM n),
s AS (SELECT 0 AS round, [least(pool[i], quota[i]) for i in range(1, 5)] AS uniq, target - list_sum([least(pool[i], quota[i]) for i in range(1, 5)]) AS short FROM t
 UNION ALL SELECT round + 1, [uniq[i] + least(list_sum(want[1:i]), short) - least(coalesce(list_sum(want[1:i - 1]), 0), short) for i in range(1, 5)], short - least(list_sum(want), short) FROM (
 SELECT round, uniq, short, [least(room[i], greatest(1, short // len(list_filter(room, lambda r: r > 0)))) for i in range(1, 5)] AS want FROM (SELECT s.round, s.uniq, s.short, [greatest(least(pool[i], most[i]) - uniq[i], 0) for i in range(1, 5)] AS room FROM s, t WHERE short > 0) WHERE list_sum(room) > 0)),
z AS (SELECT uniq FROM s ORDER BY round DESC LIMIT 1),
plan AS (SELECT {_L!r}[i] AS family, quota[i] AS quota, pool[i] AS pool, uniq[i] AS n_unique, uniq[i] - least(pool[i], quota[i]) AS granted, greatest(0, least(quota[i] - uniq[i], pool[i] * 2)) AS repeats FROM z, t, range(1, 5) r(i)),
placed AS (SELECT id, family, n_unique, repeats, pool, row_number() OVER (PARTITION BY family ORDER BY sha256('42:' || id::VARCHAR)) AS place FROM corpus JOIN plan ON lang = family),
assembled AS (SELECT id, family, 0 AS repeat_index FROM placed WHERE place <= n_unique UNION ALL SELECT id, family, unnest(range(1, (repeats - place) // greatest(pool, 1) + 2))::INT FROM placed WHERE repeats >= place)"""


@query(f"WITH {ASSEMBLY} SELECT family, id, repeat_index FROM assembled")
def balanced_assembly(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).select("id", F.col("lang").alias("family"))
    pools = {r["family"]: r["count"] for r in rows.groupBy("family").count().collect()}
    plan = select.allocation(SHARES, pools, max(1, sum(pools.values())))
    return select.assembled(rows, "family", "id", plan).select("family", "id", "repeat_index")


@query(f"WITH {ASSEMBLY}, g AS (SELECT family, count(*) AS got FROM assembled GROUP BY 1) SELECT family, quota, n_unique, granted, repeats, got, round(got::DOUBLE / sum(got) OVER (), 6) AS share FROM plan LEFT JOIN g USING (family)")
def assembly_report(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).select("id", F.col("lang").alias("family"))
    pools = {r["family"]: r["count"] for r in rows.groupBy("family").count().collect()}
    target = max(1, sum(pools.values()))
    plan = select.allocation(SHARES, pools, target)
    wanted = spark.createDataFrame([(f, p["quota"], p["unique"], p["granted"], p["repeats"]) for f, p in plan.items()], "family string, quota long, n_unique long, granted long, repeats long")
    got = select.assembled(rows, "family", "id", plan).groupBy("family").agg(F.count("*").alias("got"))
    return wanted.join(got, "family", "left").withColumn("share", F.round(F.col("got") / F.sum("got").over(Window.partitionBy()), 6))


@query("SELECT doc_id FROM documents ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 64")
def probe_selection(spark: SparkSession, d: str) -> DataFrame:
    """A probe of 64 rows (the feature)."""
    return select.probe(table(spark, d, "documents"), "doc_id", 64).select("doc_id")


@query("SELECT lang, arg_min(doc_id, sha256(doc_id::VARCHAR)) AS doc_id FROM documents GROUP BY lang")
def category_examples(spark: SparkSession, d: str) -> DataFrame:
    return select.example_by_category(table(spark, d, "documents"), "lang", "doc_id")


@query("""WITH s AS (SELECT doc_id, n_chars::DOUBLE AS long, -n_chars::DOUBLE AS short, length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / greatest(n_chars, 1) AS digits FROM documents),
a AS (SELECT 'long' AS bucket, doc_id, long AS score FROM s ORDER BY long DESC, doc_id LIMIT 1), b AS (SELECT 'short' AS bucket, doc_id, short AS score FROM s WHERE doc_id NOT IN (SELECT doc_id FROM a) ORDER BY short DESC, doc_id LIMIT 1),
c AS (SELECT 'digits' AS bucket, doc_id, digits AS score FROM s WHERE doc_id NOT IN (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b) ORDER BY digits DESC, doc_id LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def character_examples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    scores = docs.select("doc_id", F.col("n_chars").cast("double").alias("long"), (-F.col("n_chars")).cast("double").alias("short"), (F.length(F.regexp_replace("text", "[^0-9]", "")) / F.greatest("n_chars", F.lit(1))).alias("digits"))
    return select.distinct_best(scores, "doc_id", ["long", "short", "digits"])


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)")
def availability_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.available(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def unfinished_rows(spark: SparkSession, d: str) -> DataFrame:
    return joins.unfinished(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("""WITH f AS (SELECT doc_id, bool_or(quality = 1) AS f FROM labels GROUP BY 1), p AS (SELECT doc_id, bool_or(toxic = 0) AS p FROM labels GROUP BY 1)
SELECT d.doc_id, CASE WHEN f THEN 'done' WHEN p THEN 'adopt' WHEN n_chars > 200 THEN 'todo' ELSE 'missing_audio' END AS action, (CASE WHEN f = FALSE THEN 1 ELSE 0 END + CASE WHEN p = FALSE AND NOT coalesce(f, FALSE) THEN 1 ELSE 0 END)::INT AS repaired
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN p USING (doc_id)""")
def resume_plan(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    final = labels.select("doc_id", (F.col("quality") == 1).alias("valid"))
    partial = labels.select("doc_id", (F.col("toxic") == 0).alias("valid"))
    return joins.resume_plan(docs.select("doc_id"), final, partial, docs.filter("n_chars > 200"), "doc_id")


@query("""WITH a AS (SELECT doc_id AS name, n_chars AS a FROM documents), b AS (SELECT doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS b FROM documents WHERE n_chars >= 100 UNION ALL SELECT -doc_id - 1, 9 FROM labels WHERE quality = 0),
j AS (SELECT count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a <> b) AS size_mismatch, count(*) FILTER (b = 0) AS zero_byte, count(*) FILTER (a IS NULL) AS stray FROM a FULL JOIN b USING (name))
SELECT *, missing + size_mismatch + zero_byte + stray = 0 AS ok FROM j""")
def staging_audit(spark: SparkSession, d: str) -> DataFrame:
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    staged = docs.filter("n_chars >= 100").select(i.alias("name"), F.when(i % 5 == 0, 0).when(i % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size_bytes"))
    stray = table(spark, d, "labels").filter("quality = 0").select((-i - 1).alias("name"), F.lit(9).cast("long").alias("size_bytes"))
    return joins.staging_audit(docs.select(i.alias("name"), F.col("n_chars").alias("size_bytes")), staged.union(stray))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leak_guard(spark: SparkSession, d: str) -> DataFrame:
    return joins.containing(table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle")), "doc_id", "text", "item_id", "needle")


@query("""WITH n AS (SELECT DISTINCT split_part(split_part(c_name, '#', 2), ' ', 1)[-4:] AS needle FROM customer UNION SELECT substr(n_name, 1, 3) FROM nation UNION SELECT DISTINCT list_extract(string_split(text, ' '), 3) FROM benchmark WHERE len(string_split(text, ' ')) >= 3)
SELECT needle, count(*) AS n_documents FROM n JOIN documents ON contains(text, needle) GROUP BY 1""")
def spotted_words(spark: SparkSession, d: str) -> DataFrame:
    """Thousands of needles of a word or less: ends of customers' numbers, beginnings of nations, third words of benchmark items."""
    words = F.split("text", " ")
    needles = table(spark, d, "customer").select(F.substring(F.substring_index("c_name", "#", -1), -4, 4).alias("needle"))
    needles = needles.union(table(spark, d, "nation").select(F.substring("n_name", 1, 3))).union(table(spark, d, "benchmark").filter(F.size(words) >= 3).select(F.element_at(words, 3))).distinct()
    pairs = joins.spotted(table(spark, d, "documents"), needles.withColumn("n", F.col("needle")), "doc_id", "text", "n", "needle")
    return pairs.groupBy(F.col("n").alias("needle")).agg(F.count("*").alias("n_documents"))


@query(f"""WITH {CORPUS}, e AS (SELECT lang, split, min(licence) AS a, max(licence) AS b FROM corpus GROUP BY ALL), f AS (SELECT lang, count(*) AS have, min(a) AS source, max(b) AS other FROM e GROUP BY 1), n AS (SELECT count(DISTINCT split) AS n FROM corpus)
SELECT lang, CASE WHEN have >= n AND source = other THEN source END AS source, CASE WHEN have < n THEN 'candidate missing' WHEN source <> other THEN 'sources differ' END AS reason FROM f, n""")
def same_source_matrix(spark: SparkSession, d: str) -> DataFrame:
    return joins.aligned(corpus(spark, d), "lang", "split", "licence")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 100)")
def missing_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return joins.absent(table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").filter("n_chars >= 100"), "doc_id")


@query("""WITH s AS (SELECT source AS name, sum(n_chars)::DOUBLE AS total, stddev_pop(n_chars) AS std FROM documents GROUP BY 1), b AS (SELECT source AS name, sum(n_chars)::DOUBLE AS t0, stddev_pop(n_chars) AS s0 FROM documents WHERE n_chars >= 40 GROUP BY 1)
SELECT count(*) AS compared, count(*) FILTER (abs(total - t0) > 1e-6 OR abs(std - s0) > 1e-6) AS changed, count(*) FILTER (abs(total - t0) > 1e-6 OR abs(std - s0) > 1e-6) > 0 AS has_changed FROM s JOIN b USING (name)""")
def snapshot_drift(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    profile = lambda rows: rows.groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").cast("double").alias("total"), F.stddev_pop("n_chars").alias("std"))
    return joins.drift(profile(docs), profile(docs.filter("n_chars >= 40")), tolerance=1e-6)


@query(f"WITH {SEGMENTS} SELECT id, track_id, segment_index FROM segments")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("id", "track_id", "segment_index")


@query(r"""WITH p AS (SELECT doc_id, CASE n_chars % 5 WHEN 0 THEN '/data/Track' || lpad(doc_id::VARCHAR, 5, '0') || '/stems/S01.wav' WHEN 1 THEN '/data/' || source || '/' || ['mix', 'Audio', 'song'][doc_id % 3 + 1] || '.wav' WHEN 2 THEN '/data/' || lang || '/' || source || '/take ' || doc_id || '.v2.wav' WHEN 3 THEN '/data/Track1/Track' || doc_id || '/x/mix.wav' ELSE '/data/Track' || doc_id || '.wav' END AS path,
 CASE WHEN n_chars % 3 = 0 THEN source ELSE lang || '/' || source || '/song/vocal.wav' END AS voice FROM documents), x AS (SELECT *, string_split(path, '/') AS parts, list_filter(string_split(path, '/')[:-2], lambda d: regexp_matches(d, '^Track\d+$'))[-1] AS numbered FROM p)
SELECT doc_id, printf('%03d/%06d.mp3', (doc_id % 3 * 1234567 + doc_id) // 1000, doc_id % 3 * 1234567 + doc_id) AS path,
 CASE WHEN numbered IS NOT NULL THEN numbered WHEN lower(regexp_replace(parts[-1], '\.[^.]*$', '')) IN ('mix', 'audio', 'song') THEN parts[-2] ELSE replace(regexp_replace(substr(path, 7), '\.[^./]*$', ''), '/', '__') END AS track,
 CASE WHEN len(string_split(voice, '/')) >= 4 THEN string_split(voice, '/')[-4] || '__' || string_split(voice, '/')[-3] END AS singer FROM x""")
def path_columns(spark: SparkSession, d: str) -> DataFrame:
    """Paths of five shapes, of documents' names and numbers, some of seven digits."""
    i, n = F.col("doc_id"), F.col("n_chars") % 5
    name, path = i.cast("string"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    stem = F.element_at(F.array(F.lit("mix"), F.lit("Audio"), F.lit("song")), (i % 3).cast("int") + 1)
    shapes = F.when(n == 0, path("/data/Track", F.lpad(name, 5, "0"), "/stems/S01.wav")).when(n == 1, path("/data/", F.col("source"), "/", stem, ".wav")).when(n == 2, path("/data/", F.col("lang"), "/", F.col("source"), "/take ", name, ".v2.wav")).when(n == 3, path("/data/Track1/Track", name, "/x/mix.wav")).otherwise(path("/data/Track", name, ".wav"))
    voice = F.when(F.col("n_chars") % 3 == 0, F.col("source")).otherwise(F.concat_ws("/", "lang", "source", F.lit("song"), F.lit("vocal.wav")))
    return table(spark, d, "documents").select("doc_id", columns.catalogue_path(i % 3 * 1_234_567 + i).alias("path"), columns.track_from_path(shapes, "/data").alias("track"), columns.singer_from_path(voice).alias("singer"))


@query("""SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'medium' WHEN r < 0.08 THEN 'low' WHEN r > 0.22 THEN 'high' ELSE 'medium' END AS band FROM (SELECT doc_id, n_chars, (n_chars % 100) / 300.0 AS r FROM documents)""")
def energy_bands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", columns.energy_band(F.col("n_chars") % 100 / 300.0).alias("band"))


def labelled_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments with families and names, some of which a segment lacks."""
    i, role = F.col("segment_index"), F.element_at("tags", 1)
    family = F.when(i % 5 == 4, "Mixture").when(i % 3 != 2, F.initcap(role))
    name = F.when(i % 4 == 0, F.concat(role, F.lit(" lead"))).when(i % 4 == 1, "solo voice")
    return segments(spark, d).withColumns({"instrument_family": family, "instrument_name": name})


ITEMS = f"""{SEGMENTS}, r AS (SELECT source_path AS source, path, track_id, license, duration_seconds, CASE WHEN segment_index % 5 = 4 THEN 'Mixture' WHEN segment_index % 3 <> 2 THEN upper(role[1]) || role[2:] END AS family, CASE segment_index % 4 WHEN 0 THEN role || ' lead' WHEN 1 THEN 'solo voice' END AS name FROM segments),
f AS (SELECT source, list(family ORDER BY n DESC, first) AS fs FROM (SELECT source, family, count(*) AS n, min(path) AS first FROM r WHERE family IS NOT NULL AND family <> 'Mixture' GROUP BY ALL) GROUP BY 1),
m AS (SELECT source, list(name ORDER BY n DESC, first) AS ns FROM (SELECT source, name, count(*) AS n, min(path) AS first FROM r WHERE name IS NOT NULL GROUP BY ALL) GROUP BY 1),
w AS (SELECT source, arg_min(track_id, path) AS track_id, arg_min(license, path) AS license, count(*) AS segments, sum(duration_seconds) AS seconds, coalesce(string_agg(DISTINCT family, ',' ORDER BY family), '') AS families FROM r GROUP BY 1),
items AS (SELECT source, track_id || '__' || replace(string_split(source, '/')[-1], ' ', '_') AS stem, CASE WHEN len(fs) = 1 AND len(ns) > 0 THEN 'solo ' || CASE WHEN contains(lower(ns[1]), lower(fs[1])) THEN ns[1] ELSE ns[1] || ', ' || lower(fs[1]) END
 WHEN len(fs) > 0 THEN CASE WHEN len(fs) > 2 THEN 'instrumental multitrack arrangement featuring ' ELSE 'instrumental recording featuring ' END || lower(array_to_string(fs[:8], ', ')) ELSE 'instrumental recording' END AS caption, track_id, license, segments, round(seconds, 3) AS seconds, families FROM w LEFT JOIN f USING (source) LEFT JOIN m USING (source))"""


@query(f"WITH {ITEMS} SELECT * FROM items")
def training_items(spark: SparkSession, d: str) -> DataFrame:
    out = training.items(labelled_segments(spark, d))
    return out.withColumns({"seconds": F.round("seconds", 3), "families": F.array_join("families", ",")})


@query(f"""WITH {ITEMS} SELECT 'vocal' AS goal, 'sources' AS mode, count(*) AS items, count(DISTINCT track_id) AS tracks, round((SELECT sum(duration_seconds) FROM segments), 3) AS seconds,
 (SELECT string_agg(l, ';' ORDER BY l) FROM (SELECT license || '=' || CASE WHEN contains(replace(license, '-', ''), 'NC') THEN 'non-commercial' ELSE 'permissive' END || '=' || count(*) AS l FROM segments GROUP BY license)) AS licences, (SELECT bool_or(contains(replace(license, '-', ''), 'NC')) FROM segments) AS encumbered FROM items""")
def training_card(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_segments(spark, d)
    return training.card(rows, training.items(rows), "vocal").withColumn("licences", F.array_join("licences", ";"))


@query(f"WITH {SEGMENTS} SELECT path AS source, round(duration_seconds, 6) AS seconds FROM segments WHERE duration_seconds >= 10")
def training_segments(spark: SparkSession, d: str) -> DataFrame:
    return training.items(labelled_segments(spark, d), "segments").select("source", F.round("seconds", 6).alias("seconds"))
