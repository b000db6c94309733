"""Queries of reports that join or roll up others: sets of buckets, preprocessing, probes, sweeps, given splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import licences
from ..operators import experiments, reports, splits
from .base import BUCKET, CORPUS, CURVE, SEGMENTS, SPLIT, corpus, curve, query, segments, table

DEPLOYABLE = ["cc0_public_domain", "cc_by"]


@query(f"""WITH {CORPUS}, c AS (SELECT coalesce(nullif(trim(lang), ''), '(none)') AS lang, coalesce(nullif(trim(dataset), ''), '(none)') AS dataset, duration_seconds AS s, n_chars * 1e6 AS b FROM corpus WHERE {BUCKET.format(l="licence")} IN ('cc0_public_domain', 'cc_by')),
l AS (SELECT 'lang' AS dimension, lang AS item FROM c UNION ALL SELECT 'dataset', dataset FROM c), n AS (SELECT dimension, item, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, item) AS rank FROM n)
SELECT dimension, item, n, rank::INT AS rank, NULL::DOUBLE AS hours, NULL::DOUBLE AS gigabytes FROM r WHERE rank <= CASE dimension WHEN 'lang' THEN 12 ELSE 5 END
UNION ALL SELECT NULL, NULL, count(*), 0, round(coalesce(sum(s), 0) / 3600, 1), round(coalesce(sum(b), 0) / 1e9, 3) FROM c""")
def census_rollup_set(spark: SparkSession, d: str) -> DataFrame:
    """The deployable buckets together: their languages and most frequent datasets."""
    rows = corpus(spark, d).withColumn("bucket", licences.bucket(F.col("licence")))
    return reports.rollup_set(rows, "bucket", DEPLOYABLE, {"lang": 12, "dataset": 5}, "duration_seconds", F.col("n_chars") * 1e6)


@query(f"""WITH {SEGMENTS}, a AS (SELECT * FROM segments WHERE NOT silent), r AS (SELECT *, CASE WHEN segment_index % 2 = 0 THEN 'silence' ELSE 'decode' END AS stage FROM segments WHERE silent)
SELECT count(*) AS segments, count(DISTINCT source_path) AS files_used, count(DISTINCT track_id) AS tracks, count(DISTINCT singer_id) AS singers, string_agg(DISTINCT instrument_family, ',' ORDER BY instrument_family) AS instrument_families, round(sum(duration_seconds), 3) AS seconds,
 (SELECT count(DISTINCT source_path) FROM r WHERE stage <> 'silence') AS skipped_files, (SELECT count(*) FROM r) AS skipped FROM a""")
def preprocess_report(spark: SparkSession, d: str) -> DataFrame:
    """Short turns as rejects, by their place silent or undecodable."""
    rows = segments(spark, d)
    stage = F.when(F.col("segment_index") % 2 == 0, "silence").otherwise("decode")
    return reports.preprocess_stats(rows.filter("NOT silent"), rows.filter("silent").withColumn("stage", stage))


PROBE = """probe AS (SELECT event_type AS candidate, user_id AS item, CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS phase, avg(abs(value)) AS l1, avg(value * value) AS mrstft FROM events WHERE event_type <> 'view' OR event_id % 2 = 0 OR user_id % 5 > 0 GROUP BY ALL),
means AS (SELECT candidate, phase, count(*) AS n, list(item ORDER BY item) AS items, avg(l1) AS l1, avg(mrstft) AS mrstft, avg(l1) + avg(mrstft) AS recon_loss FROM probe GROUP BY ALL),
pair AS (SELECT candidate, metric, max(v) FILTER (phase = 'before') AS before, max(v) FILTER (phase = 'after') AS after, max(n) FILTER (phase = 'after') AS n_items, coalesce(any_value(items) FILTER (phase = 'before') = any_value(items) FILTER (phase = 'after'), FALSE) AS same_items
 FROM (SELECT candidate, phase, n, items, unnest(['l1', 'mrstft', 'recon_loss']) AS metric, unnest([l1, mrstft, recon_loss]) AS v FROM means) GROUP BY ALL)"""


def probed(spark: SparkSession, d: str) -> DataFrame:
    """Users as probe items and kinds of events as candidates, each measured before (even ids) and after; of views some items lack one."""
    e = table(spark, d, "events").filter((F.col("event_type") != "view") | (F.col("event_id") % 2 == 0) | (F.col("user_id") % 5 > 0))
    phase = F.when(F.col("event_id") % 2 == 0, "before").otherwise("after")
    items = e.groupBy(F.col("event_type").alias("candidate"), F.col("user_id").alias("item"), phase.alias("phase")).agg(F.avg(F.abs("value")).alias("l1"), F.avg(F.col("value") * F.col("value")).alias("mrstft"))
    return experiments.probe_means(items, "candidate", "phase", "item", ["l1", "mrstft"], ["l1", "mrstft"])


@query(f"WITH {PROBE} SELECT candidate, metric, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta, n_items, same_items FROM pair")
def probe_before_after(spark: SparkSession, d: str) -> DataFrame:
    return probed(spark, d).withColumns({c: F.round(c, 6) for c in ("before", "after", "delta")})


@query(f"""WITH {CURVE}, {PROBE}, t AS (SELECT event_type AS candidate, loss, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n, event_id FROM curve WHERE event_type <> 'error'),
w AS (SELECT candidate, count(*) AS n_steps, max(event_id) AS last_step, avg(loss) FILTER (i <= greatest(n // 10, 1)) AS first_mean, avg(loss) FILTER (i > n - greatest(n // 10, 1)) AS last_mean FROM t GROUP BY 1),
h AS (SELECT event_type AS candidate, count(*) FILTER (flagged) AS n_collapsed, arg_max(flagged, event_id) AS final, arg_max(value, event_id) AS final_utilization FROM (SELECT *, value < 5 AS flagged FROM events) GROUP BY 1),
j AS (SELECT c.candidate, n_steps, last_step, first_mean, last_mean, p.before, p.after, p.same_items, CASE WHEN n_collapsed = 0 THEN 'never' WHEN final THEN 'collapsed' ELSE 'recovered' END AS codebooks, n_collapsed, final_utilization, n_steps IS NOT NULL AND coalesce(same_items, FALSE) AS complete
 FROM (SELECT DISTINCT event_type AS candidate FROM events) c LEFT JOIN w USING (candidate) LEFT JOIN (SELECT * FROM pair WHERE metric = 'recon_loss') p USING (candidate) LEFT JOIN h USING (candidate))
SELECT candidate, n_steps, last_step, round(first_mean, 6) AS first_mean, round(last_mean, 6) AS last_mean, (last_mean < first_mean)::VARCHAR AS decreased, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta, same_items::VARCHAR AS same_items, codebooks, n_collapsed, round(final_utilization, 6) AS final_utilization, complete,
 CASE WHEN complete THEN row_number() OVER (ORDER BY complete DESC, after NULLS LAST, candidate) END::INT AS place FROM j""")
def sweep_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of events as candidates; errors have no curve."""
    e = table(spark, d, "events")
    curves = curve(spark, d).filter("event_type <> 'error'").select(F.col("event_type").alias("candidate"), F.col("event_id").alias("step"), "loss")
    history = experiments.collapse_history(e.withColumn("low", F.col("value") < 5).withColumnRenamed("event_type", "candidate"), "candidate", "event_id", "low", "value")
    out = experiments.comparison(e.select(F.col("event_type").alias("candidate")), curves, probed(spark, d), history)
    out = out.withColumns({c: F.col(c).cast("string") for c in ("decreased", "same_items")})
    return out.withColumns({c: F.round(c, 6) for c in ("first_mean", "last_mean", "before", "after", "delta", "final_utilization")})


GIVEN = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 97 = 0 THEN 'dev' WHEN length(source) % 2 = 0 THEN 'train' WHEN doc_id % 41 = 0 THEN 'test' ELSE 'val' END"


@query(f"""WITH g AS (SELECT doc_id, source, {GIVEN} AS split FROM documents), f AS (SELECT source, min(split) FILTER (split IN ('train', 'val', 'test')) AS own FROM g GROUP BY 1)
SELECT doc_id, coalesce(split, own, {SPLIT.format(k="source")}) AS split FROM g JOIN f USING (source)""")
def split_preserve(spark: SparkSession, d: str) -> DataFrame:
    return splits.preserved(given(spark, d), "split", "source")[0].select("doc_id", "split")


@query(f"""WITH g AS (SELECT doc_id, source, {GIVEN} AS split FROM documents)
SELECT source, 'unknown split: dev' AS problem FROM g WHERE split = 'dev' GROUP BY 1 UNION ALL SELECT source, 'in several splits: ' || string_agg(DISTINCT split, ',' ORDER BY split) FROM g GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_preserve_problems(spark: SparkSession, d: str) -> DataFrame:
    return splits.preserved(given(spark, d), "split", "source")[1]


def given(spark: SparkSession, d: str) -> DataFrame:
    """Documents with splits by source, some without, some of another name, some apart from their source."""
    i = F.col("doc_id")
    split = F.when(i % 7 == 0, F.lit(None)).when(i % 97 == 0, "dev").when(F.length("source") % 2 == 0, "train").when(i % 41 == 0, "test").otherwise("val")
    return table(spark, d, "documents").select("doc_id", "source", split.alias("split"))
