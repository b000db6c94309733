"""Queries over events, embeddings and lines: curves, comparisons, reviews, takes, similarity, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import experiments, joins, review, select, similarity
from .base import CURVE, curve, query, table


@query("""WITH c AS (SELECT label AS codebook, floor((unnest(embedding) + 1) * 64)::INT AS code FROM embeddings), n AS (SELECT codebook, code, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT codebook, n::DOUBLE / sum(n) OVER (PARTITION BY codebook) AS p FROM n),
u AS (SELECT codebook, count(*) AS unique_codes, -sum(p * ln(p)) AS h FROM p GROUP BY 1)
SELECT codebook, unique_codes, unique_codes / 128.0::DOUBLE AS utilization, (128 - unique_codes)::BIGINT AS dead_codes, round(h, 6) AS entropy, round(exp(h), 6) AS perplexity, unique_codes / 128.0 < 0.05 OR exp(h) < 2 AS collapsed FROM u""")
def codebook_usage(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "embeddings").select(F.col("label").alias("codebook"), F.explode("embedding").alias("x"))
    return experiments.codebook_usage(codes.withColumn("code", F.floor((F.col("x") + 1) * 64).cast("int")), "codebook", "code", 128)


@query(f"""WITH {CURVE}, p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY row_no) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM curve),
m AS (SELECT run_id, avg(loss) FILTER (i <= greatest(n // 10, 1)) AS a, avg(loss) FILTER (i > n - greatest(n // 10, 1)) AS b FROM p GROUP BY 1) SELECT run_id, round(a, 6) AS first_mean, round(b, 6) AS last_mean, b < a AS decreased FROM m""")
def curve_windows(spark: SparkSession, d: str) -> DataFrame:
    out = experiments.curve_windows(curve(spark, d), "run_id", "row_no", "loss")
    return out.withColumns({c: F.round(c, 6) for c in ("first_mean", "last_mean")})


@query(f"""WITH {CURVE}, a AS (SELECT run_id, count(*) AS n_rows, count(DISTINCT step) AS n_steps, min(step) AS first_step, max(step) AS last_step FROM curve GROUP BY 1)
SELECT *, n_rows - n_steps AS n_repeated, last_step - first_step + 1 - n_steps AS n_missing, n_rows = n_steps AND last_step - first_step + 1 = n_steps AS ok FROM a""")
def step_integrity(spark: SparkSession, d: str) -> DataFrame:
    return experiments.step_integrity(curve(spark, d), "run_id", "step")


@query(f"WITH {CURVE}, s AS (SELECT run_id, unnest(range(min(step), max(step) + 1)) AS step FROM curve GROUP BY run_id) SELECT run_id, step FROM s EXCEPT SELECT run_id, step FROM curve")
def missing_steps(spark: SparkSession, d: str) -> DataFrame:
    return experiments.missing_steps(curve(spark, d), "run_id", "step")


@query(f"""WITH {CURVE}, a AS (SELECT run_id, count(*) AS snapshots, count(*) FILTER (flag) AS n_collapsed, min(row_no) FILTER (flag) AS first_collapse, max(row_no) FILTER (flag) AS last_collapse, arg_max(flag, row_no) AS final_collapsed, min(loss) AS min_utilization, max(loss) AS max_utilization, arg_max(loss, row_no) AS final_utilization FROM curve GROUP BY 1)
SELECT *, CASE WHEN n_collapsed = 0 THEN 'never' WHEN final_collapsed THEN 'collapsed' ELSE 'recovered' END AS verdict FROM a""")
def collapse_history(spark: SparkSession, d: str) -> DataFrame:
    return experiments.collapse_history(curve(spark, d), "run_id", "row_no", "flag", "loss")


@query(f"WITH {CURVE} SELECT event_id, run_id % 5 = 0 AND step >= 20 AS superseded FROM curve")
def superseded_rows(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d)
    resumes = c.filter("run_id % 5 = 0").select("run_id").distinct().withColumn("start_step", F.lit(20))
    return experiments.superseded(c, resumes, "run_id", "step").select("event_id", "superseded")


SETTINGS = """s AS (SELECT event_type AS run, min(year(ts))::VARCHAR AS year, count(DISTINCT user_id)::VARCHAR AS users, event_type AS kind FROM events GROUP BY event_type)"""


@query(f"""WITH {SETTINGS}, l AS (SELECT run, 'year' AS setting, year AS value FROM s UNION ALL SELECT run, 'users', users FROM s UNION ALL SELECT run, 'kind', kind FROM s), c AS (SELECT setting, count(DISTINCT value) AS n_values, count(DISTINCT run) AS n FROM l GROUP BY 1)
SELECT setting, n_values, CASE WHEN setting = 'kind' THEN n_values = n ELSE n_values = 1 END AS ok FROM c""")
def fairness_agreement(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.min(F.year("ts")).cast("string").alias("year"), F.count_distinct("user_id").cast("string").alias("users"))
    return experiments.agreement(runs.withColumn("kind", F.col("run")), "run", ["year", "users", "kind"], "kind")


@query(f"""WITH {CURVE}, w AS (SELECT event_type, count(*) AS n, round(avg(loss), 6) AS mean_loss, min(loss) AS best_loss, count(DISTINCT run_id) AS runs FROM curve GROUP BY 1) SELECT *, runs = max(runs) OVER () AS complete FROM w""")
def candidate_comparison(spark: SparkSession, d: str) -> DataFrame:
    w = curve(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("mean_loss"), F.min("loss").alias("best_loss"), F.count_distinct("run_id").alias("runs"))
    return w.withColumn("complete", F.col("runs") == F.max("runs").over(Window.partitionBy()))  # a row for each candidate


@query("SELECT event_type, round(avg(value), 6) AS l1, round(sqrt(avg(value * value)), 6) AS rms, count(*) AS n FROM events GROUP BY 1")
def eval_means(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("l1"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), F.count("*").alias("n"))


PAIRED = """p AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS base, avg(value) FILTER (event_type = 'click') AS treatment FROM events GROUP BY 1)"""


@query(f"WITH {PAIRED} SELECT user_id, round(base, 6) AS base, round(treatment, 6) AS treatment, round(treatment - base, 6) AS delta FROM p WHERE base IS NOT NULL AND treatment IS NOT NULL")
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    out = joins.paired(table(spark, d, "events"), "user_id", "event_type", "value", "view", "click")
    return out.withColumns({c: F.round(c, 6) for c in ("base", "treatment", "delta")})


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return experiments.bootstrap(joins.paired(table(spark, d, "events"), "user_id", "event_type", "value", "view", "click"))


@query(f"""WITH {PAIRED}, q AS (SELECT *, treatment - base AS delta, base < 25 AS weak, user_id % 50 = 49 AS flagged FROM p WHERE base IS NOT NULL AND treatment IS NOT NULL),
a AS (SELECT avg(delta) FILTER (weak) AS weak_gain, min(delta) FILTER (NOT weak) AS worst_strong, count(*) FILTER (flagged) AS flagged FROM q)
SELECT round(weak_gain, 6) AS weak_gain, round(worst_strong, 6) AS worst_strong, flagged, coalesce(weak_gain >= 1 AND coalesce(worst_strong, 0) >= -0.5 AND flagged = 0, FALSE) AS keep FROM a""")
def keep_if_better(spark: SparkSession, d: str) -> DataFrame:
    pairs = joins.paired(table(spark, d, "events"), "user_id", "event_type", "value", "view", "click")
    flags = F.when(F.col("user_id") % 50 == 49, F.array(F.lit("clipping"))).otherwise(F.array().cast("array<string>"))
    out = experiments.keep_if_better(pairs, F.col("base") < 25, flags)
    return out.withColumns({c: F.round(c, 6) for c in ("weak_gain", "worst_strong")})


@query(f"""WITH {CURVE} SELECT event_id, max(loss) OVER w AS peak, last_value(CASE WHEN flag THEN loss END IGNORE NULLS) OVER w AS latest FROM curve WINDOW w AS (PARTITION BY run_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_peaks(spark: SparkSession, d: str) -> DataFrame:
    c = curve(spark, d)
    peaks = experiments.running(c, "run_id", ["row_no"], "loss").select("event_id", "peak")
    flagged = experiments.running(c.withColumn("f", F.when(F.col("flag"), F.col("loss"))), "run_id", ["row_no"], "f").select("event_id", "latest")
    return peaks.join(flagged, "event_id")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type = 'error' AS hit FROM events), i AS (SELECT *, n - sum(hit::INT) OVER (PARTITION BY user_id ORDER BY n) AS island FROM t),
r AS (SELECT user_id, island, sum(hit::INT) AS run FROM i GROUP BY ALL) SELECT user_id, max(run)::BIGINT AS longest, coalesce(max(run) FILTER (island = 0), 0)::BIGINT AS leading FROM r GROUP BY 1""")
def longest_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return similarity.longest_run(e, ["user_id"], "o", F.col("event_type") == "error")


@query("""WITH v AS (SELECT event_type AS series, CASE WHEN event_type = 'error' AND event_id % 90 = 0 THEN 'NaN'::DOUBLE WHEN event_type = 'click' AND event_id % 80 = 0 THEN '-Infinity'::DOUBLE WHEN event_type = 'view' THEN 4.5 ELSE value END AS v FROM events WHERE event_type <> 'view' OR event_id % 2 = 0
 UNION ALL SELECT 'silent', NULL FROM events WHERE event_id % 100 = 0)
SELECT series, count(v) AS n, count(DISTINCT round(v, 9)) > 1 AS moves, CASE WHEN count(v) > 0 THEN (bool_and(isfinite(v)) AND count(DISTINCT round(v, 9)) > 1)::VARCHAR END AS verdict, coalesce(bool_and(isfinite(v)), FALSE) AS finite FROM v GROUP BY 1""")
def health_gates(spark: SparkSession, d: str) -> DataFrame:
    """Series of which one holds NaN, one an infinity, one stands still and one has no values."""
    e, i, kind = table(spark, d, "events"), F.col("event_id"), F.col("event_type")
    value = F.when((kind == "error") & (i % 90 == 0), float("nan")).when((kind == "click") & (i % 80 == 0), float("-inf")).when(kind == "view", 4.5).otherwise(F.col("value"))
    rows = e.filter((kind != "view") | (i % 2 == 0)).select(kind.alias("series"), value.alias("value"))
    out = experiments.health(rows.union(e.filter(i % 100 == 0).select(F.lit("silent"), F.lit(None).cast("double"))), "series", "value")
    return out.select("series", "n", "moves", F.col("verdict").cast("string").alias("verdict"), F.coalesce("all_finite", F.lit(False)).alias("finite"))


@query("""SELECT event_type AS status, count(*) AS n, round(avg(value), 3) AS queue_seconds, round(avg(value * 2), 3) AS run_seconds FROM events GROUP BY 1""")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    e, us = table(spark, d, "events"), F.round(F.col("value") * 1_000_000).cast("long")
    at = lambda k: F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + us * k)
    return experiments.queue_stats(e.select(F.col("event_type").alias("status"), F.col("ts").alias("created_at"), at(1).alias("started_at"), at(3).alias("finished_at")))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events WHERE event_type = 'view'")
def queue_position(spark: SparkSession, d: str) -> DataFrame:
    """Views as jobs that are waiting."""
    jobs = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "pending").otherwise("done").alias("status"), F.col("ts").alias("created_at"))
    return experiments.queue_position(jobs, ["created_at", "event_id"]).select("event_id", "position")


@query("""SELECT event_type AS model, count(*) FILTER (user_id % 7 <> 0) AS generated, count(*) FILTER (user_id % 7 = 0) AS failed, round(sum(value) FILTER (user_id % 7 <> 0) / (60.0 * count(*) FILTER (user_id % 7 <> 0)), 6) AS real_time_factor FROM events GROUP BY 1""")
def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").select(F.col("event_type").alias("model"), F.when(F.col("user_id") % 7 == 0, "failed").alias("error"), F.col("value").alias("generation_seconds"), F.lit(60.0).alias("audio_seconds"))
    return experiments.benchmark_summary(r).withColumn("real_time_factor", F.round("real_time_factor", 6))


@query("""WITH p AS (SELECT item_id AS id, item_id % 8 AS category, item_id % 3 = 0 AS heldout, ['en', 'fr', 'ko', 'hi', 'en'][item_id % 5 + 1] AS language FROM benchmark), c AS (SELECT category, count(*) AS n, count(DISTINCT id) AS ids, count(*) FILTER (heldout) AS h FROM p GROUP BY 1),
l AS (SELECT count(DISTINCT language) AS other_languages FROM p WHERE language <> 'en'),
a AS (SELECT sum(n)::BIGINT AS prompts, sum(n) = sum(ids) AS ids_unique, min(n) AS smallest_category, sum(h)::BIGINT AS held_out, count(*) FILTER (h > 0) AS held_categories FROM c) SELECT a.*, other_languages, ids_unique AND smallest_category >= 3 AND held_out >= 10 AND held_categories >= 6 AND other_languages >= 3 AS ok FROM a, l""")
def benchmark_breadth(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    language = F.element_at(F.array(*map(F.lit, ["en", "fr", "ko", "hi", "en"])), (i % 5).cast("int") + 1)
    return experiments.breadth(table(spark, d, "benchmark").select(i.alias("id"), (i % 8).alias("category"), (i % 3 == 0).alias("heldout"), language.alias("language")))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, TRUE AS accepted, [t] AS recent, t AS opened, 1 AS used FROM e WHERE n = 1
 UNION ALL SELECT user_id, event_id, n, ok, CASE WHEN ok THEN list_append(live, t) ELSE live END, CASE WHEN ok AND fresh THEN t ELSE opened END, CASE WHEN NOT ok THEN used WHEN fresh THEN 1 ELSE used + 1 END
 FROM (SELECT *, len(live) < 2 AND (fresh OR used < 20) AS ok FROM (SELECT e.user_id, e.event_id, e.n, e.t, r.opened, r.used, list_filter(r.recent, lambda x: e.t - x <= 60000000) AS live, e.t - r.opened > 86400000000 AS fresh FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
SELECT r.event_id, r.user_id, ts, accepted FROM r JOIN events USING (event_id)""")
def rate_limit_replay(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return experiments.admitted_requests(e, "user_id", "ts", 2, 20)


def takes(spark: SparkSession, d: str) -> DataFrame:
    e, v = table(spark, d, "events"), F.col("value")
    clipped, silent, gap, repeated = F.when(v > 90, 0.01).otherwise(0.0), v % 1.0, F.floor(v / 10.0).cast("double"), (v % 7.0) / 7.0
    i = F.col("event_id")
    others = [F.when(i % 5 != 0, -v).alias("peak_db"), F.when(i % 7 != 0, v * 500).alias("rolloff"), F.when(i % 3 != 0, v % 2.0 / 2).alias("flatness"), F.when(i % 4 != 0, i % 6 == 1).alias("mono"), F.when(i % 9 != 0, v % 0.1).alias("variation")]
    rows = e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seed"), clipped.alias("clipped"), silent.alias("silent"), gap.alias("gap"), repeated.alias("repetition"), *others, F.when(F.col("event_type") == "error", "failed").alias("error"))
    measures = {c: F.col(c) for c in ("clipped", "silent", "gap", "repetition", "peak_db", "rolloff", "flatness")}
    rows = rows.withColumn("flags", arrays.flags(measures, F.col("mono"), F.lit(2)))
    score = arrays.take_score(F.size("flags"), measures, F.col("variation"))
    return rows.withColumns({"score": F.round(score, 2), "fatal": F.array_contains("flags", "mostly silent")})


TAKES = """m AS (SELECT user_id AS job, event_id AS seed, CASE WHEN value > 90 THEN 0.01::DOUBLE ELSE 0 END AS clipped, value % 1.0::DOUBLE AS silent, floor(value / 10.0::DOUBLE) AS gap, (value % 7.0::DOUBLE) / 7.0::DOUBLE AS rep, event_type = 'error' AS error,
 event_id % 5 <> 0 AND -value < -30 AS quiet, event_id % 7 <> 0 AND value * 500 < 6000 AS muffled, event_id % 3 <> 0 AND (value % 2.0::DOUBLE) / 2 > 0.5 AS noisy, event_id % 4 <> 0 AND event_id % 6 = 1 AS mono, event_id % 9 <> 0 AND value % 0.1::DOUBLE < 0.05 AS static FROM events),
f AS (SELECT *, (clipped > 1e-4)::INT + (silent > 0.35)::INT + (gap > 5)::INT + (rep > 0.85)::INT + quiet::INT + muffled::INT + noisy::INT + mono::INT AS n_flags, silent > 0.35 AS fatal FROM m),
takes AS (SELECT *, round(100 - 25.0::DOUBLE * n_flags - 40.0::DOUBLE * silent - 5.0::DOUBLE * greatest(gap - 2, 0) - 100.0::DOUBLE * clipped - 30.0::DOUBLE * greatest(rep - 0.7::DOUBLE, 0) / 0.3::DOUBLE - static::INT * 10, 2) AS score FROM f)"""


@query(f"WITH {TAKES}, r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY fatal, score DESC, seed) AS n FROM takes WHERE NOT error) SELECT job, seed, score, fatal FROM r WHERE n = 1")
def best_of_n(spark: SparkSession, d: str) -> DataFrame:
    return select.best_takes(takes(spark, d))


SHEET = """s AS (SELECT 't' || l_suppkey::VARCHAR AS track, CASE WHEN l_suppkey % 6 = 0 THEN NULL WHEN l_suppkey % 6 = 1 THEN 'N/A' ELSE round(1 + avg(l_discount) * 90, 1)::VARCHAR END AS vocal_realism,
 round(1 + avg(l_tax) * 100, 1)::VARCHAR AS prompt_adherence, round(1 + avg(l_quantity) / 6, 1)::VARCHAR AS spectral_clarity, round(2 + avg(l_linenumber), 1)::VARCHAR AS emotion FROM lineitem GROUP BY l_suppkey),
long AS (SELECT track, dimension, trim(cell) AS cell FROM s UNPIVOT INCLUDE NULLS (cell FOR dimension IN (vocal_realism, prompt_adherence, spectral_clarity, emotion))),
cells AS (SELECT track, dimension, CASE WHEN TRY_CAST(cell AS DOUBLE) BETWEEN 1 AND 10 THEN TRY_CAST(cell AS DOUBLE) END AS score, CASE WHEN coalesce(cell, '') = '' THEN 'missing' WHEN cell = 'N/A' THEN 'na' WHEN TRY_CAST(cell AS DOUBLE) BETWEEN 1 AND 10 THEN 'scored' ELSE 'bad' END AS state FROM long)"""


def sheet(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), F.avg("l_quantity").alias("c"), F.avg("l_linenumber").alias("e"))
    k, score = F.col("l_suppkey"), lambda c: F.round(c, 1).cast("string")
    wide = by.select(F.concat(F.lit("t"), k.cast("string")).alias("track"), F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, "N/A").otherwise(score(1 + F.col("a") * 90)).alias("vocal_realism"), score(1 + F.col("b") * 100).alias("prompt_adherence"), score(1 + F.col("c") / 6).alias("spectral_clarity"), score(2 + F.col("e")).alias("emotion"))
    return review.long_sheet(wide)


@query(f"WITH {SHEET} SELECT count(*) AS expected, count(*) FILTER (state = 'scored') AS filled FROM cells WHERE state <> 'na' AND dimension <> 'emotion'")
def review_completeness(spark: SparkSession, d: str) -> DataFrame:
    return review.completeness(sheet(spark, d))


@query(f"WITH {SHEET} SELECT track, dimension FROM cells WHERE state NOT IN ('na', 'scored') AND dimension <> 'emotion'")
def review_missing(spark: SparkSession, d: str) -> DataFrame:
    return review.missing_cells(sheet(spark, d)).select("track", "dimension")


@query(f"WITH {SHEET} SELECT dimension, round(avg(score), 2) AS mean, min_by(track, (score, track)) AS worst_track, min(score) AS worst_score, count(*) AS tracks_scored FROM cells WHERE state = 'scored' GROUP BY 1".replace("min_by(track, (score, track))", "arg_min(track, {'s': score, 't': track})"))
def review_rank(spark: SparkSession, d: str) -> DataFrame:
    return review.ranked_dimensions(sheet(spark, d))


AREA = f"""{SHEET}, v AS (SELECT * FROM (VALUES ('A', 'x'), ('B', 'vocal_realism'), ('B', 'emotion'), ('C', 'prompt_adherence'), ('D', 'spectral_clarity'), ('E', 'x')) AS t(area, dimension)),
areas AS (SELECT area, count(score) AS cells_scored, round(avg(score), 2) AS mean, count(score) >= 3 AS sufficient FROM v LEFT JOIN (SELECT * FROM cells WHERE state = 'scored') c ON v.dimension = c.dimension AND (area <> 'B' OR track IN ('t2', 't3', 't4', 't5', 't8')) AND (area <> 'D' OR track IN ('t1', 't7')) GROUP BY area)"""
TRACKS = {"B": ["t2", "t3", "t4", "t5", "t8"], "D": ["t1", "t7"]}


def areas(spark: SparkSession, d: str) -> DataFrame:
    """Two areas are judged by some tracks only, one of them by too few."""
    return review.ranked_areas(sheet(spark, d), tracks=TRACKS)


@query(f"WITH {AREA} SELECT area, cells_scored, mean, sufficient, row_number() OVER (ORDER BY NOT sufficient, coalesce(mean, 99), area)::INT AS rank FROM areas")
def area_rank(spark: SparkSession, d: str) -> DataFrame:
    return areas(spark, d)


@query(f"WITH {AREA} SELECT area, CASE WHEN NOT sufficient THEN 'insufficient evidence' WHEN mean >= 7 THEN 'not a weakness' WHEN area = 'B' AND mean < 4 THEN 'pretrained-model limitation (suspected)' WHEN area IN ('C', 'E') THEN 'prompt/control-layer problem' ELSE 'adapter-addressable' END AS bucket FROM areas")
def area_attribution(spark: SparkSession, d: str) -> DataFrame:
    return review.attributed(areas(spark, d))


@query(f"""WITH {AREA}, w AS (SELECT * FROM areas WHERE sufficient AND mean < 7), one AS (SELECT arg_min(area, {{'m': mean, 'a': area}}) AS worst_area, min(mean) AS worst_mean, coalesce(bool_or(area = 'C'), FALSE) AS control FROM w)
SELECT CASE WHEN worst_area IS NULL THEN 'none' WHEN control OR worst_area = 'C' THEN 'control_experiments' WHEN worst_area = 'A' THEN 'instrument_case' WHEN worst_area = 'B' THEN 'vocal_case' WHEN worst_area = 'D' THEN 'sparse_acoustic_case' ELSE 'inference_settings_sweep' END AS intervention, worst_area, worst_mean FROM one""")
def intervention(spark: SparkSession, d: str) -> DataFrame:
    return review.intervention(areas(spark, d))


def windows(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as fingerprints: items are labels and hundreds of ids, windows in order of the id."""
    e = table(spark, d, "embeddings").select(F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("vec_id") / 500).cast("string")).alias("item"), "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    return e.withColumn("j", F.row_number().over(Window.partitionBy("item").orderBy("vec_id")) - 1)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every item whole, and again without its opening: its windows from the fifth on."""
    w = windows(spark, d)
    whole = w.select(F.concat(F.lit("c"), F.col("item")).alias("candidate"), F.col("j").alias("i"), "vec")
    return whole.unionByName(w.filter("j >= 4").select(F.concat(F.lit("t"), F.col("item")).alias("candidate"), (F.col("j") - 4).alias("i"), "vec"))


def queried(spark: SparkSession, d: str) -> DataFrame:
    """A query for each vector whose id is divisible by 100: the windows of its item that begin there, four at most."""
    w = windows(spark, d)
    first = w.filter("vec_id % 100 = 0").select("item", F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("candidate"), F.col("j").alias("start"))
    return w.join(first, "item").filter("j between start and start + 3").select("candidate", (F.col("j") - F.col("start")).alias("i"), "vec")


WINDOWS = """w AS (SELECT label::VARCHAR || '-' || (vec_id // 500)::VARCHAR AS item, label, vec_id, embedding::DOUBLE[] AS vec, row_number() OVER (PARTITION BY label::VARCHAR || '-' || (vec_id // 500)::VARCHAR ORDER BY vec_id) - 1 AS j FROM embeddings),
c AS (%s),
pairs AS (SELECT candidate, item, i, j FROM c JOIN w ON list_dot_product(c.vec, w.vec) >= 0.985),
n AS (SELECT candidate, count(*) AS n FROM c GROUP BY 1), m AS (SELECT item, count(*) AS m FROM w GROUP BY 1),
o AS (SELECT candidate, item, CASE WHEN n <= m THEN j - i ELSE i - j END AS off, CASE WHEN n <= m THEN i ELSE j END AS place, abs(m - n) AS room FROM pairs JOIN n USING (candidate) JOIN m USING (item)),
l AS (SELECT *, place - row_number() OVER (PARTITION BY candidate, item, off ORDER BY place) AS island FROM o WHERE off BETWEEN 0 AND room),
r AS (SELECT candidate, item, off, max(run) AS run FROM (SELECT candidate, item, off, island, count(*) AS run FROM l GROUP BY ALL) GROUP BY ALL)"""


SCREEN = f"WITH {WINDOWS}, b AS (SELECT candidate, max(run) AS run FROM r GROUP BY 1) SELECT candidate, min(item) AS closest_item, run AS matched_windows, run >= 3 AS suspicious FROM r JOIN b USING (candidate, run) GROUP BY candidate, run"


@query(SCREEN % "SELECT 'c' || item AS candidate, j AS i, vec FROM w UNION ALL SELECT 't' || item, j - 4, vec FROM w WHERE j >= 4")
def near_dup_screen(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).select("item", "j", "vec")
    return similarity.by_blocks(candidates(spark, d), w, 64).select("candidate", "closest_item", "matched_windows", "suspicious")


@query(SCREEN % "SELECT 'q' || q.vec_id AS candidate, w.j - q.j AS i, w.vec FROM w JOIN w q ON w.item = q.item AND q.vec_id % 100 = 0 AND w.j BETWEEN q.j AND q.j + 3")
def few_candidates_screen(spark: SparkSession, d: str) -> DataFrame:
    w = windows(spark, d).select("item", "j", "vec")
    return similarity.by_matrix(queried(spark, d), w).select("candidate", "closest_item", "matched_windows", "suspicious")


@query(f"""WITH {WINDOWS % "SELECT 'q' || q.vec_id AS candidate, w.j - q.j AS i, list_reverse(w.vec) AS vec FROM w JOIN w q ON w.item = q.item AND q.vec_id % 100 = 0 AND w.j BETWEEN q.j AND q.j + 3"},
x AS (SELECT candidate, item, list_dot_product(c.vec, w.vec) AS cos, CASE WHEN n <= m THEN j - i ELSE i - j END AS off, abs(m - n) AS room FROM c CROSS JOIN w JOIN n USING (candidate) JOIN m USING (item)),
y AS (SELECT candidate, item, max(cos) AS cos FROM x WHERE off BETWEEN 0 AND room GROUP BY ALL)
SELECT candidate, arg_min(item, {{'below': -cos, 'item': item}}) AS closest_item, round(max(cos), 6) AS max_cosine FROM y GROUP BY 1 HAVING max(cos) > 0""")
def closest_items(spark: SparkSession, d: str) -> DataFrame:
    """The closest item of each query of `few_candidates_screen` with its vectors reversed, which are near to nothing."""
    w = windows(spark, d).select("item", "j", "vec")
    found = similarity.nearest(queried(spark, d).withColumn("vec", F.reverse("vec")), w)
    return found.withColumn("max_cosine", F.round("max_cosine", 6))


@query("""WITH h AS (SELECT sha256(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1) SELECT d.doc_id AS candidate, first AS exact_duplicate_of FROM documents d JOIN h ON sha256(d.text) = h WHERE d.doc_id % 100 = 0""")
def exact_dup_screen(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose id is divisible by 100 as candidates, against all."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.sha2("text", 256).alias("pcm_sha256"))
    return similarity.exact(rows.filter("item % 100 = 0"), rows)


@query("""WITH n AS (SELECT vec_id, 64 AS n FROM embeddings) SELECT vec_id, s AS start_sample, round(list_sum(list_transform(embedding[s + 1 : s + 24], lambda x: abs(x::DOUBLE))), 6) AS total FROM embeddings, (SELECT unnest([0, 16, 32, 48]) AS s)""")
def segment_bounds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(arrays.segment_starts(F.size("embedding"), 24, 16, True)).alias("start_sample"))
    part = arrays.segment(F.col("embedding"), F.col("start_sample"), 24)
    return e.select("vec_id", "start_sample", F.round(F.aggregate(part, F.lit(0.0), lambda s, v: s + F.abs(v.cast("double"))), 6).alias("total"))


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), y AS (SELECT vec_id, list_max(list_transform(e, lambda v: abs(v))) AS peak, sqrt(list_sum(list_transform(e, lambda v: v * v)) / 64) AS rms, list_sum(e) / 64 AS dc, len(list_filter(e, lambda v: abs(v) >= 0.3)) / 64.0::DOUBLE AS c FROM x)
SELECT vec_id, round(peak, 6) AS peak, round(rms, 6) AS rms, round(20 * log10(peak), 6) AS peak_dbfs, round(20 * log10(rms), 6) AS rms_dbfs, round(c, 6) AS clipping_ratio, round(dc, 6) AS dc, 20 * log10(rms) < -60 AS silent, c > 0.01 AS clipped FROM y""")
def amplitude_stats(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "embeddings").select("vec_id", arrays.levels(F.col("embedding"), 0.3).alias("s")).select("vec_id", "s.*")
    out = s.withColumns({"silent": arrays.is_silent(F.col("rms_dbfs")), "clipped": arrays.is_clipped(F.col("clipping_ratio"))})
    return out.withColumns({c: F.round(c, 6) for c in ("peak", "rms", "peak_dbfs", "rms_dbfs", "clipping_ratio", "dc")})


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), g AS (SELECT vec_id, e, least(0.95::DOUBLE / list_max(list_transform(e, lambda v: abs(v))), 2.0::DOUBLE) AS g FROM x)
SELECT vec_id, round(list_sum(list_transform(e, lambda v: abs(greatest(least(v * g, 1.0), -1.0)))), 5) AS total FROM g""")
def normalised(spark: SparkSession, d: str) -> DataFrame:
    n = arrays.normalized(F.col("embedding"), 0.95, "peak", 2.0)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(n, F.lit(0.0), lambda s, v: s + F.abs(v)), 5).alias("total"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(embedding[i]::DOUBLE + embedding[65 - i]::DOUBLE) / 2)), 5) AS mono, round(embedding[20]::DOUBLE, 6) AS centre, len(embedding)::INT AS n FROM embeddings""")
def channel_policies(spark: SparkSession, d: str) -> DataFrame:
    pair = F.array(F.col("embedding"), F.reverse("embedding"))
    mono = F.aggregate(arrays.to_mono(pair), F.lit(0.0), lambda s, v: s + F.abs(v))
    three = arrays.to_channels(pair, 3)
    return table(spark, d, "embeddings").select("vec_id", F.round(mono, 5).alias("mono"), F.round(F.get(arrays.fitted(F.col("embedding"), 32), F.lit(3)).cast("double"), 6).alias("centre"), F.size(F.get(three, F.lit(2))).alias("n"))


@query("""WITH p AS (SELECT a.label, a.embedding::DOUBLE[] AS p, b.embedding::DOUBLE[] AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), e AS (SELECT *, list_dot_product(p, t) / list_dot_product(t, t) AS g FROM p),
s AS (SELECT label, list_sum(list_transform(range(1, 65), lambda i: abs(p[i] - t[i]))) / 64 AS l1, 10 * log10(greatest(list_dot_product(t, t) / 64, 1e-8) / greatest(list_sum(list_transform(range(1, 65), lambda i: (p[i] - t[i]) ** 2)) / 64, 1e-8)) AS snr,
 10 * log10(greatest(g * g * list_dot_product(t, t), 1e-12) / greatest(list_sum(list_transform(range(1, 65), lambda i: (p[i] - g * t[i]) ** 2)), 1e-12)) AS si FROM e)
SELECT label, round(avg(l1), 5) AS l1, round(avg(snr), 4) AS snr, round(avg(si), 4) AS si_sdr, count(*) AS n FROM s GROUP BY 1""")
def reconstruction_means(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("t")), "vec_id")
    m = pairs.select("label", arrays.reconstruction(F.col("embedding"), F.col("t")).alias("m"))
    return m.groupBy("label").agg(F.round(F.avg("m.l1"), 5).alias("l1"), F.round(F.avg("m.snr"), 4).alias("snr"), F.round(F.avg("m.si_sdr"), 4).alias("si_sdr"), F.count("*").alias("n"))


@query("""WITH h AS (SELECT item_id, ['a', 'b', 'c', 'zz', NULL][item_id % 5 + 1] AS family FROM benchmark WHERE item_id % 3 = 0), f AS (SELECT doc_id AS item_id FROM documents WHERE doc_id % 4 = 0)
SELECT item_id, 'also in the frozen set' AS problem FROM h WHERE item_id IN (SELECT item_id FROM f) UNION ALL SELECT item_id, 'unknown family ' || coalesce(family, 'null') FROM h WHERE coalesce(family, 'null') NOT IN ('a', 'b', 'c')""")
def held_out_problems(spark: SparkSession, d: str) -> DataFrame:
    """Every third benchmark item as held out, of families of which two aren't known."""
    i = F.col("item_id")
    held = table(spark, d, "benchmark").filter(i % 3 == 0).select("item_id", F.get(F.array(*map(F.lit, ("a", "b", "c", "zz"))), (i % 5).cast("int")).alias("family"))
    frozen = table(spark, d, "documents").filter("doc_id % 4 = 0").select(F.col("doc_id").alias("item_id"))
    return joins.held_out_problems(held, frozen, spark.createDataFrame([("a",), ("b",), ("c",)], "family string"), "item_id", "family")
