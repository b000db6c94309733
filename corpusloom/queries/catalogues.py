"""Queries over catalogues: values, gates, quotas, stems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, text
from ..operators import gates, reports, select
from .base import BUCKET, CATALOGUE, catalogue, query, table

B = BUCKET.format(l="licence")
SCORE = """round((CASE WHEN trim(genre_top) <> '' THEN 2.0 ELSE 0.0 END + 0.5 * least(length(digits), 5) + CASE WHEN language <> '' THEN 1.0 ELSE 0.0 END + CASE WHEN bit_rate >= 256000 THEN 2.0 WHEN bit_rate >= 192000 THEN 1.0 ELSE 0.0 END
 + CASE WHEN duration BETWEEN 60 AND 420 THEN 1.0 ELSE 0.0 END + least(log10(listens + 1), 2.0))::DOUBLE, 3)"""
REASON = f"CASE WHEN {B} NOT IN ('cc0_public_domain', 'cc_by') THEN 'license' WHEN duration NOT BETWEEN 30 AND 600 THEN 'duration' WHEN bit_rate > 0 AND bit_rate < 128000 THEN 'bitrate' WHEN genre_top = 'LARGE' THEN 'genre_excluded' END"


def scored(spark: SparkSession, d: str) -> DataFrame:
    c = catalogue(spark, d)
    value = columns.value_score(F.col("genre_top"), F.size(columns.genre_ids(F.col("genres_all"))), F.col("language"), F.col("bit_rate"), F.col("duration"), F.col("listens"))
    return gates.reject_reason(c.withColumn("value", value), ["LARGE"]).withColumn("score", F.col("value.score"))


@query(f"WITH {CATALOGUE} SELECT track_id, {SCORE} AS score, length(digits)::INT AS n_fine FROM catalogue")
def value_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("track_id", "score", F.size(columns.genre_ids(F.col("genres_all"))).alias("n_fine"))


@query(f"WITH {CATALOGUE} SELECT coalesce({REASON}, 'candidate') AS reason, count(*) AS n FROM catalogue GROUP BY 1")
def sequential_rejects(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy(F.coalesce("reject_reason", F.lit("candidate")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {CATALOGUE}, c AS (SELECT track_id, CASE WHEN genre_top = '' THEN '(untagged)' ELSE genre_top END AS bucket, {SCORE} AS score FROM catalogue WHERE {REASON} IS NULL),
s AS (SELECT bucket, sqrt(count(*)) AS w FROM c GROUP BY 1), q AS (SELECT bucket, greatest(1, round_even(100 * w / sum(w) OVER (), 0)) AS quota0 FROM s), q2 AS (SELECT bucket, CASE WHEN bucket = '(untagged)' THEN least(quota0, 15) ELSE quota0 END AS quota FROM q),
r AS (SELECT c.*, quota, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, track_id) AS n FROM c JOIN q2 USING (bucket))
SELECT track_id, bucket, score FROM r WHERE n <= quota ORDER BY score DESC, track_id LIMIT 100""")
def sqrt_quota_selection(spark: SparkSession, d: str) -> DataFrame:
    """The 100 best within quotas (a selection's target)."""
    return select.value_ranked(scored(spark, d).filter("reject_reason is null"), 100).select("track_id", "bucket", "score")


@query(f"""WITH {CATALOGUE}, r AS (SELECT track_id, artist, row_number() OVER (PARTITION BY artist ORDER BY sha256('42:' || track_id)) AS turn FROM catalogue)
SELECT track_id, artist, turn::INT AS turn FROM r ORDER BY turn, artist LIMIT 120""")
def round_robin_selection(spark: SparkSession, d: str) -> DataFrame:
    """One of each artist in turn until 120 (a selection's target)."""
    return select.round_robin(catalogue(spark, d).select("track_id", "artist"), "artist", "track_id", 120).select("track_id", "artist", "turn")


@query(f"""WITH {CATALOGUE}, g AS (SELECT unnest(string_split(regexp_replace(digits, '(.)', '\\1,', 'g'), ',')) AS id FROM catalogue WHERE genre_top = '')
SELECT CASE WHEN id IN ('1', '2') THEN 'Genre ' || id ELSE id END AS genre, count(*) AS n FROM g WHERE id <> '' GROUP BY 1""")
def genre_coverage(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("1", "Genre 1"), ("2", "Genre 2")], "genre_id string, title string")
    rows = catalogue(spark, d).withColumn("fine", columns.genre_ids(F.col("genres_all")))
    return reports.genre_coverage(rows, "genre_top", "fine", names)


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' ') || [lower(p_type)], lambda x: lower(trim(x))))), ',') AS tags FROM part""")
def normalize_tags(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.split("p_name", " "), F.array(F.concat(F.lit(" "), F.col("p_type"), F.lit("  ")), F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", F.array_join(columns.normalize_tags(raw), ",").alias("tags"))


def stems(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(F.col("l_orderkey").alias("track_id"), F.col("p_type").alias("family"), (-F.col("l_quantity")).alias("loudness"), (F.col("l_linenumber") != 7).alias("rendered"))


STEMS = "stems AS (SELECT l_orderkey AS track_id, CASE WHEN p_type = 'PROMO' THEN 'STANDARD' ELSE p_type END AS family, -l_quantity AS loudness, l_linenumber <> 7 AS rendered FROM lineitem JOIN part ON l_partkey = p_partkey)"
PROFILE = f"""{STEMS}, profile AS (SELECT track_id, coalesce(string_agg(DISTINCT family, ',' ORDER BY family) FILTER (rendered), '') AS families, coalesce(string_agg(DISTINCT family, ',' ORDER BY family) FILTER (rendered AND loudness >= -30), '') AS audible, count(*) AS stems, count(*) >= 3 AND bool_and(rendered) AS eligible FROM stems GROUP BY 1)"""


@query(f"WITH {PROFILE} SELECT * FROM profile")
def track_profile(spark: SparkSession, d: str) -> DataFrame:
    p = reports.track_profile(stems(spark, d), {"PROMO": "STANDARD"}, -30.0, 3)
    return p.withColumns({c: F.array_join(c, ",") for c in ("families", "audible")})


QUOTAS = {"ECONOMY": 20, "LARGE": 20, "MEDIUM": 20, "SMALL": 30, "STANDARD": 10}


def covering(spark: SparkSession, d: str) -> DataFrame:
    p = reports.track_profile(stems(spark, d), {"PROMO": "STANDARD"}, -30.0, 3).filter("eligible")
    return select.greedy_cover(p, 60, QUOTAS).join(p, "track_id")


_F = list(QUOTAS)
_WORTH = " + ".join(f"CASE WHEN q{k} > 0 AND list_contains(p.aud, '{f}') THEN 1.0::DOUBLE / {f.lower()}_n ELSE 0 END" for k, f in enumerate(_F))
GREEDY = f"""RECURSIVE {PROFILE}, p AS (SELECT track_id, string_split(audible, ',') AS aud, audible, len(list_filter(string_split(families, ','), lambda f: f <> '')) AS nf FROM profile WHERE eligible),
c AS (SELECT {", ".join(f"count(*) FILTER (list_contains(aud, '{f}')) AS {f.lower()}_n" for f in _F)} FROM p),
g AS (SELECT 0 AS pick, NULL::BIGINT AS track_id, ''::VARCHAR AS audible, []::BIGINT[] AS taken, {", ".join(f"{q} AS q{k}" for k, q in enumerate(QUOTAS.values()))}
 UNION ALL SELECT pick + 1, b.id, b.audible, list_append(taken, b.id), {", ".join(f"q{k} - CASE WHEN q{k} > 0 AND list_contains(b.aud, '{f}') THEN 1 ELSE 0 END" for k, f in enumerate(_F))} FROM (
 SELECT g.pick, g.taken, {", ".join(f"g.q{k}" for k in range(len(_F)))}, arg_max({{'id': p.track_id, 'audible': p.audible, 'aud': p.aud}}, {{'w': {_WORTH} + 1e-6::DOUBLE * nf, 'id': p.track_id}}) AS b FROM g, p, c WHERE g.pick < 60 AND NOT list_contains(g.taken, p.track_id) GROUP BY ALL))"""


@query(f"WITH {GREEDY} SELECT (pick - 1)::INT AS pick, track_id, audible FROM g WHERE pick > 0")
def greedy_coverage(spark: SparkSession, d: str) -> DataFrame:
    """60 tracks (a selection's target)."""
    return covering(spark, d).select("pick", "track_id", F.array_join("audible", ",").alias("audible"))


@query(f"WITH {GREEDY}, w AS (SELECT * FROM (VALUES {', '.join(f"('{f}', {q})" for f, q in QUOTAS.items())}) AS t(family, quota)), h AS (SELECT unnest(string_split(audible, ',')) AS family FROM g WHERE pick > 0) SELECT family, quota, count(h.family) AS got, greatest(quota - count(h.family), 0) AS unmet FROM w LEFT JOIN h USING (family) GROUP BY family, quota")
def quota_coverage(spark: SparkSession, d: str) -> DataFrame:
    return reports.quota_coverage(covering(spark, d), QUOTAS)


@query("""SELECT p_partkey, frames::BIGINT AS frames, round(frames * 2 * 10.0 / ((p_size * 24000) / 24000.0), 6)::DOUBLE AS bits_per_second, round((p_size * 24000 * 16) / (frames * 2 * 10.0), 6)::DOUBLE AS ratio FROM (SELECT p_partkey, p_size, ceil(p_size * 24000 / 320.0) AS frames FROM part)""")
def compression_stats(spark: SparkSession, d: str) -> DataFrame:
    c = columns.compression(F.lit(24000), F.lit(320), F.lit(2), F.lit(1024), F.col("p_size") * 24000)
    return table(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", F.col("c.frames").cast("long").alias("frames"), F.round("c.bits_per_second", 6).alias("bits_per_second"), F.round("c.ratio", 6).alias("ratio"))


@query("""SELECT p_type AS genre, 'solo ' || lower(p_type) AS solo, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS x FROM part GROUP BY 1""")
def metadata_captions(spark: SparkSession, d: str) -> DataFrame:
    """A caption for each genre of its name alone."""
    g = table(spark, d, "part").groupBy(F.col("p_type").alias("genre")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ", ").alias("x"))
    return g.select("genre", text.label_caption(F.array("genre"), F.array(F.lower("genre"))).alias("solo"), "x")


def _pick(bank: list[str], slot: str, key: str = "p_partkey::VARCHAR") -> str:
    """The SQL of `columns.pick`."""
    quoted = "[" + ", ".join("'" + b.replace("'", "''") + "'" for b in bank) + "]"
    return f"{quoted}[(('0x' || substr(sha256('0:{slot}:' || {key}), 1, 8))::UBIGINT % {len(bank)})::BIGINT + 1]"


def _humanised(items: str) -> str:
    return f"CASE len({items}) WHEN 0 THEN '' WHEN 1 THEN {items}[1] ELSE array_to_string({items}[:-2], ', ') || ' and ' || {items}[-1] END"


#: `fix_articles` in two passes, as RE2 has no lookahead: an before a vowel, then a before other letters.
_ARTICLES = r"regexp_replace(regexp_replace({x}, '\b([Aa])\s+([aeiouAEIOU])', '\1n \2', 'g'), '\b([Aa])n\s+([0-9A-Z_a-z])', '\1#\2', 'g')"
_FIXED = r"regexp_replace(regexp_replace({x}, '\b([Aa])#([aeiouAEIOU])', '\1n \2', 'g'), '\b([Aa])#', '\1 ', 'g')".replace("{x}", _ARTICLES)
NARRATIVE = f"""f AS (SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE p_type END AS genre, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE '' END AS mood, CASE WHEN p_partkey % 16 IN (0, 5) THEN [] ELSE string_split(p_name, ' ') || CASE WHEN p_partkey % 2 = 0 THEN ['piano', 'cello'] ELSE [] END END AS items,
 CASE p_partkey % 7 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'choir' WHEN 3 THEN 'duet' WHEN 4 THEN 'robot' ELSE '' END AS vocal, CASE p_partkey % 6 WHEN 0 THEN 'build' WHEN 1 THEN 'steady' WHEN 2 THEN 'arc' WHEN 3 THEN 'decay' WHEN 4 THEN 'odd' ELSE '' END AS arc,
 CASE WHEN p_partkey % 5 <> 0 THEN p_size * 4 END AS bpm, CASE WHEN p_partkey % 4 <> 0 THEN 'C minor' END AS key, CASE WHEN p_partkey % 9 = 0 THEN 'lo-fi TAPE' END AS production, CASE WHEN p_size < 10 THEN 'low' WHEN p_size > 40 THEN 'high' ELSE 'medium' END AS band FROM part),
w AS (SELECT *, CASE band {" ".join(f"WHEN '{b}' THEN {_pick(words, 'energy')}" for b, words in text.ENERGY_WORDS.items())} END AS energy, coalesce(nullif(lower(genre), ''), 'instrumental') AS g, coalesce(nullif(mood, ''), {_pick(text.MOOD_WORDS, "mood")}) AS m, {_pick(text.NOUNS, "noun")} AS noun,
 {_pick(text.OPENERS, "opener")} AS opener, {_pick(text.LEADS, "lead")} AS lead, {_pick(text.SUPPORTS, "support")} AS support, items[2:6] AS rest,
 coalesce(nullif(arc, ''), CASE WHEN ('0x' || substr(sha256('0:arc:' || p_partkey::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.4 THEN 'build' ELSE 'steady' END) AS moves FROM f),
s AS (SELECT *, concat_ws(', ', replace(replace(replace(replace(opener, '{{energy}}', energy), '{{genre}}', g), '{{noun}}', noun), '{{mood}}', m), CASE WHEN len(items) > 0 THEN replace(lead, '{{lead}}', items[1]) END, CASE WHEN len(items) > 1 THEN replace(support, '{{rest}}', {_humanised("rest")}) END,
 CASE vocal {" ".join(f"WHEN '{v}' THEN 'featuring {p}'" for v, p in text.VOCAL_PHRASES.items())} WHEN '' THEN 'performed instrumentally' END) || '.' AS sentence,
 CASE moves {" ".join(f"WHEN '{a}' THEN {_pick(bank, 'arc')}" for a, bank in text.ARCS.items())} ELSE {_pick(text.ARCS["steady"], "arc")} END AS moved,
 CASE WHEN bpm IS NOT NULL AND key IS NOT NULL THEN 'Around ' || bpm || ' BPM in ' || key || '.' WHEN bpm IS NOT NULL THEN 'Around ' || bpm || ' BPM.' WHEN key IS NOT NULL THEN 'In ' || key || '.' END AS tempo, CASE WHEN production IS NOT NULL THEN 'Lo-fi tape production.' END AS made FROM w),
captions AS (SELECT p_partkey, CASE WHEN len(items) > 0 OR genre <> '' THEN {_FIXED.replace("{x}", "concat_ws(' ', sentence, moved, tempo, made)")} END AS caption FROM s)"""


def captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions of parts taken for recordings, of which each lacks some fields."""
    p, size, k = table(spark, d, "part"), F.col("p_size"), F.col("p_partkey")
    band = F.when(size < 10, "low").when(size > 40, "high").otherwise("medium")
    none = F.array().cast("array<string>")
    items = F.when((k % 16).isin(0, 5), none).otherwise(F.concat(F.split("p_name", " "), F.when(k % 2 == 0, F.array(F.lit("piano"), F.lit("cello"))).otherwise(none)))
    dealt = lambda n, words: F.coalesce(F.get(F.array(*map(F.lit, words)), (k % n).cast("int")), F.lit(""))
    vocal, arc = dealt(7, ["female", "male", "choir", "duet", "robot"]), dealt(6, ["build", "steady", "arc", "decay", "odd"])
    caption = text.narrative_caption(k, band, F.when(k % 8 == 0, "").otherwise(F.col("p_type")), F.when(k % 3 == 0, F.col("p_brand")).otherwise(""), items, vocal, arc, F.when(k % 5 != 0, size * 4), F.when(k % 4 != 0, "C minor"), F.when(k % 9 == 0, "lo-fi TAPE"))
    return p.select("p_partkey", caption.alias("caption"))


@query(f"WITH {NARRATIVE} SELECT p_partkey, caption FROM captions")
def narrative_captions(spark: SparkSession, d: str) -> DataFrame:
    return captions(spark, d)


@query(f"""WITH {NARRATIVE}, o AS (SELECT length(caption) AS l, row_number() OVER (ORDER BY length(caption), p_partkey) - 1 AS i, count(*) OVER () AS n FROM captions WHERE caption IS NOT NULL)
SELECT max(n) AS n, min(l)::INT AS shortest, (max(l) FILTER (i = n // 2))::INT AS median, max(l)::INT AS longest FROM o""")
def caption_lengths(spark: SparkSession, d: str) -> DataFrame:
    return reports.length_stats(captions(spark, d), F.length("caption"))


_GENRES = [*text.GENRE_INSTRUMENTS, "polka", ""]
_BANKS = "MAP {" + ", ".join("'" + g + "': [" + ", ".join("'" + i.replace("'", "''") + "'" for i in own) + "]" for g, own in text.GENRE_INSTRUMENTS.items()) + "}"


@query(f"""WITH c AS (SELECT p_partkey, {_GENRES!r}[p_partkey % {len(_GENRES)} + 1] AS genre, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS artist, {_BANKS} AS banks FROM part),
w AS (SELECT p_partkey, artist, coalesce(nullif(genre, ''), 'instrumental') AS g, coalesce(banks[coalesce(nullif(genre, ''), 'instrumental')], []) AS items, {_pick([*text.ENERGY_WORDS], "band")} AS band, {_pick(text.CATALOGUE_MOODS, "mood")} AS m, {_pick(text.NOUNS, "noun")} AS noun, {_pick(text.OPENERS, "opener")} AS opener, {_pick(text.LEADS, "lead")} AS lead, {_pick(text.CATALOGUE_SUPPORTS, "support")} AS support FROM c),
e AS (SELECT *, items[2:3] AS rest, CASE band {" ".join(f"WHEN '{b}' THEN {_pick(words, 'energy')}" for b, words in text.ENERGY_WORDS.items())} END AS energy FROM w)
SELECT p_partkey, {_FIXED.replace("{x}", f"concat_ws(' ', concat_ws(', ', replace(replace(replace(replace(opener, '{{energy}}', energy), '{{genre}}', g), '{{noun}}', noun), '{{mood}}', m), CASE WHEN len(items) > 0 THEN replace(lead, '{{lead}}', items[1]) END, CASE WHEN len(items) > 1 THEN replace(support, '{{rest}}', {_humanised('rest')}) END, 'performed by ' || artist) || '.', {_pick(text.CATALOGUE_ARCS, 'arc')}, {_pick(text.PRODUCTION, 'production')})")} AS caption FROM e""")
def catalogue_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions of parts taken for catalogue tracks of every genre, one unknown and none."""
    k = F.col("p_partkey")
    genre = F.element_at(F.array(*map(F.lit, _GENRES)), (k % len(_GENRES)).cast("int") + 1)
    return table(spark, d, "part").select("p_partkey", text.catalogue_caption(k, genre, F.when(k % 5 != 0, F.col("p_brand"))).alias("caption"))
