"""Queries over prompts, lyrics and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins
from ..streaming import jobs
from .base import query, table

#: What documents are followed by to make prompts of them, each dealt by another of their numbers: fixed values.
SAID = {
    "key": ["in c# minor", "in a major", "in g# min", "in bb maj", "in h minor"],
    "plan": ["intro then verse", "final chorus, outro", "drop and bridge", "pre-chorus, solo, finale", "slow start", "builds up to a huge chorus", "fades out"],
    "voice": ["", "female breathy vocal", "no vocals", "male soulful singer", "sung in korean", "instrumental", "french choir"],
}


def _dealt(words: list[str], by: int):
    return F.element_at(F.array(*map(F.lit, words)), (F.floor(F.col("n_chars") / by) % len(words)).cast("int") + 1)


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """A prompt of each document's whole text and numbers."""
    n = F.col("n_chars")
    parts = [F.coalesce("text", F.lit("")), _dealt(text.MOODS, 1), _dealt(text.GENRES, 3), F.lit("with"), _dealt(text.MODIFIERS, 5), F.concat(_dealt(text.INSTRUMENTS, 7), F.lit("s")), F.lit("and"), _dealt(text.INSTRUMENTS, 11), F.lit("at"), (n % 420).cast("string"), F.lit("bpm"), _dealt(SAID["key"], 2), (n % 700).cast("string"), F.lit("seconds"), _dealt(SAID["plan"], 13), _dealt(SAID["voice"], 17)]
    return table(spark, d, "documents").select("doc_id", "n_chars", F.concat_ws(" ", *parts).alias("prompt"))


def _dealt_sql(words: list[str], by: int) -> str:
    return f"{words!r}[(n_chars // {by}) % {len(words)} + 1]".replace('"', "'")


#: The prompts in lower case; letters beyond ASCII are letters for the boundaries of words, too.
PROMPT_SQL = f"""p AS (SELECT doc_id, n_chars, raw, regexp_replace(lower(raw), '[À-ÖØ-öø-ɏ]', 'q', 'g') AS t FROM (SELECT doc_id, n_chars, concat_ws(' ', coalesce(text, ''), {_dealt_sql(text.MOODS, 1)}, {_dealt_sql(text.GENRES, 3)}, 'with', {_dealt_sql(text.MODIFIERS, 5)},
 {_dealt_sql(text.INSTRUMENTS, 7)} || 's', 'and', {_dealt_sql(text.INSTRUMENTS, 11)}, 'at', n_chars % 420, 'bpm', {_dealt_sql(SAID["key"], 2)}, n_chars % 700, 'seconds', {_dealt_sql(SAID["plan"], 13)}, {_dealt_sql(SAID["voice"], 17)}) AS raw FROM documents))"""
_KEY_SQL, _TIME_SQL = r"\bin\s+([a-g][#b]?)\s*(major|minor|min|maj)\b", r"\b(\d+(?:\.\d+)?)\s*(seconds?|secs?|minutes?|mins?)\b"
CONTROLS_SQL = f"""{PROMPT_SQL}, x AS (SELECT doc_id, t, TRY_CAST(regexp_extract(t, '\\b(\\d{{2,3}})\\s*bpm\\b', 1) AS INT) AS b, regexp_extract(t, '{_KEY_SQL}', 1) AS k, regexp_extract(t, '{_KEY_SQL}', 2) AS q,
 TRY_CAST(regexp_extract(t, '{_TIME_SQL}', 1) AS DOUBLE) * CASE WHEN regexp_extract(t, '{_TIME_SQL}', 2) LIKE 'min%' THEN 60 ELSE 1 END AS s FROM p),
controls AS (SELECT doc_id, t, CASE WHEN b BETWEEN 20 AND 300 THEN b END AS bpm, CASE WHEN q <> '' THEN upper(k) || ' ' || CASE WHEN q LIKE 'maj%' THEN 'major' ELSE 'minor' END END AS key, CASE WHEN s BETWEEN 10 AND 600 THEN s END::DOUBLE AS said FROM x)"""


@query(f"WITH {CONTROLS_SQL} SELECT doc_id, bpm, key, coalesce(said, 60.0)::DOUBLE AS duration_seconds FROM controls")
def prompt_controls(spark: SparkSession, d: str) -> DataFrame:
    return text.annotated(prompts(spark, d), with_instruments=False).select("doc_id", "bpm", "key", "duration_seconds")


_WORDS = lambda name, words: f"list_filter([{', '.join(repr(w) for w in words)}], lambda w: regexp_matches(t, '\\b' || regexp_escape(w) || '\\b')) AS {name}"
VOCAL_SQL = rf"""v AS (SELECT doc_id, t, {_WORDS("g", text.GENRES)}, {_WORDS("m", text.MOODS)}, regexp_matches(t, '\binstrumental\b|\bno vocals?\b') AS none,
 CASE WHEN regexp_matches(t, '\b(female|woman|girl)\b') THEN 'female' WHEN regexp_matches(t, '\b(male|man|boy)\b') THEN 'male' END AS gender,
 list_filter({text.VOICES!r}, lambda w: regexp_matches(t, '\b' || w || '\b(?:\s+\w+){{0,2}}\s+(voice|vocal|singing|singer)'))[1] AS style,
 list_filter([{", ".join(f"{{'n': '{n}', 'c': '{c}'}}" for n, c in text.LANGUAGES.items())}], lambda w: regexp_matches(t, '\b' || w.n || '\b'))[1].c AS language, regexp_matches(t, '\bvocal|voice|singer|singing|sung|choir\b') AS said FROM p),
w AS (SELECT doc_id, list_filter(g, lambda a: len(list_filter(g, lambda o: o <> a AND contains(o, a))) = 0) AS genre, m AS mood, CASE WHEN none THEN FALSE WHEN said OR gender IS NOT NULL OR language IS NOT NULL THEN TRUE END AS present,
 CASE WHEN NOT none THEN gender END AS gender, CASE WHEN NOT none AND (said OR gender IS NOT NULL OR language IS NOT NULL) THEN style END AS style, CASE WHEN NOT none THEN language END AS language FROM v)"""


@query(f"WITH {PROMPT_SQL}, {VOCAL_SQL} SELECT doc_id, array_to_string(genre, ',') AS genre, array_to_string(mood, ',') AS mood, present::VARCHAR AS present, gender, style, language FROM w")
def prompt_annotation(spark: SparkSession, d: str) -> DataFrame:
    a = text.annotated(prompts(spark, d), with_instruments=False)
    return a.select("doc_id", F.array_join("genre", ",").alias("genre"), F.array_join("mood", ",").alias("mood"), F.col("vocal.present").cast("string").alias("present"), "vocal.gender", "vocal.style", "vocal.language")


_RANKED = sorted(text.INSTRUMENTS, key=len, reverse=True)
_MODS = "|".join(text.MODIFIERS)
PLAN_SQL = rf"""i AS (SELECT doc_id, list_distinct([]::VARCHAR[]) AS x, list_filter(list_transform({_RANKED!r}, lambda w: regexp_replace(trim(regexp_extract(t, '((?:\b(?:{_MODS})\s+)*\b' || w || 's?\b)', 1)), '\s+', ' ', 'g')), lambda f: f <> '') AS found FROM p),
s AS (SELECT doc_id, list_transform(list_sort(list_filter([{", ".join(f"{{'at': CASE WHEN regexp_matches(t, '{r}') THEN length(regexp_extract(t, '(?s)^(.*?)(?:{r})', 1)) ELSE -1 END, 'i': {i}, 'kind': '{k}'}}" for i, (k, r) in enumerate(text.SECTIONS.items()))}], lambda x: x.at >= 0)), lambda x: x.kind) AS structure,
 list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '{r}') THEN '{k}' END" for k, r in text.ENERGY.items())}], lambda x: x IS NOT NULL) AS energy FROM p)"""


@query(rf"""WITH {CONTROLS_SQL}, {VOCAL_SQL}, {PLAN_SQL} SELECT doc_id, array_to_string(found, ',') AS instruments, array_to_string(structure, ',') AS structure, array_to_string(energy, ',') AS energy,
 array_to_string(list_filter([CASE WHEN bpm IS NOT NULL THEN 'bpm=' || regexp_extract(c.t, '\b(\d{{2,3}})\s*bpm\b') END, CASE WHEN said IS NOT NULL THEN 'duration=' || regexp_extract(c.t, '{_TIME_SQL}') END, CASE WHEN len(energy) > 0 THEN 'energy=' || array_to_string(energy, '+') END, CASE WHEN len(genre) > 0 THEN 'genre=' || array_to_string(genre, '+') END,
 CASE WHEN len(found) > 0 THEN 'instruments=' || array_to_string(found, '+') END, CASE WHEN key IS NOT NULL THEN 'key=' || regexp_extract(c.t, '{_KEY_SQL}') END, CASE WHEN len(mood) > 0 THEN 'mood=' || array_to_string(mood, '+') END, CASE WHEN len(structure) > 0 THEN 'structure=' || array_to_string(structure, '+') END,
 CASE WHEN NOT present THEN 'vocal=instrumental/no vocals' WHEN present THEN 'vocal=' || coalesce(nullif(concat_ws('+', gender, style, language), ''), 'vocal mention') END], lambda x: x IS NOT NULL), ';') AS evidence
FROM controls c JOIN w USING (doc_id) JOIN i USING (doc_id) JOIN s USING (doc_id)""")
def prompt_plan(spark: SparkSession, d: str) -> DataFrame:
    """Instruments, structure and energy of every prompt, and the evidence for every control."""
    a = text.annotated(prompts(spark, d))
    found = F.array_sort(F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))))
    return a.select("doc_id", F.array_join("instruments", ",").alias("instruments"), F.array_join("structure", ",").alias("structure"), F.array_join("energy", ",").alias("energy"), F.array_join(found, ";").alias("evidence"))


CAPABILITIES = [(m, c, "native" if (i + k) % 3 == 0 else "prompt" if (i + k) % 3 == 1 else "ignored") for k, m in enumerate(("alpha", "beta")) for i, c in enumerate(text.CONTROLS)]
_IGNORED = {m: [c for n, c, s in CAPABILITIES if n == m and s == "ignored"] for m in ("alpha", "beta")}


@query(f"""WITH {CONTROLS_SQL}, {VOCAL_SQL}, {PLAN_SQL}, r AS (SELECT doc_id, coalesce(said, 60.0) AS seconds, present, language, list_sort(list_filter(['prompt', 'seed', 'duration', CASE WHEN bpm IS NOT NULL THEN 'bpm' END, CASE WHEN key IS NOT NULL THEN 'key' END, CASE WHEN len(genre) > 0 THEN 'genre' END, CASE WHEN len(mood) > 0 THEN 'mood' END,
 CASE WHEN len(structure) > 0 THEN 'structure' END, CASE WHEN present IS NOT NULL THEN 'vocal_style' END], lambda c: c IS NOT NULL)) AS controls FROM controls JOIN w USING (doc_id) JOIN s USING (doc_id)),
m AS (SELECT 'alpha' AS model, {_IGNORED["alpha"]} AS ignored, TRUE AS sings, 240 AS most, ['en', 'ko'] AS languages UNION ALL SELECT 'beta', {_IGNORED["beta"]}, FALSE, 500, [])
SELECT doc_id, model, len(controls)::INT AS n_applied, array_to_string(list_transform(list_filter(controls, lambda c: list_contains(ignored, c)), lambda c: c || ': not supported') || list_filter([CASE WHEN coalesce(present, FALSE) AND NOT sings THEN 'vocals: not supported' END, CASE WHEN seconds > most THEN 'duration: too long' END,
 CASE WHEN language IS NOT NULL AND len(languages) > 0 AND NOT list_contains(languages, language) THEN 'language: not supported' END], lambda x: x IS NOT NULL), ';') AS warnings FROM r, m""")
def control_resolution(spark: SparkSession, d: str) -> DataFrame:
    a = text.annotated(prompts(spark, d), with_instruments=False)
    none = F.array().cast("array<string>")
    controls = text.requested(F.lit(None), F.col("genre"), F.col("mood"), none, F.col("vocal"), F.col("bpm"), F.col("key"), F.col("structure"))
    requests = a.select(F.col("doc_id").alias("request_id"), controls.alias("controls"), F.coalesce("vocal.present", F.lit(False)).alias("wants_vocals"), "duration_seconds", "vocal.language")
    limits = spark.createDataFrame([("alpha", True, 240.0, ["en", "ko"]), ("beta", False, 500.0, [])], "model string, sings boolean, max_seconds double, languages array<string>")
    out = joins.resolved_controls(requests, spark.createDataFrame(CAPABILITIES, "model string, control string, support string"), limits)
    return out.select(F.col("request_id").alias("doc_id"), "model", F.size("applied").alias("n_applied"), F.array_join("warnings", ";").alias("warnings"))


@query("""SELECT doc_id, CASE WHEN trim(coalesce(regexp_replace(text, '\\s+', '', 'g'), '')) = '' THEN 'prompt must not be empty' WHEN n_chars % 1000 = 0 THEN 'duration must be positive' WHEN n_chars % 331 < 20 OR n_chars % 331 > 300 THEN 'bpm outside 20-300'
 WHEN lower(source) NOT IN ('intro', 'verse') AND n_chars % 3 = 0 THEN 'unknown section kind ' || source END AS problem FROM documents""")
def request_problems(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose prompt is a whole text, and whose sections are named by its source."""
    n = F.col("n_chars")
    sections = F.array(F.lit("intro"), F.when(n % 3 == 0, F.col("source")).otherwise("verse"))
    return table(spark, d, "documents").select("doc_id", text.request_problem(F.col("text"), (n % 1000).cast("double"), n % 331, sections).alias("problem"))


@query(r"""WITH s AS (SELECT doc_id, string_split('[Oddity]' || chr(10) || 'lost' || chr(10) || '[Verse]' || chr(10) || text || chr(10) || '[Chorus]' || chr(10) || 'la la', chr(10)) AS a FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM s),
t AS (SELECT *, regexp_replace(lower(trim(regexp_extract(line, '^\s*\[([^\]]+)\]\s*$', 1))), '[ -]', '_', 'g') AS tag FROM l),
k AS (SELECT *, CASE WHEN tag IN ('intro', 'verse', 'pre_chorus', 'chorus', 'bridge', 'outro') THEN tag END AS kind FROM t),
r AS (SELECT *, count(kind) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS section FROM k)
SELECT doc_id, section::INT AS section, max(kind) AS kind, nullif(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (kind IS NULL), ''), '^\s+|\s+$', '', 'g'), '') AS lyrics FROM r WHERE section >= 0 GROUP BY ALL""")
def lyric_sections(spark: SparkSession, d: str) -> DataFrame:
    """Lyrics made of each document's whole text: an unknown tag and text in front, a verse and a chorus."""
    docs = table(spark, d, "documents")
    song = F.concat(F.lit("[Oddity]\nlost\n[Verse]\n"), "text", F.lit("\n[Chorus]\nla la"))
    return text.lyric_sections(docs.select("doc_id", song.alias("lyrics")), "doc_id", "lyrics", ["intro", "verse", "pre_chorus", "chorus", "bridge", "outro"])


@query(r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9'']+'), lambda x: x <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(a.w, coalesce(b.w, [])))::DOUBLE / len(a.w), 6) AS recall FROM w a LEFT JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE len(a.w) > 0""")
def lyric_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many words of a turn the next one repeats."""
    c = table(spark, d, "conversations")
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("heard"))
    return c.join(later, ["conv_id", "turn"], "left").select("conv_id", "turn", F.round(text.recall(F.col("text"), F.col("heard")), 6).alias("recall")).filter("recall is not null")


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    line = F.concat(F.lit("Epoch: "), (F.col("event_id") % 9).cast("string"), F.lit(" step="), F.col("event_id").cast("string"), F.lit(" loss "), F.col("value").cast("string"), F.when(F.col("event_type") == "error", " ERROR in worker").otherwise(""))
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), line.alias("line"))


@query("SELECT event_id AS line_no, event_id AS step, event_id % 9 AS epoch, value AS loss, event_type = 'error' AS is_error FROM events")
def log_parse(spark: SparkSession, d: str) -> DataFrame:
    return text.parsed_log(log_lines(spark, d)).select("line_no", "step", "epoch", "loss", "is_error")


MONITOR = """WITH e AS (SELECT user_id AS run_id, event_id, value, event_type = 'error' AS bad, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS alive, 'Epoch: ' || event_id % 9 || ' step=' || event_id || ' loss ' || value || CASE WHEN event_type = 'error' THEN ' ERROR in worker' ELSE '' END AS line FROM events),
s AS (SELECT run_id, max(event_id) AS step, arg_max(value, event_id) AS loss, max(value) AS peak_loss, count(*) FILTER (bad) AS n_errors, arg_max(alive, event_id) FILTER (alive IS NOT NULL) AS alive FROM e GROUP BY 1)"""


@query(MONITOR + " SELECT run_id, step, loss, peak_loss, n_errors, CASE WHEN coalesce(alive, FALSE) THEN 'training' WHEN n_errors > 0 THEN 'failed' ELSE 'stopped' END AS stage FROM s")
def training_monitor(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("line_no")
    beats = log_lines(spark, d).withColumn("alive", F.when(i % 3 == 0, i % 2 == 0))
    return jobs.monitor(beats, "alive").select("run_id", "step", "loss", "peak_loss", "n_errors", "stage")


@query(MONITOR + ", r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id DESC) AS n FROM e WHERE bad) SELECT run_id, string_agg(regexp_extract(line, 'step=[0-9]+'), ';' ORDER BY event_id) AS errors FROM r WHERE n <= 3 GROUP BY 1")
def last_errors(spark: SparkSession, d: str) -> DataFrame:
    """The steps of each run's last three error lines."""
    found = jobs.last_errors(log_lines(spark, d))
    return found.select("run_id", F.array_join(F.transform("errors", lambda x: F.regexp_extract(x, "step=[0-9]+", 0)), ";").alias("errors"))


@query("""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type AS status, count(*) AS n FROM events GROUP BY ALL""")
def queue_depth(spark: SparkSession, d: str) -> DataFrame:
    """The stream's aggregation, over the whole table."""
    return jobs.queue_depth(table(spark, d, "events").withColumnRenamed("event_type", "status"))


@query(rf"""WITH {PROMPT_SQL}, {VOCAL_SQL} SELECT doc_id, concat_ws('. ', regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '\.+$', ''), CASE WHEN len(genre) > 0 THEN 'genre: ' || array_to_string(genre, ', ') END, CASE WHEN len(mood) > 0 THEN 'mood: ' || array_to_string(mood, ', ') END,
 CASE WHEN present THEN coalesce(nullif(concat_ws(' ', gender, style), '') || ' vocal', 'with vocals') WHEN NOT present THEN 'instrumental, no vocals' END) AS prompt FROM p JOIN w USING (doc_id)""")
def composed_prompts(spark: SparkSession, d: str) -> DataFrame:
    a = text.annotated(prompts(spark, d), with_instruments=False)
    return a.select("doc_id", text.composed_prompt(F.col("prompt"), F.col("genre"), F.col("mood"), None, F.col("vocal")).alias("prompt"))


_SECTION_SQL = "[" + ", ".join(f"'{k}'" for k in ("intro", "pre_chorus", "verse", "outro")) + "]"


@query(rf"""SELECT doc_id, sung, CASE WHEN sung AND coalesce(text, '') <> '' THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN n_chars % 5 = 0 THEN '' ELSE array_to_string(list_transform({_SECTION_SQL}[: n_chars % 4 + 1], lambda k: '[' || replace(k, '_', ' ') || ']'), chr(10)) END AS lyrics FROM documents, (VALUES (TRUE), (FALSE)) AS v(sung)""")
def composed_lyrics(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a song with its whole text for lyrics, and as one without, which gets tags of a structure."""
    n = F.col("n_chars")
    kinds = F.when(n % 5 != 0, F.slice(F.array(*map(F.lit, ("intro", "pre_chorus", "verse", "outro"))), F.lit(1), (n % 4 + 1).cast("int")))
    songs = table(spark, d, "documents").withColumn("sung", F.explode(F.array(F.lit(True), F.lit(False))))
    return songs.select("doc_id", "sung", text.composed_lyrics(F.when(F.col("sung"), F.col("text")), kinds).alias("lyrics"))


_KIT_IDS = {part: [*bank, "unheard"] for part, bank in text.KIT.items()}
_KIT_BY = {"genres": 3, "moods": 4, "instruments": 5}


def _kit_sql(part: str) -> str:
    bank = "MAP {" + ", ".join(f"'{i}': '{p}'" for i, p in text.KIT[part].items()) + "}"
    ids = f"list_distinct([]::VARCHAR[]) || {_KIT_IDS[part]!r}[1 : n_chars % {_KIT_BY[part]}] || CASE WHEN n_chars % 7 = 0 THEN ['unheard'] ELSE [] END" if part in _KIT_BY else f"{_KIT_IDS[part]!r}[n_chars // 2 % {len(_KIT_IDS[part])} + 1]"
    return f"{ids} AS {part}, {bank} AS {part}_bank"


@query(rf"""WITH c AS (SELECT doc_id, written, CASE WHEN written THEN regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') ELSE '' END AS free, {", ".join(map(_kit_sql, text.KIT))} FROM documents, (VALUES (TRUE), (FALSE)) AS v(written)),
s AS (SELECT doc_id, written, free, vocal, structure, len(genres) AS g, len(moods) AS m, len(instruments) AS i, {", ".join(f"list_filter(list_transform({p}, lambda x: {p}_bank[x]), lambda x: x IS NOT NULL) AS {p}" for p in _KIT_BY)}, nullif(vocal_bank[vocal], '') AS v, nullif(structure_bank[structure], '') AS t FROM c)
SELECT doc_id, written, concat_ws(', ', nullif(free, ''), nullif(array_to_string(genres, ' and '), ''), nullif(array_to_string(moods, ', '), ''), nullif(array_to_string(instruments, ', '), ''), coalesce(v, CASE WHEN vocal = 'none' AND free = '' THEN 'instrumental' END), t) AS prompt,
 least(100, floor((CASE WHEN free <> '' THEN 2 ELSE 0 END + least(g, 2) + least(m, 2) + least(i, 3) + (vocal <> 'none')::INT + (structure <> 'none')::INT) / 9.0::DOUBLE * 100 + 0.5))::INT AS richness FROM s""")
def kit_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Choices of the prompt kit by a document's numbers, once behind its whole text and once alone."""
    n = F.col("n_chars")
    ids = lambda part: F.array(*map(F.lit, _KIT_IDS[part]))
    several = {part: F.concat(F.slice(ids(part), F.lit(1), (n % by).cast("int")), F.when(n % 7 == 0, F.array(F.lit("unheard"))).otherwise(F.array().cast("array<string>"))) for part, by in _KIT_BY.items()}
    one = {part: F.element_at(ids(part), (F.floor(n / 2) % len(_KIT_IDS[part])).cast("int") + 1) for part in ("vocal", "structure")}
    chosen = [F.when(F.col("written"), F.coalesce("text", F.lit(""))).otherwise(""), *several.values(), *one.values()]
    return table(spark, d, "documents").withColumn("written", F.explode(F.array(F.lit(True), F.lit(False)))).select("doc_id", "written", text.kit_prompt(*chosen).alias("prompt"), text.richness(*chosen).alias("richness"))
