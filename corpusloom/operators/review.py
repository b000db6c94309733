"""Review sheets: from wide to long, completeness, rankings, and the one intervention they call for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions and areas: fixed values.
REQUIRED = ["overall_realism", "instrument_realism", "vocal_realism", "lyrics_intelligibility", "prompt_adherence", "structure_coherence", "spectral_clarity", "artifact_freedom"]
OPTIONAL = ["instrument_presence", "arrangement", "phrasing", "pitch_stability", "emotion"]
AREAS = {
    "A": ["instrument_realism", "instrument_presence", "arrangement"],
    "B": ["vocal_realism", "phrasing", "pitch_stability", "emotion"],
    "C": ["lyrics_intelligibility", "prompt_adherence", "structure_coherence"],
    "D": ["spectral_clarity"],
    "E": ["artifact_freedom", "overall_realism"],
}
TRACKS = {"B": ["vocal", "rich_mix"], "D": ["piano", "violin", "guitar"]}
CASES = {"A": "instrument_case", "B": "vocal_case", "C": "control_experiments", "D": "sparse_acoustic_case", "E": "inference_settings_sweep"}
WEAK, SEVERE, MIN_CELLS = 7.0, 4.0, 3
#: How far presence lies below realism where instruments are missing, and the share of words that a transcript recovers: fixed values.
PRESENCE_GAP, RECALLED = 1.5, 0.9


def long_sheet(sheet: DataFrame, track: str = "track", dimensions: list[str] | None = None, keep_cell: bool = False) -> DataFrame:
    """track, dimension, score, state (scored, na, missing, bad) and, if wanted, cell of a sheet of strings; a legend row is
    left out."""
    names = dimensions or [d for d in REQUIRED + OPTIONAL if d in sheet.columns]
    text = sheet.filter(~F.col(track).startswith("_")).select(track, *(F.trim(F.col(d).cast("string")).alias(d) for d in names))
    long = text.unpivot([track], names, "dimension", "cell")
    score = F.col("cell").try_cast("double")
    state = F.when(F.coalesce("cell", F.lit("")) == "", "missing").when(F.upper("cell") == "N/A", "na").when(score.between(1, 10), "scored").otherwise("bad")
    return long.select(track, "dimension", F.when(state == "scored", score).alias("score"), state.alias("state"), *(["cell"] if keep_cell else []))


def completeness(long: DataFrame) -> DataFrame:
    """One row: filled and expected required cells. N/A is an answer and isn't expected."""
    own = long.filter(F.col("dimension").isin(REQUIRED) & (F.col("state") != "na"))
    return own.agg(F.count("*").alias("expected"), F.coalesce(F.sum((F.col("state") == "scored").cast("long")), F.lit(0)).alias("filled"))


def missing_cells(long: DataFrame) -> DataFrame:
    """The required cells that are neither scored nor N/A."""
    return long.filter(F.col("dimension").isin(REQUIRED) & ~F.col("state").isin("na", "scored"))


def ranked_dimensions(long: DataFrame, track: str = "track") -> DataFrame:
    """Mean (2 digits), worst track and score of each dimension; worst first by (mean, worst_score)."""
    out = long.filter("state = 'scored'").groupBy("dimension").agg(F.round(F.avg("score"), 2).alias("mean"), F.min(F.struct("score", track)).alias("w"), F.count("*").alias("tracks_scored"))
    return out.select("dimension", "mean", F.col(f"w.{track}").alias("worst_track"), F.col("w.score").alias("worst_score"), "tracks_scored")


def ranked_areas(long: DataFrame, track: str = "track", tracks: dict[str, list[str]] = TRACKS) -> DataFrame:
    """Cells, mean and sufficiency of each weakness area, and its rank (insufficient areas last)."""
    spark = long.sparkSession
    table = spark.createDataFrame([(a, d, tracks.get(a)) for a, ds in AREAS.items() for d in ds], "area string, dimension string, only array<string>")
    cells = F.broadcast(table).join(long.filter("state = 'scored'"), "dimension", "left")  # the fixed areas
    hit = F.col("score").isNotNull() & (F.col("only").isNull() | F.array_contains("only", F.col(track).cast("string")))
    out = cells.groupBy("area").agg(F.sum(hit.cast("long")).alias("cells_scored"), F.round(F.avg(F.when(hit, F.col("score"))), 2).alias("mean"))
    out = out.withColumn("sufficient", F.col("cells_scored") >= MIN_CELLS)
    order = Window.orderBy(F.col("sufficient").desc(), F.coalesce("mean", F.lit(99.0)), "area")  # a row for each area
    return out.withColumn("rank", F.row_number().over(order))


def intervention(areas: DataFrame) -> DataFrame:
    """One row: what to do first. Any weakness of control comes first, since trying it costs least; else the worst area."""
    weak = areas.filter(F.col("sufficient") & (F.col("mean") < WEAK))
    one = weak.agg(F.min(F.struct("mean", "area")).alias("worst"), F.coalesce(F.bool_or(F.col("area") == "C"), F.lit(False)).alias("control"))
    case = F.coalesce(*(F.when(F.col("worst.area") == a, c) for a, c in CASES.items()))
    return one.select(F.when(F.col("worst").isNull(), "none").when(F.col("control"), CASES["C"]).otherwise(case).alias("intervention"), F.col("worst.area").alias("worst_area"), F.col("worst.mean").alias("worst_mean"))


def attributed(areas: DataFrame, long: DataFrame | None = None, objective: DataFrame | None = None, track: str = "track", sparse: list[str] = TRACKS["D"]) -> DataFrame:
    """area, bucket and, if cells are given, note: the likely cause of each area's mean. long: the sheet's cells, which tell missing
    instruments from poor ones and muffled dense mixes from sparse ones; objective: track, lyric_recall and flags (array), which tell
    words that are there but unclear, and corroborate a band limit."""
    weak = F.col("sufficient") & (F.col("mean") < WEAK)
    bucket = (
        F.when(~F.col("sufficient"), "insufficient evidence")
        .when(F.col("mean") >= WEAK, "not a weakness")
        .when((F.col("area") == "B") & (F.col("mean") < SEVERE), "pretrained-model limitation (suspected)")
        .when(F.col("area").isin("C", "E"), "prompt/control-layer problem")
    )
    if long is None:
        return areas.select("area", bucket.otherwise("adapter-addressable").alias("bucket"))
    scored = long.filter("state = 'scored'")
    of = lambda d, *more: F.when(F.col("dimension").isin(d), F.col("score")) if not more else F.when(F.col("dimension").isin(d) & more[0], F.col("score"))
    facts = scored.agg(
        (F.avg(of("instrument_realism")) - F.avg(of("instrument_presence"))).alias("gap"), F.min(of("lyrics_intelligibility")).alias("unclear"),
        F.avg(of("spectral_clarity", ~F.col(track).isin(sparse))).alias("dense"),
    )
    measured = objective if objective is not None else scored.sparkSession.createDataFrame([], "lyric_recall double, flags array<string>")
    flag = F.exists(F.coalesce("flags", F.array().cast("array<string>")), lambda f: f.contains("rolloff") | f.contains("band"))
    facts = facts.crossJoin(measured.agg(F.min("lyric_recall").alias("recall"), F.coalesce(F.bool_or(flag), F.lit(False)).alias("rolloff")))  # one row each
    cause = bucket.when((F.col("area") == "A") & (F.col("gap") > PRESENCE_GAP), "prompt/control-layer problem").when((F.col("area") == "D") & (F.col("dense") < WEAK), "pretrained-model limitation (suspected)").otherwise("adapter-addressable")
    note = (
        F.when(weak & (F.col("area") == "A") & (F.col("gap") > PRESENCE_GAP), "requested instruments are missing")
        .when(weak & (F.col("area") == "C") & (F.col("unclear") < WEAK) & (F.col("recall") >= RECALLED), "words are there, but unclear")
        .when(weak & (F.col("area") == "D") & (F.col("dense") < WEAK), "dense mixes are muffled too")
        .when(weak & (F.col("area") == "D") & F.col("rolloff"), "corroborated by measured rolloff")
    )
    return areas.crossJoin(facts).select("area", cause.alias("bucket"), note.alias("note"))  # a row for each area
