"""Reports that join others, attribution with measured flags, given splits, nested report rows."""

import hashlib

from pyspark.sql import functions as F

from corpusloom.operators import experiments, reports, review, select, splits
from corpusloom.sources import manifest


def cells(spark, scores):
    return spark.createDataFrame([(t, d, float(s), "scored") for t, d, s in scores], "track string, dimension string, score double, state string")


def test_attribution_uses_cells_and_flags(spark):
    areas = spark.createDataFrame([(a, True, 5.0) for a in "ABCDE"], "area string, sufficient boolean, mean double")
    low = cells(spark, [("piano", "instrument_realism", 8), ("piano", "instrument_presence", 4), ("x", "lyrics_intelligibility", 5), ("x", "spectral_clarity", 8), ("piano", "spectral_clarity", 3)])
    objective = spark.createDataFrame([("x", 0.95, ["95% rolloff low"]), ("y", None, None)], "track string, lyric_recall double, flags array<string>")
    got = {r["area"]: (r["bucket"], r["note"]) for r in review.attributed(areas, low, objective).collect()}
    assert got["A"] == ("prompt/control-layer problem", "requested instruments are missing")
    assert got["B"] == ("adapter-addressable", None)
    assert got["C"] == ("prompt/control-layer problem", "words are there, but unclear")
    assert got["D"] == ("adapter-addressable", "corroborated by measured rolloff") and got["E"][0] == "prompt/control-layer problem"
    dense = cells(spark, [("x", "spectral_clarity", 4), ("piano", "spectral_clarity", 3)])
    plain = {r["area"]: (r["bucket"], r["note"]) for r in review.attributed(areas, dense).collect()}
    assert plain["D"] == ("pretrained-model limitation (suspected)", "dense mixes are muffled too") and plain["A"] == ("adapter-addressable", None) and plain["C"][1] is None
    assert {r["area"]: r["bucket"] for r in review.attributed(areas).collect()}["D"] == "adapter-addressable"


def test_probe_fingerprint_in_order_of_paths(spark):
    rows = spark.createDataFrame([("a", "z/1"), ("b", "a/2"), ("c", "m/3")], "id string, path string")
    want = hashlib.sha256("\x1f".join("bca").encode()).hexdigest()
    assert select.probe_fingerprint(rows, "id", "path", 16).first()[0] == want[:16]


def test_probe_of_other_items_is_not_alike(spark):
    rows = spark.createDataFrame([("r", p, i, 1.0 * (i + (p == "after")), 2.0) for p in ("before", "after") for i in range(4)] + [("s", "before", 1, 1.0, 1.0), ("s", "after", 2, 1.0, 1.0), ("t", "before", 1, 1.0, 1.0)], "run string, phase string, item int, a double, b double")
    got = {(r["run"], r["metric"]): r for r in experiments.probe_means(rows, "run", "phase", "item", ["a", "b"], ["a", "b"]).collect()}
    assert got["r", "a"]["delta"] == 1.0 and got["r", "recon_loss"]["before"] == 3.5 and got["r", "a"]["same_items"] and got["r", "a"]["n_items"] == 4
    assert not got["s", "a"]["same_items"] and not got["t", "a"]["same_items"] and got["t", "a"]["after"] is None


def test_preserved_splits(spark):
    rows = spark.createDataFrame([(1, "g", "train"), (2, "g", None), (3, "h", "dev"), (4, "i", "val"), (5, "i", "test"), (6, "j", None), (7, None, None)], "n int, g string, split string")
    kept, problems = splits.preserved(rows, "split", "g")
    got = {r["n"]: r["split"] for r in kept.collect()}
    assert (got[1], got[2], got[3], got[4], got[5]) == ("train", "train", "dev", "val", "test") and {got[6], got[7]} <= set(splits.RATIOS)
    assert sorted(tuple(r) for r in problems.collect()) == [("h", "unknown split: dev"), ("i", "in several splits: test,val")]


def test_nested_report_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([("rock", 60.0, None, True), ("rock", 30.0, 256_000, False), (" ", 90.0, 0, False)], "genre_top string, duration_seconds double, bit_rate int, needs_license_reverify boolean")
    report = reports.selection_report(rows, {"short": 2}, {"licences": "CC0"})
    manifest.write_report(report, str(tmp_path / "r"))
    back = manifest.read_report(spark, str(tmp_path / "r"), report._jdf.schema().toDDL())
    assert back.collect() == report.collect()
    r = report.first()
    assert (r["selected"], r["needing_reverify"], [tuple(x) for x in r["per_genre"]], r["rejected"], r["criteria"]) == (3, 1, [("rock", 2), ("(untagged)", 1)], {"short": 2}, {"licences": "CC0"})
    assert reports.selection_report(rows.filter("false"), {}, {}).first()["selected"] == 0
