"""Distinct counts by bitmaps: merges of days, groups and their unions, against sets."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import distincts, reports, splits


def test_two_days_equal_one_pass(spark):
    rng = random.Random(1)
    day = lambda: [(rng.choice(["a", "b", None]), None if rng.random() < 0.1 else f"v{rng.randrange(3_000)}") for _ in range(4_000)]
    one, two = day(), day()
    frame = lambda rows: spark.createDataFrame(rows, "g string, v string")
    numbers = distincts.numbered_values(frame(one), "v")
    later = distincts.numbered_values(frame(two), "v", numbers)
    ids = [r["number"] for r in later.collect()]
    assert sorted(ids) == list(range(len({v for _, v in one + two if v}))) and {tuple(r) for r in numbers.collect()} <= {tuple(r) for r in later.collect()}
    both = distincts.merged([distincts.bitmaps(frame(one), ["g"], "v", numbers), distincts.bitmaps(frame(two), ["g"], "v", later)], ["g"])
    want = {g: len({v for h, v in one + two if h == g and v}) for g in ("a", "b", None)}
    assert {r["g"]: r["n"] for r in distincts.counted(both, ["g"], "n").collect()} == want
    assert distincts.counted(both, [], "n").first()["n"] == len({v for _, v in one + two if v})


def test_many_values_and_none(spark):
    rows = spark.range(70_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    sets = distincts.bitmaps(rows, ["g"], "v")
    assert {r["n"] for r in distincts.counted(sets, ["g"], "n").collect()} == {35_000} and distincts.counted(sets, [], "n").first()["n"] == 70_000
    none = rows.filter("false")
    assert distincts.counted(distincts.bitmaps(none, ["g"], "v"), [], "n").first()["n"] == 0


def test_reports_without_an_expand(spark):
    rows = spark.range(100).select(F.when(F.col("id") % 3 > 0, "train").alias("split"), (F.col("id") % 10).cast("string").alias("track_id"), F.when(F.col("id") % 2 == 0, "s").alias("singer_id"), F.lit("x").alias("source"), F.lit("y").alias("license"), F.lit(1.5).alias("duration_seconds"), (F.col("id") < 3).alias("silent"))
    for frame in (reports.manifest_summary(rows), splits.report(rows, F.col("track_id"))):
        assert "Expand" not in frame._jdf.queryExecution().executedPlan().toString()
    got = {(r["split"], r["segments"], r["tracks"], r["singers"]) for r in reports.manifest_summary(rows).collect()}
    assert got == {("train", 66, 10, 1), (None, 34, 10, 1), (None, 100, 10, 1)}
    assert reports.manifest_summary(rows.filter("false")).count() == 0
