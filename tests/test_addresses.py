"""Row addresses: of equal rows exactly one is chosen, and no wide row is shuffled."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import addresses, dedup
from corpusloom.operators.settled import settled


def test_of_equal_rows_one_is_kept(spark):
    rows = spark.createDataFrame([("a", 1)] * 5 + [("b", 2), ("b", 1), ("b", 1), ("", 1), (None, 1), (None, 1)], "h string, n int")
    for frame in (rows, settled(rows), settled(rows.repartition(3))):
        kept = [(r["h"], r["n"]) for r in dedup.keep_first(frame, "h", ["n"]).filter("kept").collect()]
        assert sorted(map(str, kept)) == sorted(map(str, [("a", 1), ("b", 1), ("", 1), (None, 1), (None, 1)]))
    by_column = dedup.keep_first(rows, "h", [F.col("n") * -1]).filter("kept AND h = 'b'").collect()
    assert [(r["h"], r["n"]) for r in by_column] == [("b", 2)]


def test_awkward_columns(spark):
    """Maps, structs, names with dots and names like the operator's own."""
    frame = spark.range(20).select(F.concat(F.lit("h"), F.col("id") % 3).alias("h"), F.lit(1).alias("n"), F.create_map(F.lit("k"), "id").alias("file"), F.struct(F.lit(1).alias("x")).alias("place"), F.lit(2).alias("dotted.name"), F.lit("r").alias("row"), F.lit(0).alias("_metadata"))
    found = dedup.keep_first(frame, "h", ["n"])
    assert found.columns == [*frame.columns, "kept"] and found.count() == 20 and found.filter("kept").count() == 3
    assert dedup.keep_first(frame.filter("false"), "h", ["n"]).count() == 0


def test_beyond_the_bound(spark):
    """With bitmaps that don't fit at once, files go in groups, with the same rows."""
    rows = addresses.addressed(settled(spark.range(3_000).repartition(5)))
    rejected = rows.filter("row.id % 7 < 3").select("file", "place")
    want = [r[0] for r in spark.range(3_000).filter("id % 7 >= 3").collect()]
    for bound in (1_000_000, 10):
        found = addresses.flagged(rows, rejected, bound)
        assert found.count() == 3_000 and sorted(r[0] for r in found.filter("kept").select("row.id").collect()) == want


def test_far_places(spark):
    """Rows beyond the first bucket of a file."""
    rows = addresses.addressed(settled(spark.range(100_000).coalesce(1)))
    found = addresses.flagged(rows, rows.filter("place IN (0, 63, 64, 32767, 32768, 99999)").select("file", "place"))
    assert sorted(r[0] for r in found.filter("NOT kept").select("place").collect()) == [0, 63, 64, 32767, 32768, 99999]


def test_unique_paths_of_several_manifests(spark):
    a = spark.createDataFrame([("p", 1), ("p", 1), ("q", 1), (None, 1)], "path string, x int")
    b = spark.createDataFrame([("q", 2), ("r", 2), (None, 2)], "path string, y int")
    got = sorted(map(str, (tuple(r) for r in dedup.unique_by_path([a, b]).collect())))
    assert got == sorted(map(str, [("p", 1, None), ("q", 1, None), (None, 1, None), ("r", None, 2)]))


def test_no_text_is_shuffled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = dedup.keep_first(docs.withColumn("h", F.sha2("text", 256)), "h", ["doc_id"])
    out = io.StringIO()
    with redirect_stdout(out):
        found.explain("formatted")
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", out.getvalue())
    assert all("text" not in x and "row" not in x for x in exchanges)


@pytest.mark.parametrize("hot", [0.4, 0.0])
def test_hot_hashes(spark, hot):
    frame = spark.range(5_000).select((F.when(F.col("id") < 5_000 * hot, "hot").otherwise((F.col("id") % 900).cast("string"))).alias("h"), (F.col("id") % 2).alias("n"))
    kept = dedup.keep_first(frame, "h", ["n"]).filter("kept")
    assert kept.count() == kept.select("h").distinct().count() == frame.select("h").distinct().count()
