"""Streams against their batch forms: shuffled, repeated, late and interrupted batches."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import experiments
from corpusloom.streaming import admission, jobs, tables

STORE = "spark.sql.streaming.stateStore.providerClass"


def finished(query):
    query.awaitTermination(200)
    assert query.exception() is None


def test_ordered_admission_equals_the_replay(spark, tmp_path):
    """Batches in shuffled order, ties, requests without a time, a late one, and a client that comes back after days."""
    rng = random.Random(5)
    rows, n = [], 0
    for client in ("a", "b", None):
        for start in (0, 3 * 86_400):
            for _ in range(120):
                n += 1
                rows.append((client, (start + rng.randrange(3_000)) * 1_000_000, n))
    timeless = [("a", None, 9_001), ("zz", None, 9_002)]
    schema = "client string, us long, event_id long"
    early, later = [r for r in rows if r[1] < 86_400_000_000], [r for r in rows if r[1] > 86_400_000_000]
    batches = []
    for part in (early, later):
        rng.shuffle(part)
        batches += [part[k::3] for k in range(3)]
    batches[1] = batches[1] + timeless
    batches += [[("end", 30 * 86_400_000_000, 9_003)], [("a", 1_000_000, 9_004), ("end", 31 * 86_400_000_000, 9_005)], [("end", 32 * 86_400_000_000, 9_006)]]
    frame = lambda some: spark.createDataFrame(some, schema).select("client", F.timestamp_micros("us").alias("ts"), "event_id")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, admission.ROCKSDB)
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "cp"))
    try:
        for k, part in enumerate(batches):
            frame(part).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(frame(part).schema).parquet(source)
            got = admission.ordered_admission(stream, "client", "ts", 2, 40, "2 hours")
            finished(got.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    found = {r["event_id"]: r["accepted"] for r in spark.read.parquet(out).collect()}
    log = frame(rows + timeless)
    want = {r["event_id"]: r["accepted"] for r in experiments.admitted_requests(log, "client", "ts", 2, 40).collect()}
    assert {k: v for k, v in found.items() if k < 9_003} == want and sum(want.values()) > 40
    assert not found.get(9_004, False) and not want[9_001]


def test_timeless_requests_of_the_arrival_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 1), ("a", 5_000_000, 2), ("a", None, 3), ("a", 6_000_000, 4), ("a", 7_000_000, 5)], "client string, us long, event_id long").select("client", F.timestamp_micros("us").alias("ts"), "event_id")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.admission(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "client", "ts", 2, 9)
    finished(stream.writeStream.format("memory").queryName("timeless").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start())
    assert {r["event_id"]: r["accepted"] for r in spark.sql("select * from timeless").collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}


def lines(spark, seed):
    rng = random.Random(seed)
    made = ["step 10 epoch 1 loss=0.5 grad_norm=1.5", "ERROR: out of memory", "Traceback (most recent call last)", "nothing to see", "step=20, epoch=2, loss: 0.25"]
    text = [r["line"] for r in spark.createDataFrame([(x,) for x in made], "line string").collect()]
    return [(f"run{rng.randrange(5)}", k, rng.choice(text)) for k in range(200)]


def test_monitor_table_equals_the_batch_form(spark, tmp_path):
    rows = lines(spark, 1)
    random.Random(2).shuffle(rows)
    schema, source, table, mark = "run_id string, line_no long, line string", *(str(tmp_path / x) for x in ("in", "table", "cp"))
    for part in (rows[:90], rows[90:95], rows[95:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        finished(tables.monitor_table(spark.readStream.schema(schema).parquet(source), table, mark))
    shown = ["run_id", "step", "epoch", "loss", "grad_norm", "peak_loss", "peak_grad_norm", "n_errors", "stage"]
    whole = spark.createDataFrame(rows, schema)
    state = lambda: sorted(str(tuple(r)) for r in tables.monitored(spark, table).select(*shown).collect())
    assert state() == sorted(str(tuple(r)) for r in jobs.monitor(whole).select(*shown).collect())
    errors = {r["run_id"]: r["errors"] for r in tables.monitored(spark, table).collect() if r["errors"]}
    assert errors == {r["run_id"]: r["errors"] for r in jobs.last_errors(whole).collect()} and errors
    before, first = state(), spark.createDataFrame(rows[:90], schema)
    for number in (0, 1, 2, 0):  # replayed batches change nothing
        tables.upsert(tables.summarized(first), number, table, "run_id", tables.joined_summaries)
    assert state() == before
    assert tables.vacuum(spark, table, keep=1) > 0 and state() == before


def test_a_batch_that_stopped_before_its_commit(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    merge = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    frame = lambda *r: spark.createDataFrame(list(r), "k string, n long")
    tables.upsert(frame(("a", 1), ("b", 2)), 0, table, "k", merge)
    with monkeypatch.context() as m:
        m.setattr(tables, "commit", lambda *a, **b: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            tables.upsert(frame(("a", 10)), 1, table, "k", merge)
    assert sorted(tuple(r) for r in tables.current(spark, table).collect()) == [("a", 1), ("b", 2)]
    for _ in range(2):
        tables.upsert(frame(("a", 10)), 1, table, "k", merge)
    assert sorted(tuple(r) for r in tables.current(spark, table).collect()) == [("a", 11), ("b", 2)]


def test_increments_once(spark, tmp_path, monkeypatch):
    """A crash between write and commit repeats nothing; failures and rows without a key are counted and kept apart."""
    table, done = str(tmp_path / "t"), []

    def work(rows):
        done.extend(r["id"] for r in rows.collect())
        return rows.withColumn("problem", F.when(F.col("x") < 0, "negative"))

    frame = lambda *r: spark.createDataFrame(list(r), "id long, x long")
    first = frame((1, 1), (1, 1), (2, -1), (None, 5), (None, 6))
    with monkeypatch.context() as m:
        m.setattr(tables, "commit", lambda *a, **b: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            tables.increment(first, 0, table, "id", work)
    assert tables.committed(spark, table) is None
    for _ in range(2):
        assert {k: v for k, v in tables.increment(first, 0, table, "id", work).items() if k != "batch"} == {"done": 1, "failed": 1, "without_key": 2}
    assert sorted(done) == [1, 1, 2, 2]  # twice: of the batch that stopped, and of its repetition
    entry = tables.increment(frame((1, 9), (2, 2), (3, 3)), 1, table, "id", work)
    assert entry["done"] == 2 and entry["failed"] == 0
    assert sorted((r["id"], r["x"]) for r in spark.read.parquet(table).collect()) == [(1, 1), (2, 2), (3, 3)] == sorted((r["id"], r["x"]) for r in tables.committed(spark, table).collect())
    assert spark.read.parquet(f"{table}/_quarantine").count() == 3


def test_null_keys_of_the_stream(spark, tmp_path):
    source, table, mark = (str(tmp_path / x) for x in ("in", "t", "cp"))
    for part in ([(None, "x"), (1, "y")], [(None, "x"), (1, "y"), (2, "z")]):
        spark.createDataFrame(part, "id long, h string").write.mode("append").parquet(source)
        finished(jobs.incremental(spark, source, spark.createDataFrame(part, "id long, h string").schema, "id", table, lambda b: b, mark))
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == [1, 2]
    assert sum(e["without_key"] for e in tables.commits(spark, table).values()) == 2


def test_retention_in_two_phases(spark, tmp_path, monkeypatch):
    folder, log = tmp_path / "files", str(tmp_path / "log")
    folder.mkdir()
    for k in range(20):
        (folder / f"{k}.bin").write_text("x")
    files = spark.createDataFrame([(f"file:{folder}/{k}.bin", k) for k in range(20)], "path string, age int")
    assert tables.marked(files, F.col("age") >= 12, log, 0) == 8 and len(list(folder.iterdir())) == 20
    (folder / "15.bin").unlink()  # a run that stopped between the phases, after its first removal
    assert tables.marked(files, F.col("age") >= 5, log, 0) == 8  # a committed list doesn't change
    assert tables.removed(spark, log) == 8 and sorted(int(p.stem) for p in folder.iterdir()) == list(range(12))
    assert tables.removed(spark, log) == 0
    with monkeypatch.context() as m:  # tombstones that weren't committed remove nothing
        m.setattr(tables, "commit", lambda *a, **b: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            tables.marked(files, F.col("age") >= 5, log, 1)
    assert tables.removed(spark, log) == 0 and len(list(folder.iterdir())) == 12
    assert tables.marked(files, F.col("age") >= 5, log, 1) == 15 and tables.removed(spark, log) == 7 and len(list(folder.iterdir())) == 5
