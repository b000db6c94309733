"""Audio jobs on WAV files made here, sources and sinks on files written here, and the streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import audio as A
from corpusloom.operators import audio, experiments
from corpusloom.plans import workloads
from corpusloom.sources import manifest
from corpusloom.streaming import jobs


def tone(hz, seconds, rate, level=0.5):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype(np.float32)[None, :]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("audio")
    for n, (hz, s) in enumerate([(220, 4.0), (440, 3.0), (330, 12.0), (550, 2.0)]):
        d = root / f"Track{n:05}"
        d.mkdir()
        (d / "mix.wav").write_bytes(A.encode(tone(hz, s, 16_000), 16_000))
        (d / "._mix.wav").write_bytes(b"junk")
    (root / "Track00001" / "silent.wav").write_bytes(A.encode(np.zeros((1, 32_000), np.float32), 16_000))
    (root / "Track00002" / "broken.wav").write_bytes(b"RIFFnothing")
    (root / "Track00003" / "empty.wav").write_bytes(b"")
    return str(root)


def test_resampler_keeps_a_tone():
    y = A.resample(tone(440, 1, 16_000), 16_000, 8_000)
    assert y.shape == (1, 8_000)
    assert np.abs(y[0, 500:-500] - tone(440, 1, 8_000)[0, 500:-500]).max() < 0.01
    assert np.abs(A.resample(tone(6_000, 1, 16_000), 16_000, 8_000)[0, 500:-500]).max() < 0.02  # above what 8 kHz holds


def test_bounds():
    assert A.bounds(10, 4, 4) == [(0, 4), (4, 8)] and A.bounds(10, 4, 4, True) == [(0, 4), (4, 8), (8, 12)] and A.bounds(3, 4, 4) == []


def test_round_trip_and_hashes():
    x = tone(300, 0.5, 8_000)
    y, rate = A.decode(A.encode(x, 8_000))
    assert rate == 8_000 and np.abs(x - y).max() < 1e-4
    assert A.waveform_sha256(x, 8_000) != A.waveform_sha256(x, 16_000) and A.pcm_sha256(x[0]) != A.waveform_sha256(x, 8_000)


def test_chroma_and_measures():
    c = A.chroma(tone(440, 12, 16_000)[0], 16_000)
    assert c.shape == (2, 12) and (c.argmax(axis=1) == 9).all() and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)
    m = A.song_measures(np.concatenate([np.zeros((1, 16_000), np.float32), tone(440, 3, 16_000)], axis=1), 16_000)
    assert 0.2 < m["silent_ratio"] < 0.3 and abs(m["leading_silence_seconds"] - 1) < 0.1 and m["channels"] == 1
    y, report = A.finish(tone(440, 2, 16_000, 0.01), 16_000)
    assert report["gain_db"] == 12.0 and report["loudness_after"] > report["loudness_before"] + 10 and np.abs(y).max() <= 0.9


def frames_by_hand(x, n):
    """Centred frames one by one."""
    y = np.concatenate([x[1 : n // 2 + 1][::-1], x, x[-n // 2 - 1 : -1][::-1]])
    w = np.array([0.5 - 0.5 * np.cos(2 * np.pi * k / n) for k in range(n)])
    return [np.abs(np.fft.rfft(y[i : i + n] * w)) for i in range(0, len(y) - n + 1, n // 4)]


def test_chroma_sums_magnitudes():
    """Two tones of unlike loudness: the profile is in proportion to magnitudes, not to their squares."""
    rate = 16_000
    x = (0.5 * np.sin(2 * np.pi * 440 * np.arange(6 * rate) / rate) + 0.25 * np.sin(2 * np.pi * 660 * np.arange(6 * rate) / rate)).astype(np.float32)
    c = A.chroma(x, rate)[0]
    hertz, total = np.fft.rfftfreq(4096, 1 / rate), np.zeros(12)
    for start in list(range(0, len(x) - 4096, 2048))[: int(5 * rate / 2048)]:
        spectrum = np.abs(np.fft.rfft(x[start : start + 4096] * np.hanning(4096)))
        for h, m in zip(hertz, spectrum):
            if 80 <= h <= 5000:
                total[int(round(69 + 12 * np.log2(h / 440))) % 12] += m
    assert np.allclose(c, total / np.linalg.norm(total), atol=1e-5) and 0.4 < c[4] / c[9] < 0.6


def test_character_and_reconstruction_by_hand(spark):
    rng = np.random.default_rng(4)
    rate = 8_000
    x, y = rng.normal(scale=0.2, size=3_000), rng.normal(scale=0.2, size=3_000)
    mags = np.array(frames_by_hand(x, 1024))
    f = A.character(x, rate)
    hertz = np.arange(513) * rate / 1024
    assert np.isclose(f["low_band_ratio"], mags[:, hertz < 250].sum() / mags.sum()) and np.isclose(f["high_band_ratio"], mags[:, hertz > 4000].sum() / mags.sum())
    assert np.isclose(f["spectral_flatness"], np.mean([np.exp(np.mean(np.log(m))) / np.mean(m) for m in mags]))
    assert np.isclose(f["spectral_flux"], np.mean([np.maximum(b - a, 0).sum() / b.sum() for a, b in zip(mags, mags[1:])]))
    assert np.isclose(f["zero_crossing_rate"], np.mean([np.sign(a) != np.sign(b) for a, b in zip(x, x[1:])])) and np.isclose(f["rms"], np.sqrt((x**2).mean()))
    assert A.character(x[:500], rate)["spectral_flux"] == 0
    r = A.reconstruction(x, y, 24_000)
    logs = [np.abs(np.log1p(frames_by_hand(x, n)) - np.log1p(frames_by_hand(y, n))).mean() for n in (256, 512, 1024)]
    b = np.array(frames_by_hand(y, 1024))
    assert np.isclose(r["mr_stft"], np.mean(logs)) and np.isclose(r["spectral_convergence"], np.linalg.norm(b - mags) / np.linalg.norm(b))
    assert np.isclose(r["log_spectral_distance"], np.sqrt(((20 * np.log10(mags / b)) ** 2).mean()))
    high = np.arange(513) * 24_000 / 1024 > 4000
    assert np.isclose(r["high_frequency_db"], 10 * np.log10((mags[:, high] ** 2).sum() / (b[:, high] ** 2).sum()))
    rise = [np.array([np.maximum(q - p, 0).sum() for p, q in zip(m, m[1:])]) for m in (mags, b)]
    assert np.isclose(r["transient_correlation"], np.corrcoef(*rise)[0, 1])
    pair = spark.createDataFrame([(1, x.tolist(), y.tolist())], "id int, p array<double>, t array<double>")
    assert np.isclose(audio.spectral_metrics(pair, "id", "p", "t").first()["metrics"]["mr_stft"], r["mr_stft"])
    kinds = {"click": np.eye(1, 4_000, 2_000)[0], "hum": tone(60, 1, rate)[0], "note": tone(1_500, 1, rate)[0]}
    rows = spark.createDataFrame([(k, 0, v.tolist()) for k, v in kinds.items()], "path string, segment_index int, samples array<float>")
    got = {r["path"]: r for r in audio.characters(rows, rate=rate).collect()}
    assert got["hum"]["character"] == "bass_heavy" and got["note"]["character"] == "harmonic" and got["click"]["character"] == "percussive"
    g = got["note"]["features"]
    assert np.isclose(got["note"]["scores"]["harmonic"], (1 - g["spectral_flatness"]) + (1 - g["zero_crossing_rate"]) - 1.5 * g["low_band_ratio"] - g["spectral_flux"])


def test_finishing():
    rate = 48_000
    y, r = A.finish(tone(1_000, 2, rate, 0.9) + 0.05, rate)
    assert abs(r["dc_removed"] - 0.05) < 1e-3 and r["limited_ratio"] == 0 and r["output_peak_db"] < -1
    assert abs(A.loudness(tone(997, 4, rate, 1.0)) + 3.01) < 0.05  # a full-scale tone at about 1 kHz is -3.01 LUFS
    spiky = tone(300, 2, rate, 0.05)
    spiky[0, 40_000] = 0.9
    y, r = A.finish(spiky, rate)
    assert r["gain_db"] == 12.0 and r["limiter_reduction_db"] > 5 and np.abs(y).max() <= 10 ** (-1 / 20) + 1e-6
    bad = tone(300, 1, rate)
    bad[0, 5] = np.nan
    assert A.finish(bad, rate)[1]["repaired"] == 1.0 and A.finish(np.zeros((1, 100), np.float32), rate)[1]["loudness_after"] < -100


def test_preprocessing(spark, tree):
    files = manifest.find_audio(spark, tree, [".wav"])
    assert files.count() == 6  # Spark's source doesn't list empty files
    probes = {r["path"].split("/")[-1]: r for r in audio.validated(audio.probed(files), 0.5, 10, [".wav"]).collect() if "Track00000" not in r["path"]}
    assert "undecodable" in probes["broken.wav"]["reasons"]
    out = audio.preprocessed(files).cache()
    assert out.filter("ok").count() == 4 + 3 + 12 + 2
    assert {(r["stage"], r["n"]) for r in out.filter("not ok").groupBy("stage").agg(F.count("*").alias("n")).collect()} == {("decode", 1), ("silence", 2)}
    assert audio.characters(out.filter("ok").select("path", "segment_index", "samples")).count() == 21
    assert audio.fingerprinted(files).filter("error is null").count() == 5 and audio.measured(files).filter("error is null").count() == 5
    assert audio.finished(files).filter("content is not null").count() == 5
    facts = {r["path"].split("/")[-1]: r for r in audio.described(files).collect() if "Track00000" not in r["path"]}
    assert facts["silent.wav"]["silent"] and facts["silent.wav"]["seconds"] == 2.0 and facts["broken.wav"]["error"] and not facts["mix.wav"]["silent"]


def test_workload(spark, tree, tmp_path):
    out = workloads.segment_manifest(spark, tree, str(tmp_path / "out"), "set", "CC0-1.0")
    assert out["leaks"].count() == 0 and out["segments"].count() == 21 and out["duplicates"].first()["cross_split_groups"] == 0
    assert out["segments"].select("id").distinct().count() == 21


def test_lines(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text("\n".join([json.dumps({"id": "a", "path": "p", "tags": ["x"], "odd": {"k": 1}}), "", "{broken", json.dumps({"id": "b"})]))
    good, bad = manifest.read_lines(spark, str(path), schemas.SEGMENTS)
    rows = {r["id"]: r for r in good.collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["extra"]["odd"] == '{"k":1}' and rows["a"]["tags"] == ["x"] and rows["b"]["path"] is None
    assert [(r["line_no"], r["line"]) for r in bad.collect()] == [(3, "{broken")]
    with pytest.raises(ValueError, match="m.jsonl:3: .*broken"):
        manifest.refuse_rejects(bad)
    manifest.write_lines(good, str(tmp_path / "out"))
    again, none = manifest.read_lines(spark, str(tmp_path / "out"), schemas.SEGMENTS)
    assert none.count() == 0 and again.count() == 2


def test_catalogue(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(",track,track,artist\n,license,duration,name\ntrack_id,,,\n1,Attribution 4.0,120,A\n2,CC0,60,\"B, and C\"\nx,,,\n")
    rows = manifest.read_catalogue(spark, str(path))
    assert rows.columns == ["track_id", "track.license", "track.duration", "artist.name"] and rows.count() == 3
    assert manifest.read_catalogue(spark, str(path), strict=True).count() == 2


def test_registry_and_prompts(spark):
    table, problems = manifest.load_registry(spark, {"a": {"source_url": "u", "license_name": "MIT"}, "b": {"gated": True}}, ["a", "zz"])
    assert [r[0] for r in manifest.needing_acceptance(table).collect()] == ["b"]
    assert {tuple(r) for r in problems.collect()} == {("b", "missing source_url"), ("b", "missing license_name"), ("zz", "unknown dataset in order")}
    got = manifest.load_prompts(spark, [{"id": "x", "prompt": " a  b "}], {"seed": 7}).first()
    assert got["prompt"] == "a b" and got["seed"] == 7
    with pytest.raises(ValueError):
        manifest.load_prompts(spark, [{"id": "x"}, {"id": "x"}], {})


def test_admission_stream_equals_replay(spark, sf, tmp_path):
    log = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).filter("user_id < 12")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.admission(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), "user_id", "ts", 1, 3)
    q = stream.writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r["event_id"], r["accepted"]) for r in spark.sql("select * from admitted").collect()}
    assert got == {(r["event_id"], r["accepted"]) for r in experiments.admitted_requests(log, "user_id", "ts", 1, 3).collect()} and len(got) > 10


def test_incremental_and_dedup(spark, tmp_path):
    src, target, cp = (str(tmp_path / x) for x in ("src", "target", "cp"))
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, h string")
    first.write.parquet(src)
    run = lambda: jobs.incremental(spark, src, first.schema, "id", target, lambda b: b, cp).awaitTermination(120)
    run()
    spark.createDataFrame([(2, "b"), (3, "c")], "id long, h string").write.mode("append").parquet(src)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_resolved_curve(spark):
    rows = spark.createDataFrame([("r", 1, 1, 0.5), ("r", 2, 1, 0.4), ("r", 2, 2, 0.3), ("r", None, 1, 0.1)], "run_id string, step int, session int, loss double")
    now, old = jobs.resolved_curve(rows)
    assert now.count() == 3 and old.first()["loss"] == 0.4


def test_appended_curve(spark, tmp_path):
    """A run that resumes replays steps; each start of the job appends what is new, once."""
    schema, source, target = "run_id string, step int, session int, loss double", str(tmp_path / "in"), str(tmp_path / "curve")
    for rows in ([("r", 1, 1, 0.5), ("r", 2, 1, 0.4)], [("r", 2, 2, 0.3), ("r", 3, 2, 0.2)], []):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        jobs.appended_curve(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "cp")).awaitTermination()
    now, old = jobs.resolved_curve(spark.read.parquet(target))
    assert sorted((r["step"], r["loss"]) for r in now.collect()) == [(1, 0.5), (2, 0.3), (3, 0.2)] and [(r["step"], r["loss"]) for r in old.collect()] == [(2, 0.4)]


def test_line_numbers_over_blocks(spark, tmp_path):
    """Files of which some are read in several blocks."""
    want = set()
    for name in "abc":
        lines = [json.dumps({"id": f"{name}{i}", "path": "p" * 50}) for i in range(400)]
        for at in (0, 150, 399) if name != "b" else ():
            lines[at] = f"{{bad {name}{at}"
            want.add((f"{name}.jsonl", at + 1, lines[at]))
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        good, bad = manifest.read_lines(spark, str(tmp_path), schemas.SEGMENTS)
        assert {(r["file"].split("/")[-1], r["line_no"], r["line"]) for r in bad.collect()} == want and good.count() == 1_194
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_written_splits_corpora_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t1", "train", "s", "MIT", "x", 2.0, False), ("b", "t2", "val", "s", "CC0", None, 3.5, True)], "id string, track_id string, split string, source string, license string, singer_id string, duration_seconds double, silent boolean")
    manifest.write_splits(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/manifests")).count() == 2 and {(r["split"], r["segments"], r["seconds"]) for r in spark.read.json(str(tmp_path / "m/summary")).collect()} == {(None, 2, 5.5), ("train", 1, 2.0), ("val", 1, 3.5)}
    corpus = spark.createDataFrame([("d", "t", "p/x.wav", "MIT", "permissive", "u", "train", "h", "a caption", "", 12.5, "en")], "dataset string, track_id string, audio_path string, licence string, licence_class string, source_url string, split string, duplicate_hash string, caption string, lyrics string, quality_score double, language string").withColumn("quality_score", F.lit(0.5)).withColumn("duration_seconds", F.lit(12.5))
    assert manifest.write_corpus(corpus, str(tmp_path / "c")) == 1
    assert manifest.read_corpus(spark, str(tmp_path / "c")).select("track_id", "quality_score").first() == ("t", 0.5)
    manifest.write_lines(corpus.withColumn("split", F.lit("odd")), str(tmp_path / "d"))
    with pytest.raises(Exception, match="bad split"):
        manifest.read_corpus(spark, str(tmp_path / "d")).collect()
    manifest.export_training(corpus, str(tmp_path / "e"))
    one = spark.read.json(str(tmp_path / "e/samples")).first()
    assert (one["filename"], one["is_instrumental"], one["labeled"], one["duration"]) == ("x.wav", True, True, 12.5)
    assert spark.read.json(str(tmp_path / "e/metadata")).first()["num_samples"] == 1


def test_sheets_curves_and_histories(spark, tmp_path):
    (tmp_path / "s.csv").write_text("track,overall_realism,emotion\n_legend,1-10,1-10\npiano,7,n/a\nvocal,,12\n")
    sheet = manifest.read_sheet(spark, str(tmp_path / "s.csv"))
    assert [tuple(r) for r in manifest.bad_cells(sheet).collect()] == [("vocal", "emotion", "12")]
    (tmp_path / "c.csv").write_text("step,loss,note\n1,0.5,x\n2,oops,y\n")
    rows = manifest.read_curve(spark, str(tmp_path / "c.csv"), ["step", "loss"]).orderBy("step").collect()
    assert [(r["step"], r["loss"], r["note"]) for r in rows] == [(1.0, 0.5, "x"), (2.0, None, "y")] and rows[0]["file"].endswith("c.csv")
    (tmp_path / "h.jsonl").write_text('{"step": 1, "flag": true}\n{"step": \n')
    good, bad = manifest.read_history(spark, str(tmp_path / "h.jsonl"), "step long, flag boolean")
    assert good.collect() == [(1, True)] and bad.first()["line_no"] == 2


def test_labels_provenance_and_fingerprints(spark):
    from corpusloom.functions import columns
    from corpusloom.operators import joins, select, splits, validate

    stems = spark.createDataFrame([("t", "S1", "Bass", "Fretless", False), ("t", "S1", "Bass", "Fretless", False)], "track_id string, stem_id string, inst_class string, program_name string, is_drum boolean")
    rows = spark.createDataFrame([("t", "S1"), ("t", "mix"), ("t", "S9"), ("t", None)], "track_id string, stem_id string")
    got = sorted(str((r["stem_id"], r["instrument_family"], r["instrument_name"], r["is_drum"])) for r in joins.labelled(rows, stems).collect())
    assert got == sorted(map(str, [("S1", "Bass", "Fretless", False), (None, "Mixture", "mix", False), ("S9", None, None, None), (None, None, None, None)]))
    registry, _ = manifest.load_registry(spark, {"d": {"source_url": "u", "gated": True}})
    p = {r["source"]: r["provenance"] for r in manifest.with_provenance(spark.createDataFrame([("d",), ("e",)], "source string"), registry).collect()}
    assert p["d"]["name"] == "d" and p["d"]["requires_user_acceptance"] and p["e"] is None
    a, b = (spark.range(1).select(columns.fingerprint(F.struct(F.lit(x).alias("a"), F.lit("y").alias("b")))).first()[0] for x in (1, 2))
    assert len(a) == 16 and a != b
    keys = spark.createDataFrame([(f"p{i}",) for i in range(40)], "path string")
    probe = select.probe(keys, "path", 5)
    import hashlib

    want = sorted(sorted((f"p{i}" for i in range(40)), key=lambda k: hashlib.sha256(k.encode()).hexdigest())[:5])
    assert sorted(r["path"] for r in probe.collect()) == want and select.probe_fingerprint(probe, "path").first()[0] == hashlib.sha256("\x1f".join(want).encode()).hexdigest()
    singers = spark.createDataFrame([("t1", "s"), ("t2", "s"), ("t3", ""), ("t4", None)], "track_id string, singer_id string")
    assert [r[0] for r in singers.select(columns.group_key("singer", F.col("track_id"), F.col("singer_id"))).collect()] == ["s", "s", "t3", "t4"]
    plan = splits.by_quota(singers.withColumn("g", columns.group_key("singer", F.col("track_id"), F.col("singer_id"))), "g")
    assert plan.count() == 3
    runs = spark.createDataFrame([("f", "r1", 1), ("f", "r2", 2), ("g", "r1", 1), ("g", "r1", 1), ("h", "r1", 1)], "file string, run_id string, step int")
    assert sorted(r["file"] for r in validate.single_run(runs).collect()) == ["f", "g"]
    zero = spark.createDataFrame([("a", "p", 0, 1.0, 8_000, 8_000)], "id string, path string, channels int, duration_seconds double, num_samples int, sample_rate int")
    assert [r["problem"] for r in validate.record_problems(zero, ["path", "channels"]).collect()] == ["missing channels"]
    assert joins.drift(spark.createDataFrame([("x", 1.0, 1.0)], "name string, total double, std double"), None).first()["has_changed"] is None


def run_stream(df, name, mode, path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(path)).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_streams(spark, tmp_path):
    """Monitoring, deduplication and queue depth as streams over files give what they give over tables."""
    schema = "run_id string, line_no long, line string, alive boolean"
    lines = [("a", 1, "step 1 loss 0.5", True), ("a", 2, "ERROR one", None), ("a", 3, "step 2 loss 0.7", False), ("b", 1, "hello", None), ("c", 1, "step=4 loss: 0.1", None), ("d", 1, "step=4 loss: 0.1", True), ("d", 2, "Traceback", None)]
    for k in (0, 1):
        spark.createDataFrame(lines[k::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "lines"))
    from corpusloom.streaming import jobs as j

    got = {r["run_id"]: (r["step"], r["peak_loss"], r["n_errors"], r["stage"]) for r in run_stream(j.monitor(spark.readStream.schema(schema).parquet(str(tmp_path / "lines")), "alive"), "watched", "complete", tmp_path / "cp1")}
    assert got == {"a": (2, 0.7, 1, "failed"), "b": (None, None, 0, "starting"), "c": (4, 0.1, 0, "stopped"), "d": (4, 0.1, 1, "training")}
    assert {r["run_id"]: r["errors"] for r in j.last_errors(spark.createDataFrame(lines, schema)).collect()} == {"a": ["ERROR one"], "d": ["Traceback"]}

    hashed = "id long, h string, ts timestamp"
    rows = spark.createDataFrame([(1, "x", 0), (2, "x", 60), (3, "", 70), (4, None, 80), (5, "y", 90)], "id long, h string, s long").select("id", "h", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "hashes"))
    stream = lambda: spark.readStream.schema(hashed).parquet(str(tmp_path / "hashes"))
    assert sorted(r["h"] for r in run_stream(j.deduplicated(stream(), "h"), "first_seen", "append", tmp_path / "cp2")) == ["x", "y"]
    assert sorted(r["h"] for r in run_stream(j.deduplicated(stream(), "h", "ts"), "seen_late", "append", tmp_path / "cp3")) == ["x", "y"]

    events = spark.range(40).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.when(F.col("id") % 3 == 0, "done").otherwise("pending").alias("status"))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    streamed = run_stream(j.queue_depth(spark.readStream.schema("ts timestamp, status string").parquet(str(tmp_path / "events"))), "depths", "update", tmp_path / "cp4")
    assert {tuple(r) for r in streamed} == {tuple(r) for r in j.queue_depth(events).collect()}
    files = spark.createDataFrame([("old", 0), ("new", 9_000)], "path string, s long").select("path", F.timestamp_seconds("s").alias("modificationTime"))
    import datetime

    assert [r["path"] for r in j.expired(files, 2, datetime.datetime(1970, 1, 1, 3, 0, 0)).collect()] == ["old"]
