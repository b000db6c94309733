"""Jobs over audio files: probe, preprocess to segments, fingerprints, measures. Files come from Spark's binaryFile source,
in small Arrow batches; decoded samples leave a task only as segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audio
from ..functions.arrays import character_scores

PROBE = "path string, size_bytes long, sample_rate int, channels int, duration_seconds double, error string"
SEGMENT = "path string, ok boolean, stage string, reason string, segment_index int, start_sample long, num_samples int, sample_rate int, channels int, duration_seconds double, peak double, rms double, peak_dbfs double, rms_dbfs double, clipping_ratio double, silent boolean, source_sha256 string, audio_sha256 string, samples array<float>"


def spread(files: DataFrame, bytes_each: int = 64 << 20, most: int = 100_000) -> DataFrame:
    """files dealt out anew, about bytes_each to a task. Only listings are counted; contents are read afterwards."""
    total = files.agg(F.sum("length")).first()[0] or 0
    return files.repartition(int(min(max(total // bytes_each, 1), most)))


def mapped(files: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(path, content) -> rows as in schema, for each file."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames):
        import pandas as pd

        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                rows = list(work(path, content))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def probed(files: DataFrame) -> DataFrame:
    """A row for each file, and why it can't be read, if so. Never fails."""

    def work(path, content):
        try:
            x, rate = audio.decode(content)
            yield path, len(content), rate, len(x), x.shape[1] / rate, None
        except audio.AudioError as e:
            yield path, len(content), None, None, None, str(e)

    return mapped(files, work, PROBE)


def validated(probes: DataFrame, min_seconds: float, max_seconds: float, suffixes: list[str]) -> DataFrame:
    """probes with reasons and ok."""
    reasons: list[Column] = [
        F.when(~F.lower(F.regexp_extract("path", r"\.[^.]*$", 0)).isin(suffixes), "suffix"), F.when(F.col("size_bytes") == 0, "empty file"), F.when(F.col("error").isNotNull(), "undecodable"),
        F.when(F.col("duration_seconds") < min_seconds, "too short"), F.when(F.col("duration_seconds") > max_seconds, "too long"),
    ]
    return probes.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("ok", F.size("reasons") == 0)


def preprocessed(files: DataFrame, rate: int = 8000, channels: int = 1, seconds: float = 1.0, hop_seconds: float | None = None, min_seconds: float = 0.5, pad_last: bool = False, normalize: str | None = None, silence_db: float = -60.0) -> DataFrame:
    """Segments and rejects (ok false, with stage and reason) of all files, in one pass: decode, channels, resample,
    levels, normalise, cut, drop silence. Write it once and filter by ok."""
    import hashlib

    length, hop = int(seconds * rate), int((hop_seconds or seconds) * rate)

    def work(path, content):
        reject = lambda stage, reason, i=None: (path, False, stage, reason, i, *[None] * 14)
        try:
            x, own = audio.decode(content)
        except audio.AudioError as e:
            yield reject("decode", str(e))
            return
        if x.shape[1] / own < min_seconds:
            yield reject("validate", "too short")
            return
        y = audio.resample(audio.to_channels(x, channels), own, rate)
        if normalize:
            y = audio.normalize(y, by=normalize)
        digest = hashlib.sha256(content).hexdigest()
        for i, (a, b) in enumerate(audio.bounds(y.shape[1], length, hop, pad_last)):
            s = audio.extract(y, a, b)
            v = audio.levels(s)
            if v["rms_dbfs"] < silence_db:
                yield reject("silence", "silent", i)
                continue
            yield path, True, None, None, i, a, length, rate, channels, length / rate, v["peak"], v["rms"], v["peak_dbfs"], v["rms_dbfs"], v["clipping_ratio"], False, digest, audio.waveform_sha256(s, rate), s.reshape(-1)

    return mapped(files, work, SEGMENT)


def fingerprinted(files: DataFrame) -> DataFrame:
    """path, pcm_sha256, chroma (windows of 12) and error of each file."""

    def work(path, content):
        try:
            x, rate = audio.decode(content)
            mono = x.mean(axis=0)
            yield path, audio.pcm_sha256(mono), audio.chroma(mono, rate).tolist(), None
        except audio.AudioError as e:
            yield path, None, None, str(e)

    return mapped(files, work, "path string, pcm_sha256 string, chroma array<array<float>>, error string")


def measured(files: DataFrame) -> DataFrame:
    """path, measures (name -> value) and error of each file."""

    def work(path, content):
        try:
            yield path, audio.song_measures(*audio.decode(content)), None
        except audio.AudioError as e:
            yield path, None, str(e)

    return mapped(files, work, "path string, measures map<string,double>, error string")


def finished(files: DataFrame, target: float = -14.0) -> DataFrame:
    """path, content (the mastered WAV), report and error of each file."""

    def work(path, content):
        try:
            x, rate = audio.decode(content)
            y, report = audio.finish(x, rate, target)
            yield path, audio.encode(y, rate), report, None
        except audio.AudioError as e:
            yield path, None, None, str(e)

    return mapped(files, work, "path string, content binary, report map<string,double>, error string")


def spectral_metrics(pairs: DataFrame, key: str, pred: str, target: str) -> DataFrame:
    """key and `metrics` of pairs of equally long signals."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({key: f[key], "metrics": [audio.reconstruction(np.asarray(p), np.asarray(t)) for p, t in zip(f[pred], f[target])]})

    return pairs.select(key, pred, target).mapInPandas(run, f"`{key}` {kind}, metrics map<string,double>")


def characters(segments: DataFrame, key: str = "path", rate: int = 8000) -> DataFrame:
    """key, segment_index, features, scores and the character that scores highest."""
    kind = segments.schema[key].dataType.simpleString()

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({key: f[key], "segment_index": f["segment_index"], "features": [audio.character(np.asarray(s), rate) for s in f["samples"]]})

    found = segments.select(key, "segment_index", "samples").mapInPandas(run, f"`{key}` {kind}, segment_index int, features map<string,double>")
    f = F.col("features")
    scores = character_scores(f["low_band_ratio"], f["high_band_ratio"], f["spectral_flatness"], f["spectral_flux"], f["zero_crossing_rate"])
    return found.withColumn("scores", scores).withColumn("character", F.col("scores.character"))


def described(files: DataFrame, silent_below: float = 1e-3) -> DataFrame:
    """path, seconds, peak, rms, dc, silent and error of each file."""

    def work(path, content):
        try:
            x, rate = audio.decode(content)
            v = audio.levels(x)
            yield path, x.shape[1] / rate, v["peak"], v["rms"], v["dc"], v["peak"] < silent_below, None
        except audio.AudioError as e:
            yield path, None, None, None, None, None, str(e)

    return mapped(files, work, "path string, seconds double, peak double, rms double, dc double, silent boolean, error string")
