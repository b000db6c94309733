"""Samples as arrays: levels, segments and scores as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR_DB = -160.0


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def decibels(x: Column) -> Column:
    return F.when(x > 0, F.greatest(20 * F.log10(x), F.lit(FLOOR_DB))).otherwise(FLOOR_DB)


def levels(samples: Column, clip_at: float = 0.999) -> Column:
    """peak, rms, their dBFS, clipping_ratio and dc of one channel; zeros where there are no samples."""
    x = F.transform(samples, lambda v: v.cast("double"))
    n = F.size(x)
    some = n > 0
    peak = F.when(some, F.array_max(F.transform(x, F.abs))).otherwise(0.0)
    rms = F.when(some, F.sqrt(_sum(F.transform(x, lambda v: v * v)) / n)).otherwise(0.0)
    clipped = F.when(some, F.size(F.filter(x, lambda v: F.abs(v) >= clip_at)) / n).otherwise(0.0)
    dc = F.when(some, _sum(x) / n).otherwise(0.0)
    return F.struct(peak.alias("peak"), rms.alias("rms"), decibels(peak).alias("peak_dbfs"), decibels(rms).alias("rms_dbfs"), clipped.alias("clipping_ratio"), dc.alias("dc"))


def is_silent(rms_dbfs: Column, threshold_db: float = -60.0) -> Column:
    return rms_dbfs < threshold_db


def is_clipped(clipping_ratio: Column, threshold: float = 0.01) -> Column:
    return clipping_ratio > threshold


def segment_starts(n: Column, length: int, hop: int, pad_last: bool = False) -> Column:
    """The first samples of the segments. Padded, a last one covers what is left over."""
    whole = F.when(n >= length, F.sequence(F.lit(0), n - length, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    if not pad_last:
        return whole
    following = F.when(F.size(whole) == 0, F.lit(0)).otherwise(F.element_at(whole, -1) + hop)
    covered = F.when(F.size(whole) == 0, F.lit(0)).otherwise(F.element_at(whole, -1) + length)
    return F.when((covered < n) & (following < n), F.concat(whole, F.array(following))).otherwise(whole)


def segment(samples: Column, start: Column, length: int) -> Column:
    """`length` samples from a start, zeros behind the end."""
    part = F.slice(samples, start + 1, F.lit(length))
    return F.concat(part, F.array_repeat(F.lit(0.0).cast("float"), F.lit(length) - F.size(part)))


def fitted(samples: Column, length: int) -> Column:
    """The centre `length` samples; shorter ones get zeros behind them."""
    n = F.size(samples)
    return F.when(n >= length, F.slice(samples, F.floor((n - length) / 2).cast("int") + 1, F.lit(length))).otherwise(segment(samples, F.lit(0), length))


def normalized(samples: Column, target: float = 0.95, by: str = "peak", max_gain: float = 20.0) -> Column:
    """Scaled so that the peak or the rms reaches a target, by a bounded gain, clamped to [-1, 1]."""
    level = levels(samples)[by]
    gain = F.when(level > 0, F.least(F.lit(target) / level, F.lit(max_gain))).otherwise(1.0)
    return F.transform(samples, lambda v: F.greatest(F.least(v.cast("double") * gain, F.lit(1.0)), F.lit(-1.0)))


def to_mono(channels: Column, policy: str = "mean") -> Column:
    """One channel of an array of channels: their mean, or the first."""
    if policy == "first":
        return F.get(channels, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.size(F.get(channels, F.lit(0))) - 1), lambda i: _sum(F.transform(channels, lambda c: F.get(c, i).cast("double"))) / F.size(channels))


def to_channels(channels: Column, n: int, policy: str = "repeat") -> Column:
    """n channels: repeated in turn, or cut off, or padded with the last."""
    have = F.size(channels)
    place = (lambda i: F.pmod(i, have)) if policy == "repeat" else (lambda i: F.least(i, have - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(channels, place(i)))


#: Each defect with its measure, the benign value, the bound, and on which side of it the defect lies: fixed values.
DEFECTS = [
    ("clipping", "clipped", 0.0, ">", 1e-4),
    ("very quiet", "peak_db", 0.0, "<", -30.0),
    ("mostly silent", "silent", 0.0, ">", 0.35),
    ("long dead span", "gap", 0.0, ">", 5.0),
    ("band-limited / muffled", "rolloff", float("inf"), "<", 6000.0),
    ("noise-like", "flatness", 0.0, ">", 0.5),
    ("highly repetitive / loop-like", "repetition", 0.0, ">", 0.85),
]
#: A take's score: what it starts with, what each flag and each unit of a measure beyond its free part costs, and the
#: price of a take that hardly varies: fixed values.
FULL, PER_FLAG, COSTS, STATIC = 100.0, 25.0, {"silent": (0.0, 40.0), "gap": (2.0, 5.0), "clipped": (0.0, 100.0), "repetition": (0.7, 30.0 / 0.3)}, (0.05, 10.0)


def flags(measures: dict[str, Column], mono: Column | None = None, channels: Column | None = None) -> Column:
    """The defects that measures prove, in order of DEFECTS; two equal channels come before repetition. A measure that is
    absent is benign."""
    found = []
    for label, name, benign, side, bound in DEFECTS:
        if name == "repetition" and mono is not None:
            found.append(F.when(F.coalesce(mono, F.lit(False)) & (F.coalesce(channels, F.lit(1)) > 1), "dual-mono (no stereo image)"))
        value = F.coalesce(measures[name].cast("double"), F.lit(benign)) if name in measures else None
        if value is not None:
            found.append(F.when(value > bound if side == ">" else value < bound, label))
    return F.array_compact(F.array(*found))


def take_score(n_flags: Column, measures: dict[str, Column], variation: Column | None = None) -> Column:
    """What is left of a full score after the costs of flags and measures."""
    score = F.lit(FULL) - PER_FLAG * n_flags
    for name, (free, price) in COSTS.items():
        score = score - price * F.greatest(F.coalesce(measures[name].cast("double"), F.lit(0.0)) - free, F.lit(0.0))
    return score - F.when(variation < STATIC[0], STATIC[1]).otherwise(0.0) if variation is not None else score


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def reconstruction(pred: Column, target: Column) -> Column:
    """l1, snr and scale-invariant snr (dB) of two equally long signals."""
    p, t = F.transform(pred, lambda v: v.cast("double")), F.transform(target, lambda v: v.cast("double"))
    n = F.size(t)
    err = F.zip_with(p, t, lambda a, b: a - b)
    energy = lambda a: _sum(F.transform(a, lambda v: v * v))
    ratio = lambda s, e, least: 10 * F.log10(F.greatest(s, F.lit(least)) / F.greatest(e, F.lit(least)))
    scale = _sum(F.zip_with(p, t, lambda a, b: a * b)) / F.greatest(energy(t), F.lit(1e-12))
    wanted = F.transform(t, lambda v: v * scale)
    return F.struct((_sum(F.transform(err, F.abs)) / n).alias("l1"), ratio(energy(t) / n, energy(err) / n, 1e-8).alias("snr"), ratio(energy(wanted), energy(F.zip_with(p, wanted, lambda a, b: a - b)), 1e-12).alias("si_sdr"))


def character_scores(low: Column, high: Column, flatness: Column, flux: Column, crossings: Column) -> Column:
    """How much a segment's spectral features speak for each of four characters, and the one that scores highest (of
    equals the first)."""
    near = lambda c, centre: F.abs(c - centre)
    scores = {
        "percussive": flux + flatness + crossings,
        "harmonic": 2.0 - flatness - crossings - 1.5 * low - flux,
        "bass_heavy": 2.0 * low - high - flux,
        "mixed": 1.0 - near(low, 0.3) - near(high, 0.2) - near(flatness, 0.4) - near(flux, 0.3),
    }
    top = F.greatest(*scores.values())
    return F.struct(*(s.alias(n) for n, s in scores.items()), F.coalesce(*(F.when(s == top, n) for n, s in scores.items())).alias("character"))
