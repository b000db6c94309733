"""Arithmetic over decoded audio, in numpy: channels first, float32, in [-1, 1]. Spark partitions the files; these are
the small helpers that its tasks call."""

from __future__ import annotations

import functools
import hashlib
import io
import wave

import numpy as np

FRAME, HOP, WINDOW_S, A4 = 4096, 2048, 5.0, 440.0


class AudioError(ValueError):
    pass


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """(channels x samples, rate) of 16-bit PCM WAV."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            channels, width, rate, data = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        raise AudioError(f"corrupt: {e}") from e
    if width != 2:
        raise AudioError(f"{8 * width}-bit samples")
    x = np.frombuffer(data[: len(data) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).T.astype(np.float32) / 32768
    if not x.size:
        raise AudioError("no samples")
    return x, rate


def encode(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(x))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(x.T * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def waveform_sha256(x: np.ndarray, rate: int) -> str:
    """Of rounded 16-bit samples behind the rate and shape. Not comparable with `pcm_sha256`."""
    return hashlib.sha256(f"{rate}:{x.shape[0]}x{x.shape[1]}:".encode() + np.rint(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()).hexdigest()


def pcm_sha256(mono: np.ndarray) -> str:
    """Of truncated 16-bit samples of one channel."""
    return hashlib.sha256(np.clip(mono * 32767.0, -32768, 32767).astype("<i2").tobytes()).hexdigest()


def levels(x: np.ndarray, clip_at: float = 0.999) -> dict[str, float]:
    if not x.size:
        return {"peak": 0.0, "rms": 0.0, "peak_dbfs": -160.0, "rms_dbfs": -160.0, "clipping_ratio": 0.0, "dc": 0.0}
    y = x.astype(np.float64)
    db = lambda v: max(20 * np.log10(v), -160.0) if v > 0 else -160.0
    peak, rms = float(np.abs(y).max()), float(np.sqrt((y * y).mean()))
    return {"peak": peak, "rms": rms, "peak_dbfs": float(db(peak)), "rms_dbfs": float(db(rms)), "clipping_ratio": float((np.abs(y) >= clip_at).mean()), "dc": float(y.mean())}


def to_channels(x: np.ndarray, n: int) -> np.ndarray:
    """One channel is the mean; more are repeated in turn or cut off."""
    if n == 1:
        return x.mean(axis=0, keepdims=True)
    return x[np.arange(n) % len(x)] if len(x) < n else x[:n]


@functools.lru_cache(maxsize=32)
def _kernel(up: int, down: int, half: int = 16) -> np.ndarray:
    """A windowed sinc that passes what both rates can hold."""
    scale = max(up, down)
    t = np.arange(-half * scale, half * scale + 1)
    return (np.sinc(t / scale) * np.hanning(len(t) + 2)[1:-1] / scale * up).astype(np.float64)


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Band-limited, by a polyphase filter over the rates' ratio; n samples become ceil(n * to / rate)."""
    if rate == to:
        return x
    g = np.gcd(rate, to)
    up, down = to // g, rate // g
    h = _kernel(up, down)
    half, n_out = len(h) // 2, -(-x.shape[1] * up // down)
    reach = half // up + 1
    last = (n_out - 1) * down // up
    padded = np.pad(x.astype(np.float64), ((0, 0), (reach, reach + 1 + max(0, last + 1 - x.shape[1]))))
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=1)
    taps = np.arange(-reach, reach + 1) * up
    out = np.zeros((len(x), n_out))
    for phase in range(min(up, n_out)):  # outputs up apart see the input at the same fraction, down samples apart
        base, rest = divmod(phase * down, up)
        tap = rest - taps + half
        weights = np.where((tap >= 0) & (tap < len(h)), h[np.clip(tap, 0, len(h) - 1)], 0.0)
        n = len(range(phase, n_out, up))
        out[:, phase::up] = windows[:, base::down][:, :n] @ weights
    return out.astype(np.float32)


def normalize(x: np.ndarray, target: float = 0.95, by: str = "peak", max_gain: float = 20.0) -> np.ndarray:
    level = levels(x)[by]
    return np.clip(x * min(target / level, max_gain), -1, 1).astype(np.float32) if level > 0 else x


def bounds(n: int, length: int, hop: int, pad_last: bool = False) -> list[tuple[int, int]]:
    """(start, end) of the segments of n samples."""
    out = [(s, s + length) for s in range(0, n - length + 1, hop)]
    following, covered = (out[-1][0] + hop, out[-1][1]) if out else (0, 0)
    return [*out, (following, following + length)] if pad_last and covered < n and following < n else out


def extract(x: np.ndarray, start: int, end: int) -> np.ndarray:
    part = x[:, start:end]
    return np.pad(part, ((0, 0), (0, end - start - part.shape[1])))


def frames(mono: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Whole frames, windowed; a shorter signal is one padded frame."""
    if len(mono) < frame:
        mono = np.pad(mono, (0, frame - len(mono)))
    return np.lib.stride_tricks.sliding_window_view(mono, frame)[::hop] * np.hanning(frame)


def spectra(mono: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    return np.abs(np.fft.rfft(frames(mono.astype(np.float64), frame, hop), axis=1))


def chroma(mono: np.ndarray, rate: int) -> np.ndarray:
    """(windows x 12): unit pitch-class profiles of each whole 5 seconds. The trailing part of a window, and a frame that
    would end exactly at the end, are left out; silent windows stay zero."""
    n = max(0, -(-(len(mono) - FRAME) // HOP))
    if n <= 0:
        return np.zeros((0, 12), np.float32)
    magnitude = spectra(mono[: (n - 1) * HOP + FRAME])
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    audible = (hertz >= 80) & (hertz <= 5000)
    classes = np.rint(69 + 12 * np.log2(hertz[audible] / A4)).astype(int) % 12
    profile = np.zeros((len(magnitude), 12))
    for c in range(12):
        profile[:, c] = magnitude[:, audible][:, classes == c].sum(axis=1)
    per = max(1, int(WINDOW_S * rate / HOP))
    whole = len(profile) // per
    sums = profile[: whole * per].reshape(whole, per, 12).sum(axis=1)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0).astype(np.float32)


def song_measures(x: np.ndarray, rate: int, silence: float = 1e-3) -> dict[str, float]:
    """Levels, silence, spectrum, stereo image and structure of a whole recording."""
    mono = x.mean(axis=0)
    hop = max(1, rate // 20)
    loud = np.array([np.sqrt((mono[i : i + hop].astype(np.float64) ** 2).mean()) for i in range(0, len(mono), hop)])
    quiet = loud < silence
    edges = np.flatnonzero(np.diff(np.concatenate([[0], quiet.astype(np.int8), [0]])))
    stretches = (edges[1::2] - edges[::2]) * hop / rate
    mags = spectra(mono, 2048, 1024)
    mean, hertz = mags.mean(axis=0) + 1e-12, np.fft.rfftfreq(2048, 1 / rate)
    energy = np.cumsum(mean**2)
    per_second = np.array([loud[i : i + 20].mean() for i in range(0, len(loud), 20)])
    unit = chroma(mono, rate)
    repeats = (unit @ unit.T)[np.triu_indices(len(unit), 1)] if len(unit) > 1 else np.zeros(0)
    left, right = x[0].astype(np.float64), x[-1].astype(np.float64)
    spread = left.std() * right.std()
    correlation = float(((left - left.mean()) * (right - right.mean())).mean() / spread) if spread > 0 else 1.0
    level = levels(x)
    return {
        "seconds": len(mono) / rate, "peak_dbfs": level["peak_dbfs"], "rms_dbfs": level["rms_dbfs"], "clipped_sample_ratio": level["clipping_ratio"], "dc": level["dc"],
        "silent_ratio": float(quiet.mean()), "longest_silence_seconds": float(stretches.max(initial=0)), "leading_silence_seconds": float(stretches[0]) if len(stretches) and quiet[0] else 0.0,
        "spectral_centroid_hz": float((hertz * mean).sum() / mean.sum()), "spectral_rolloff95_hz": float(hertz[np.searchsorted(energy, 0.95 * energy[-1])]),
        "spectral_flatness": float(np.exp(np.log(mean).mean()) / mean.mean()), "hf_ratio": float((mean[hertz > 8000] ** 2).sum() / energy[-1]),
        "stereo_correlation": correlation, "channels": float(len(x)), "repetition_score": float(repeats.mean()) if len(repeats) else 0.0, "energy_variation": float(per_second.std() / (per_second.mean() + 1e-12)),
    }


def centred_spectra(x: np.ndarray, n: int) -> np.ndarray:
    """Magnitudes (frames x bins) of frames of n samples every n / 4, centred on their place in the signal, which is mirrored
    at its ends (a shorter one is padded with zeros first), under a periodic Hann window."""
    x = np.pad(x.astype(np.float64), (0, max(0, n - len(x))))
    x = np.pad(x, n // 2, mode="reflect")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    return np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, n)[:: n // 4] * window, axis=1))


def character(mono: np.ndarray, rate: int, n: int = 1024) -> dict[str, float]:
    """The spectral features of a segment by which its character is scored; zeros for less than a frame."""
    x = mono.astype(np.float64)
    rms = float(np.sqrt((x * x).mean())) if len(x) else 0.0
    if len(x) < n:
        return {"low_band_ratio": 0.0, "high_band_ratio": 0.0, "spectral_flatness": 0.0, "spectral_flux": 0.0, "zero_crossing_rate": 0.0, "rms": rms}
    mags = centred_spectra(x, n)
    hertz, total = np.linspace(0, rate / 2, n // 2 + 1), max(mags.sum(), 1e-8)
    some = np.maximum(mags, 1e-10)
    flatness = np.exp(np.log(some).mean(axis=1)) / some.mean(axis=1)
    rises = np.maximum(np.diff(mags, axis=0), 0).sum(axis=1) / np.maximum(mags[1:].sum(axis=1), 1e-8)
    return {
        "low_band_ratio": float(mags[:, hertz < 250].sum() / total), "high_band_ratio": float(mags[:, hertz > 4000].sum() / total), "spectral_flatness": float(flatness.mean()),
        "spectral_flux": float(rises.mean()), "zero_crossing_rate": float((np.sign(x[1:]) != np.sign(x[:-1])).mean()), "rms": rms,
    }


def reconstruction(pred: np.ndarray, target: np.ndarray, rate: int = 24_000) -> dict[str, float]:
    """Spectral distances of two equally long signals: over three resolutions, convergence, log spectral distance (dB),
    correlation of onset envelopes, and the energy kept above 4 kHz (dB). Where a signal is shorter than every frame, the
    first two are the mean absolute difference."""
    p, t = pred.astype(np.float64), target.astype(np.float64)
    l1 = float(np.abs(p - t).mean())
    sizes = [n for n in (256, 512, 1024) if len(p) >= n]
    logs = [float(np.abs(np.log1p(centred_spectra(p, n)) - np.log1p(centred_spectra(t, n))).mean()) for n in sizes]
    a, b = centred_spectra(p, 1024), centred_spectra(t, 1024)
    decibels = 20 * (np.log10(np.maximum(a, 1e-8)) - np.log10(np.maximum(b, 1e-8)))
    onsets = [np.maximum(np.diff(m, axis=0), 0).sum(axis=1) for m in (a, b)]
    onsets = [o - o.mean() for o in onsets]
    high = np.linspace(0, rate / 2, 513) > 4000
    energy = lambda m: max(float((m[:, high] ** 2).sum()), 1e-12)
    return {
        "mr_stft": float(np.mean(logs)) if logs else l1,
        "spectral_convergence": float(np.linalg.norm(b - a) / max(np.linalg.norm(b), 1e-8)) if len(p) >= 1024 else l1,
        "log_spectral_distance": float(np.sqrt((decibels**2).mean())),
        "transient_correlation": float(onsets[0] @ onsets[1] / max(np.linalg.norm(onsets[0]) * np.linalg.norm(onsets[1]), 1e-8)) if len(a) >= 3 else 0.0,
        "high_frequency_db": float(10 * np.log10(energy(a) / energy(b))) if high.any() else 0.0,
    }


def _biquad(x: np.ndarray, b: tuple, a: tuple) -> np.ndarray:
    """A second-order filter, by the convolution with its impulse response (which dies out within the length used)."""
    n = min(x.shape[-1], 4096)
    h, z1, z2 = np.zeros(n), 0.0, 0.0
    for i in range(n):
        v = 1.0 if i == 0 else 0.0
        h[i] = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * h[i] + z2, b[2] * v - a[2] * h[i]
    size = 1 << (x.shape[-1] + n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[..., : x.shape[-1]]


#: The two filters of K weighting (shelf, high pass) at 48 kHz, used at every rate: fixed values.
K_WEIGHTING = [((1.53512485958697, -2.69169618940638, 1.19839281085285), (1.0, -1.69065929318241, 0.73248077421585)), ((1.0, -2.0, 1.0), (1.0, -1.99004745483398, 0.99007225036621))]


def loudness(x: np.ndarray) -> float:
    """K-weighted loudness (LUFS, ungated, exact at 48 kHz)."""
    y = x.astype(np.float64)
    for b, a in K_WEIGHTING:
        y = _biquad(y, b, a)
    return float(-0.691 + 10 * np.log10(max((y**2).mean(axis=1).sum(), 1e-12)))


def finish(x: np.ndarray, rate: int, target: float = -14.0, max_gain_db: float = 12.0, ceiling_db: float = -1.0, fade_in: float = 0.01, fade_out: float = 0.05) -> tuple[np.ndarray, dict[str, float]]:
    """Repaired, centred where it is off by more than 1e-4, brought to a loudness by a bounded gain, softly limited above
    98 % of the ceiling if it passes the ceiling at all, and faded; and what was done."""
    db = lambda v: float(20 * np.log10(max(v, 1e-12)))
    bad = ~np.isfinite(x)
    y = np.where(bad, 0, x).astype(np.float64)
    report = {"repaired": float(bad.sum()), "input_peak_db": db(np.abs(y).max(initial=0.0)), "dc_removed": 0.0}
    dc = float(y.mean()) if y.size else 0.0
    if abs(dc) > 1e-4:
        y -= y.mean(axis=1, keepdims=True)
        report["dc_removed"] = dc
    report["loudness_before"] = loudness(y)
    report["gain_db"] = float(np.clip(target - report["loudness_before"], -max_gain_db, max_gain_db))
    y *= 10 ** (report["gain_db"] / 20)
    ceiling, peak = 10 ** (ceiling_db / 20), float(np.abs(y).max(initial=0.0))
    knee, over = 0.98 * ceiling, np.zeros(y.shape, dtype=bool)
    if peak > ceiling:
        over = np.abs(y) > knee
        room = ceiling - knee
        y[over] = np.sign(y[over]) * (knee + room * np.tanh((np.abs(y[over]) - knee) / room))
    report["limited_ratio"], report["limiter_reduction_db"] = float(over.mean()), db(peak) - db(np.abs(y).max(initial=0.0)) if over.any() else 0.0
    for seconds, part in ((fade_in, slice(None)), (fade_out, slice(None, None, -1))):
        n = min(int(seconds * rate), y.shape[1] // 4)
        y[:, part][:, :n] *= np.linspace(0, 1, n)
    return y.astype(np.float32), report | {"output_peak_db": db(np.abs(y).max(initial=0.0)), "loudness_after": loudness(y)}
