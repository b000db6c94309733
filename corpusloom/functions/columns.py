"""Derived columns of manifests and catalogues. All are built-in expressions, so they stay within code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"  # separates the parts of an id


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 over the parts. Null parts count as empty, so parts keep their places."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def hash_position(seed: int, mode: str, key: Column) -> Column:
    """A key's place in [0, 1): 64 bits of its SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:{mode}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def track_from_path(path: Column, root: str = "") -> Column:
    """The last `Track` directory; else the parent of a mix, audio or song file; else the path itself as a name."""
    numbered = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda p: p.rlike(r"^Track\d+$"))), -1)
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    relative = F.regexp_replace(path, f"^{root.rstrip('/')}/" if root else "^/", "")
    return F.when(numbered != "", numbered).when(F.lower(stem).isin("mix", "audio", "song") & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(F.replace(F.regexp_replace(relative, r"\.[^./]*$", ""), F.lit("/"), F.lit("__")))


def singer_from_path(path: Column) -> Column:
    """language__singer of language/singer/song/file; null for shorter paths."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 4, F.concat_ws("__", F.element_at(parts, -4), F.element_at(parts, -3)))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def normalize_tags(tags: Column) -> Column:
    """Stripped, lower case, blanks as underscores; no empty ones, distinct, sorted. Null gives an empty array."""
    clean = F.transform(tags, lambda t: F.replace(F.lower(strip(t)), F.lit(" "), F.lit("_")))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(clean, lambda t: t.isNotNull() & (t != "")))), F.array().cast("array<string>"))


def genre_ids(raw: Column) -> Column:
    """The whole numbers of a bracketed list."""
    inner = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^[\[\] ]+|[\[\] ]+$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda t: F.trim(t)), lambda t: t.rlike(r"^[0-9]+$"))


def number(raw: Column) -> Column:
    """A double; what isn't one is 0."""
    return F.coalesce(raw.try_cast("double") if raw is not None else F.lit(None), F.lit(0.0))


def value_score(genre_top: Column, n_fine: Column, language: Column, bit_rate: Column, duration: Column, listens: Column) -> Column:
    """The six parts of a track's value, and their sum rounded to 3 as `score`."""
    present = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    parts = {
        "has_genre_top": F.when(present(genre_top), 2.0).otherwise(0.0),
        "fine_genres": 0.5 * F.least(n_fine, F.lit(5)),
        "has_language": F.when(present(language), 1.0).otherwise(0.0),
        "bitrate": F.when(bit_rate >= 256_000, 2.0).when(bit_rate >= 192_000, 1.0).otherwise(0.0),
        "duration_sweet_spot": F.when(duration.between(60, 420), 1.0).otherwise(0.0),
        "popularity": F.least(F.log10(listens + 1), F.lit(2.0)),
    }
    total = reduce(lambda a, b: a + b, parts.values())
    return F.struct(*(v.alias(k) for k, v in parts.items()), F.round(total, 3).alias("score"))


def energy_band(rms: Column) -> Column:
    return F.when(rms < 0.08, "low").when(rms > 0.22, "high").otherwise("medium")


def catalogue_path(track_id: Column, suffix: str = "mp3") -> Column:
    """The folder of each thousand, and at least six digits of the id."""
    return F.when(track_id.isNotNull(), F.format_string("%03d/%06d.%s", F.floor(track_id / 1000), track_id.cast("long"), F.lit(suffix)))


def fingerprint(row: Column) -> Column:
    """16 hex digits over a struct's JSON (name its fields in order): stable within this library."""
    return F.substring(F.sha2(F.to_json(row), 256), 1, 16)


def compression(sample_rate: Column, hop: Column, codebooks: Column, codebook_size: Column, num_samples: Column) -> Column:
    """Frame rate, bits and ratio of a codec against 16-bit samples."""
    frames = F.ceil(num_samples / hop)
    bits = frames * codebooks * F.log2(codebook_size)
    return F.struct((sample_rate / hop).alias("frame_rate"), frames.alias("frames"), bits.alias("bits"), (bits / (num_samples / sample_rate)).alias("bits_per_second"), (num_samples * 16 / bits).alias("ratio"))


def group_key(mode: str, track: Column, singer: Column) -> Column:
    """What must not be split: the track, or the singer where one is known."""
    if mode not in ("song", "singer"):
        raise ValueError(f"unknown mode {mode!r}")
    return track if mode == "song" else F.coalesce(F.nullif(singer, F.lit("")), track)


def pick(bank: list[str], seed: int, slot: str, key: Column) -> Column:
    """An entry of a bank by the key's hash: reproducible, and independent of partitions."""
    place = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:{slot}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(len(bank)))
    return F.element_at(F.array(*map(F.lit, bank)), place.cast("int") + 1)
