"""The fixed schemas. A record keeps unknown keys in `extra`; unknown values are null, never guessed."""

from __future__ import annotations

PROVENANCE = "struct<dataset_id:string,dataset_name:string,role:string,source_url:string,citation_url:string,license_name:string,license_url:string,commercial_allowed:boolean,requires_user_acceptance:boolean,access_method:string>"

#: The segment manifest: one row for each segment of a recording.
SEGMENTS = (
    "id string, path string, split string, source string, license string, track_id string, singer_id string, tags array<string>, "
    "schema string, source_path string, segment_index int, start_sample long, num_samples int, sample_rate int, channels int, duration_seconds double, "
    "peak double, rms double, peak_dbfs double, rms_dbfs double, clipping_ratio double, silent boolean, stem_id string, instrument_name string, "
    f"instrument_family string, midi_program int, is_drum boolean, audio_sha256 string, source_sha256 string, provenance {PROVENANCE}, "
    "preprocessing map<string,string>, extra map<string,string>"
)

#: The corpus manifest: one row for each training item.
CORPUS = (
    "dataset string, track_id string, audio_path string, licence string, licence_class string, source_url string, split string, duplicate_hash string, "
    "caption string, lyrics string, instrument_tags array<string>, genre array<string>, bpm double, key string, artist string, language string, "
    "quality_score double, extra map<string,string>"
)


def names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names
