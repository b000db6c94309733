"""The library's own data sources: headers by place, listings with empty files."""

import json

from corpusloom.sources import manifest

HEAD = ",track,track,artist\n,license,duration,name\ntrack_id,,,\n"


def test_a_data_row_equal_to_a_header_stays(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(HEAD + '1,CC0,60,"B, and\nC"\n,track,track,artist\n,license,duration,name\ntrack_id,,,\n2,CC0\n')
    rows = manifest.read_catalogue(spark, str(path))
    assert rows.columns == ["track_id", "track.license", "track.duration", "artist.name"]
    assert [tuple(r) for r in rows.collect()] == [("1", "CC0", "60", "B, and\nC"), (None, "track", "track", "artist"), (None, "license", "duration", "name"), ("track_id", None, None, None), ("2", "CC0", None, None)]
    assert [r["track_id"] for r in manifest.read_catalogue(spark, f"file:{path}", strict=True).collect()] == ["1", "2"]


def test_third_row_of_data_and_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(",a,a\n,x,y\n" + f"{k},1,{k}\n")
    (tmp_path / "_SUCCESS").write_text("")
    rows = manifest.read_catalogue(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3 and sorted(r["track_id"] for r in rows.collect()) == ["0", "1", "2"]


def test_empty_files_are_listed_in_order(spark, tmp_path):
    for name, data in (("b/2.wav", b"xy"), ("b/1.WAV", b""), ("a.wav", b"abc"), ("b/._1.wav", b"junk"), ("__MACOSX/1.wav", b"junk"), ("c.txt", b"no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = manifest.audio_tree(spark, str(tmp_path), [".wav"]).orderBy("place").collect()
    assert [(r["path"].removeprefix(f"{tmp_path}/"), r["length"], bytes(r["content"])) for r in rows] == [("a.wav", 3, b"abc"), ("b/1.WAV", 0, b""), ("b/2.wav", 2, b"xy")]
    assert [r["place"] for r in rows] == [0, 1, 2] and all(r["modificationTime"] for r in rows)
    small = spark.read.format("audio_tree").option("suffixes", ".wav").option("partitionBytes", 1).load(str(tmp_path))
    assert small.rdd.getNumPartitions() == 3 and sorted(r["place"] for r in small.collect()) == [0, 1, 2]


def test_prompt_file(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"defaults": {"seed": 7}, "prompts": [{"id": "x", "prompt": " a  b "}, {"id": "y", "prompt": "c", "seed": 1}]}))
    assert [(r["id"], r["prompt"], r["seed"]) for r in manifest.read_prompts(spark, str(path)).orderBy("id").collect()] == [("x", "a b", 7), ("y", "c", 1)]
