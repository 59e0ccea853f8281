"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from sightline.sources import readers as S
from sightline.sources import writers as W
from sightline.sources.scratch import shared_folder


def put(tmp_path, name, value):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(p)


def test_object_and_mask_documents(spark, tmp_path):
    doc = {"P01-v": {"a1": {"name": "cup", "tracks": [{"track_id": "t1", "time_segment": [1.5, 2], "masks": ["m2", "m1"]}, {"track_id": "t2", "time_segment": [3, 4], "masks": []}]}}}
    objects, tracks, masks = S.object_tables(spark, put(tmp_path, "a.json", doc))
    assert [tuple(r) for r in objects.collect()] == [("P01-v", "a1", "cup")]
    assert sorted(tuple(r) for r in tracks.collect()) == [("P01-v", "a1", 0, "t1", 1.5, 2.0), ("P01-v", "a1", 1, "t2", 3.0, 4.0)]
    assert sorted(r.mask_id for r in masks.where("mask_pos = 0").collect()) == ["m2"]
    m = S.masks_table(spark, put(tmp_path, "m.json", {"P01-v": {"m1": {"frame_number": 7, "3d_location": None, "bbox": [1, 2, 3, 4], "fixture": "P01_bin.001"}}})).first()
    assert (m.mask_id, m.frame_number, m.xyz, m.fixture) == ("m1", 7, None, "P01_bin.001")


def test_lines_sounds_calibration_regions(spark, tmp_path):
    frames = '{"frame_index": 0, "T_world_device": [[1,0,0,5],[0,1,0,6],[0,0,1,7]], "gaze_direction_in_world": [0,0,1]}\n\n{"frame_index": 1, "T_world_device": null}\n'
    got = {r.frame_index: r.position for r in S.frame_poses(spark, put(tmp_path, "f.jsonl", frames)).collect()}
    assert tuple(got[0]) == (5, 6, 7) and got[1] is None
    s = S.sounds_table(spark, put(tmp_path, "s.csv", "video_id,class,start_timestamp,stop_timestamp\nv,click,00:01:02.5,01:00:00.0\n")).first()
    assert (s.start_sec, s.stop_sec) == (62.5, 3600.0)
    camera = {"image_size": [1408, 1408], "model_name": "FISHEYE624", "projection_params": [1.0] * 15, "T_device_camera": [[1, 0, 0, 0]] * 3, "valid_radius": 700}
    c = S.calibration(spark, put(tmp_path, "c.json", {"cameras": {"camera-rgb": camera}})).first()
    assert c.width == 1408 and len(c.device_from_camera) == 12
    with pytest.raises(Exception, match="wrong shape"):
        S.calibration(spark, put(tmp_path, "d.json", {"cameras": {"camera-rgb": camera | {"T_device_camera": [[1, 0]]}}})).collect()
    r = S.regions_table(spark, put(tmp_path, "r.json", {"P01": {"counter": {"counter.001": "left of the sink"}}})).first()
    assert tuple(r) == ("P01", "counter", "counter.001", "left of the sink")
    f = S.fixture_metadata(spark, put(tmp_path, "x.json", {"bin.001": {"fixture_type": "bin", "is_openable": True, "bbox_min": [0, 0, 0], "bbox_max": [1, 1, 1]}})).first()
    assert f.is_openable and f.bbox_max == [1, 1, 1]


def test_merged_samples_default_missing_arrays(spark, tmp_path):
    doc = {"a": {"name": "cup", "sampled_times_sec": [0.0, 1.0], "visible": [True], "status": ["in_view", "out_of_view"], "pixel": [[1, 2], None]}}
    rows = S.merged_samples(spark, put(tmp_path, "t.json", doc), "v").orderBy("i").collect()
    assert [(r.visible, r.stable, r.status, r.pixel, r.fixture) for r in rows] == [(True, False, "in_view", [1, 2], None), (False, False, "out_of_view", None, None)]


def test_mesh(spark, tmp_path):
    put(tmp_path, "m/a.obj", "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\n")
    put(tmp_path, "m/sub/b.obj", "# x\nv 5 5 5\nv 6 5 5\nv 5 6 5\nf 1 2 3\n")
    t = S.mesh_triangles(spark, str(tmp_path / "m"), F.lit("P01")).collect()
    assert len(t) == 3 and sorted(r.v0.x for r in t) == [0, 0, 5]


def test_manifest_and_paths(spark, tmp_path):
    md5 = "0" * 32
    lines = spark.createDataFrame([(f"{md5}  ./Videos/P01/x.mp4",), ("",)], "value string")
    assert [tuple(r) for r in S.manifest(lines).collect()] == [(md5, "Videos/P01/x.mp4")]
    assert S.allowed_entries(S.manifest(lines), ["Videos"], ["P02"]).count() == 0
    with pytest.raises(Exception, match="malformed"):
        S.manifest(spark.createDataFrame([("nonsense",)], "value string")).collect()
    files = spark.createDataFrame([("Videos/P01/x.mp4", bytearray(b"abc"))], "rel_path string, content binary")
    assert S.unfinished(S.manifest(lines), files).count() == 1
    paths = spark.createDataFrame([("P02/b/f",), ("P01/.x/f",), ("P01/a/f",), ("P01/a/g",)], "rel_path string")
    assert [tuple(r) for r in S.participant_videos(paths).collect()] == [("P01", "a"), ("P02", "b")]
    assert S.path_mapping(None, ["a", "b"], "/x/{video_id}.json") == {"a": "/x/a.json", "b": "/x/b.json"}
    with pytest.raises(ValueError):
        S.path_mapping("/x.json", ["a", "b"], "")
    config = S.Config.of({"data_root": "data", "output_root": "/out", "videos": ["P01-1"]}, "/etc/run")
    assert config.frames_path("P01-1") == "/etc/run/data/P01/P01-1/framewise_info.jsonl" and config.output_path("P01-1") == "/out/P01-1"
    assert S.resolve_videos([], ["P01"], ["z"], ["P01-1", "P02-1"]) == ["P01-1"] and S.resolve_videos([], [], ["z", "z"], []) == ["z"]
    first = put(tmp_path, "second.jsonl", '{"frame_index": 4}\n')
    assert S.first_readable(spark, [str(tmp_path / "none.jsonl"), first], S.FRAMES).first().frame_index == 4
    with pytest.raises(FileNotFoundError):
        S.first_readable(spark, [str(tmp_path / "none.jsonl")], S.FRAMES)


def png(pixels, colour, filters):
    """A PNG of rows of pixels (lists of channel values), each row filtered as asked."""
    import struct
    import zlib

    height, width, n = len(pixels), len(pixels[0]), len(pixels[0][0])
    raw, above = b"", [0] * (width * n)
    for row, kind in zip(pixels, filters, strict=True):
        flat = [v for p in row for v in p]
        out = []
        for i, v in enumerate(flat):
            left, up, corner = flat[i - n] if i >= n else 0, above[i], above[i - n] if i >= n else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            out.append((v - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
        raw += bytes([kind, *out])
        above = flat
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "n"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_lens_masks_are_decoded(spark, tmp_path, colour, n):
    import random

    rng = random.Random(colour)
    pixels = [[[rng.choice([0, 0, 7, 250]) for _ in range(n)] for _ in range(6)] for _ in range(5)]
    (tmp_path / "m.png").write_bytes(png(pixels, colour, [0, 1, 2, 3, 4]))
    files = spark.read.format("binaryFile").load(str(tmp_path / "m.png")).select("path", "content")
    m = S.lens_masks(files)
    row = m.first()
    want = [any(v > 0 for v in (p[:3] if n > 2 else p[:1])) for line in pixels for p in line]
    assert (row.width, row.height, row.invalid) == (6, 5, want)
    places = m.withColumn("u", F.explode(F.array(*(F.lit(x) for x in (-1.0, 0.4, 2.6, 5.0, 6.0)))))
    ok = {r.u: r.ok for r in places.select("u", S.pixel_is_valid(F.col("u"), F.lit(1.0), F.col("width"), F.col("height"), F.col("invalid")).alias("ok")).collect()}
    assert ok == {-1.0: False, 0.4: not want[6], 2.6: not want[9], 5.0: not want[11], 6.0: False}


def test_one_video_and_shared_folders(spark, tmp_path):
    doc = {"P01-v": {"a1": {"name": "cup", "tracks": [{"track_id": "t1", "time_segment": [1.5, 2], "masks": ["m1"]}]}}, "P02-w": {}}
    put(tmp_path, "assoc_info.json", doc)
    put(tmp_path, "mask_info.json", {"P01-v": {"m1": {"frame_number": 7, "3d_location": [1, 2, 3], "bbox": None, "fixture": "x"}}})
    put(tmp_path, "P01/P01-v/framewise_info.jsonl", '{"frame_index": 3, "T_world_device": null}\n')
    camera = {"image_size": [1408, 1408], "model_name": "FISHEYE624", "projection_params": [1.0] * 15, "T_device_camera": [[1, 0, 0, 0]] * 3, "valid_radius": 700}
    put(tmp_path, "P01/P01-v/calibration.json", {"cameras": {"camera-rgb": camera}})
    source = S.video_source(spark, S.Config(str(tmp_path), "out"), "P01-v", lines=False)
    assert {k: t.count() for k, t in source.items()} == {"objects": 1, "tracks": 1, "track_masks": 1, "masks": 1, "frames": 1, "calibration": 1}
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("v1", 'a"b', [1.0, 0.5]), ("v2", "c", [])], "video_id string, name string, xs array<double>")
    assert W.write_json_lines(df, str(tmp_path / "o")) == 2 and (tmp_path / "o" / "video_id=v1").is_dir()
    W.write_documents(df, "name", str(tmp_path / "d"))
    assert {k for r in spark.read.text(str(tmp_path / "d")).collect() for k in json.loads(r.value)} == {'a"b', "c"}
    W.write_yaml(df, "name", "xs", str(tmp_path / "y"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "y")).collect()) == ['"a\\"b": [1.000000, 0.500000]', '"c": []']
