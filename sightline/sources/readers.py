"""Readers with explicit schemas: documents keyed by ids become rows, parallel arrays become samples."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import seconds_of
from .scratch import checkpointed

TRACK = "struct<track_id: string, time_segment: array<double>, masks: array<string>>"
OBJECTS = f"value map<string, map<string, struct<name: string, tracks: array<{TRACK}>>>>"
MASK = 'struct<frame_number: int, `3d_location`: array<double>, bbox: array<double>, fixture: string>'
MASKS = f"value map<string, map<string, {MASK}>>"
FRAMES = "frame_index int, T_world_device array<array<double>>, gaze_direction_in_world array<double>"
SOUNDS = "video_id string, class string, start_timestamp string, stop_timestamp string"
CAMERA = "struct<image_size: array<int>, model_name: string, projection_params: array<double>, T_device_camera: array<array<double>>, valid_radius: double>"
REGIONS = "value map<string, map<string, map<string, string>>>"
FIXTURES = "value map<string, struct<fixture_type: string, is_openable: boolean, bbox_min: array<double>, bbox_max: array<double>>>"
MERGED = (
    "value map<string, struct<name: string, sampled_times_sec: array<double>, visible: array<boolean>, stable: array<boolean>, status: array<string>, "
    "pixel: array<array<double>>, camera_xyz: array<array<double>>, frame_index: array<int>, fixture: array<string>, world_xyz: array<array<double>>, last_visible_index: array<int>>>"
)


def json_document(spark: SparkSession, path: str, schema: str, lines: bool = False, key: str | None = None) -> DataFrame:
    """A file that is one JSON map, as a column `value`: its ids stay keys and never become columns.

    One map is one row, and its file one task. lines: files that hold a map in each line, as writers.write_documents makes of a large
    map once; Spark splits them.

    key: what a map must have to be of use; texts that can't have it, as it neither stands in them nor may be spelt with escapes, are left out unparsed.
    """
    kind = schema.removeprefix("value ")
    text = spark.read.text(path, wholetext=not lines)
    if key is not None:
        text = text.where(F.contains("value", F.lit(key)) | F.contains("value", F.lit("\\")))
    return text.select(F.from_json("value", kind).alias("value"))


def entries(document: DataFrame, key: str, value: str) -> DataFrame:
    """A row for each entry of a document's map. Before `explode` the optimizer asks whether a map has entries at all, and parses each text once more for that; before `explode_outer` it doesn't."""
    return document.select(F.explode_outer("value").alias(key, value)).where(F.col(key).isNotNull())


def of_video(rows: DataFrame, video_id: str | None) -> DataFrame:
    return rows if video_id is None else rows.where(F.col("video_id") == video_id)


def object_tables(spark: SparkSession, path: str, lines: bool = False, video_id: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """objects, tracks and track_masks of a document of object tracks, with places in their lists; of one video if one is given."""
    flat = of_video(entries(json_document(spark, path, OBJECTS, lines, video_id), "video_id", "o"), video_id).select("video_id", F.explode("o").alias("assoc_id", "v"))
    objects = flat.select("video_id", "assoc_id", F.col("v.name").alias("name"))
    tracks = flat.select("video_id", "assoc_id", F.posexplode("v.tracks").alias("track_pos", "t"))
    masks = tracks.select("video_id", "assoc_id", "track_pos", F.posexplode("t.masks").alias("mask_pos", "mask_id"))
    return objects, tracks.select("video_id", "assoc_id", "track_pos", F.col("t.track_id").alias("track_id"), F.col("t.time_segment")[0].alias("start_sec"), F.col("t.time_segment")[1].alias("end_sec")), masks


def masks_table(spark: SparkSession, path: str, lines: bool = False, video_id: str | None = None) -> DataFrame:
    flat = of_video(entries(json_document(spark, path, MASKS, lines, video_id), "video_id", "m"), video_id).select("video_id", F.explode("m").alias("mask_id", "v"))
    return flat.select("video_id", "mask_id", "v.frame_number", F.col("v.3d_location").alias("xyz"), "v.bbox", "v.fixture")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def frame_poses(spark: SparkSession, path: str) -> DataFrame:
    """Frames with the pose as twelve numbers and the camera's position, its fourth column."""
    pose = F.flatten("T_world_device")
    at = F.when(F.size(pose) >= 12, F.struct(pose[3].alias("x"), pose[7].alias("y"), pose[11].alias("z")))
    return json_lines(spark, path, FRAMES).select("frame_index", pose.alias("world_from_device"), at.alias("position"), F.col("gaze_direction_in_world").alias("gaze"))


def sounds_table(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, schema=SOUNDS)
    return raw.select("video_id", "class", seconds_of(F.col("start_timestamp")).alias("start_sec"), seconds_of(F.col("stop_timestamp")).alias("stop_sec"))


def narrations_table(spark: SparkSession, path: str) -> DataFrame:
    """Narrations that were converted to Parquet; files that run code when they are read aren't."""
    return spark.read.parquet(path)


def calibration(spark: SparkSession, path: str, camera: str = "camera-rgb", lines: bool = False) -> DataFrame:
    """One camera of a calibration document; a transform that isn't three or four rows of four is refused."""
    found = json_document(spark, path, f"value struct<cameras: map<string, {CAMERA}>>", lines).select(F.col("value.cameras")[camera].alias("c"))
    t = F.col("c.T_device_camera")
    shape = F.size(t).isin(3, 4) & F.forall(t, lambda r: F.size(r) == 4)
    checked = F.when(shape, F.slice(F.flatten(t), 1, 12)).otherwise(F.raise_error(F.lit("the camera's transform has a wrong shape")).cast("array<double>"))
    return found.select(F.col("c.image_size")[0].alias("width"), F.col("c.image_size")[1].alias("height"), F.col("c.model_name").alias("model"), F.col("c.projection_params").alias("params"), checked.alias("device_from_camera"), "c.valid_radius")


def regions_table(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    one = entries(json_document(spark, path, REGIONS, lines), "participant", "a").select("participant", F.explode("a").alias("fixture_type", "b"))
    return one.select("participant", "fixture_type", F.explode("b").alias("fixture_id", "description"))


def fixture_metadata(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return entries(json_document(spark, path, FIXTURES, lines), "fixture_id", "v").select("fixture_id", "v.*")


def box_of_corners(corners: DataFrame, key: str = "fixture_id") -> DataFrame:
    """The axis-aligned box of each fixture's corners."""
    return corners.groupBy(key).agg(F.array(*(F.min(c) for c in "xyz")).alias("bbox_min"), F.array(*(F.max(c) for c in "xyz")).alias("bbox_max"))


def merged_samples(spark: SparkSession, path: str, video_id: str, lines: bool = False) -> DataFrame:
    """One row for each sample of a document of parallel arrays; an array that is missing or too short gives nulls, and flags false."""
    flat = entries(json_document(spark, path, MERGED, lines), "assoc_id", "v")
    names = ["visible", "stable", "status", "pixel", "camera_xyz", "frame_index", "fixture", "world_xyz", "last_visible_index"]
    out = flat.select("assoc_id", "v", F.posexplode("v.sampled_times_sec").alias("i", "time_sec"))
    cols = [F.get(F.col(f"v.{n}"), F.col("i")).alias(n) for n in names]
    cols[0], cols[1] = F.coalesce(cols[0], F.lit(False)).alias("visible"), F.coalesce(cols[1], F.lit(False)).alias("stable")
    return out.select(F.lit(video_id).alias("video_id"), "assoc_id", F.col("v.name").alias("name"), "i", "time_sec", *cols)


def mesh_triangles(spark: SparkSession, path: str, participant: Column, glob: str = "*.obj") -> DataFrame:
    """triangles(participant, path, face, part, v0, v1, v2) of the OBJ files under a path.

    Files are read in splits. A face names vertices by their number in the file, or back from its own line if negative, so each split counts its vertices and faces, the counts of a file's splits before it are added, and
    corners are then joined with vertices by file and number. A face of more corners is a fan of triangles, `part` of them; texture and normal numbers, other lines, and triangles with a vertex that isn't there are skipped.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.split(F.trim(F.regexp_replace("value", r"[\t\r]", " ")), " +").alias("_p"))
    rows = rows.where(F.col("_p")[0].isin("v", "f")).withColumn("_at", F.monotonically_increasing_id())
    vertex = F.col("_p")[0] == "v"
    within = Window.partitionBy("path", "_split").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    counted = checkpointed(rows.select("path", "_split", "_p", F.count_if(vertex).over(within).alias("_v"), F.count_if(~vertex).over(within).alias("_f")))
    before = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = counted.groupBy("path", "_split").agg(*(F.max(c).alias(c) for c in ("_v", "_f")))
    splits = splits.select("path", "_split", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_v", "_f")))
    placed = counted.join(splits, ["path", "_split"]).select("path", "_p", (F.col("_v") + F.col("_v0")).alias("n"), (F.col("_f") + F.col("_f0")).alias("face"))
    vertices = placed.where("_p[0] = 'v'").select("path", "n", F.struct(*(F.col("_p")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz"))).alias("_xyz"))
    number = lambda token: F.split(token, "/")[0].cast("long")
    fans = placed.where("_p[0] = 'f' and size(_p) > 3").select("path", "face", "n", "_p", F.explode(F.sequence(F.lit(2), F.size("_p") - 2)).alias("part"))
    corners = fans.select("path", "face", F.col("part") - 1, F.col("n").alias("_seen"), F.posexplode(F.array(F.col("_p")[1], F.get("_p", F.col("part")), F.get("_p", F.col("part") + 1))).alias("_corner", "_token")).toDF("path", "face", "part", "_seen", "_corner", "_token")
    corners = corners.withColumn("n", F.when(number(F.col("_token")) < 0, F.col("_seen") + 1 + number(F.col("_token"))).otherwise(number(F.col("_token"))))
    met = corners.join(vertices, ["path", "n"]).groupBy("path", "face", "part").agg(*(F.max(F.when(F.col("_corner") == i, F.col("_xyz"))).alias(f"v{i}") for i in range(3)))
    return met.where("v0 is not null and v1 is not null and v2 is not null").select(participant.alias("participant"), "path", "face", "part", "v0", "v1", "v2")


def decoded_png(content: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, nonzero) of an 8-bit PNG that isn't interlaced: nonzero tells for each pixel, row by row, whether any of its colours is over 0."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed = 8, b""
    while at + 8 <= len(content):
        length, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + length]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data)
            if depth != 8 or interlaced or colour not in (0, 2, 4, 6):
                raise ValueError("only 8-bit PNG without palette or interlacing is read")
        elif kind == b"IDAT":
            packed += data
        at += length + 12
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    above = np.zeros((width, channels), np.int64)
    out = np.empty((height, width), bool)
    for y in range(height):
        row = lines[y, 1:].reshape(width, channels).astype(np.int64)
        kind = lines[y, 0]
        if kind == 1:  # sums along the row
            row = np.cumsum(row, axis=0) & 255
        elif kind == 2:
            row = (row + above) & 255
        elif kind in (3, 4):
            left, corner = np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for x in range(width):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                row[x] = left = (row[x] + guess) & 255
                corner = up
        out[y] = (row[:, : 3 if channels > 2 else 1] > 0).any(1)
        above = row
    return width, height, out.ravel()


def lens_masks(files: DataFrame) -> DataFrame:
    """files(path, content) of PNG masks with width, height and `invalid`: a flag for each pixel, row by row, true where the mask isn't black."""

    @F.pandas_udf("width int, height int, invalid array<boolean>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(w, h, x.tolist()) for w, h, x in map(decoded_png, batch)], columns=["width", "height", "invalid"])

    return files.select("path", decode("content").alias("m")).select("path", "m.*")


def pixel_is_valid(u: Column, v: Column, width: Column, height: Column, invalid: Column) -> Column:
    """Whether the nearest pixel of a mask is valid; out of the image it isn't."""
    x, y = F.rint(u).cast("int"), F.rint(v).cast("int")
    inside = (x >= 0) & (y >= 0) & (x < width) & (y < height)
    return F.coalesce(inside & ~F.get(invalid, F.when(inside, y * width + x)), F.lit(False))


def video_source(spark: SparkSession, config: Config, video_id: str, lines: bool = True) -> dict[str, DataFrame]:
    """All of one video that a stage reads: objects, tracks, track_masks, masks, calibration and frames by their index; nothing is read before it is used."""
    objects, tracks, track_masks = object_tables(spark, f"{config.data_root}/assoc_info.json", lines, video_id)
    own = {"objects": objects, "tracks": tracks, "track_masks": track_masks, "masks": masks_table(spark, f"{config.data_root}/mask_info.json", lines, video_id)}
    frames = frame_poses(spark, config.frames_path(video_id)).where("frame_index is not null")
    return own | {"frames": frames, "calibration": calibration(spark, f"{config.data_root}/{video_id.split('-')[0]}/{video_id}/calibration.json", lines=lines)}


def frame_images(spark: SparkSession, path: str) -> DataFrame:
    """Extracted frames as bytes, with video_id and frame_index from video_id/frame.jpg."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video_id"), F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("int").alias("frame_index"), F.col("content").alias("image"))


def manifest(lines: DataFrame) -> DataFrame:
    """(md5, rel_path) of lines `md5 ./path`; blank lines are skipped and others raise."""
    m = F.regexp_extract("value", r"^\s*([0-9a-fA-F]{32})\s+\./(.+?)\s*$", 1)
    p = F.regexp_extract("value", r"^\s*([0-9a-fA-F]{32})\s+\./(.+?)\s*$", 2)
    bad = F.raise_error(F.concat(F.lit("malformed manifest line: "), F.col("value"))).cast("string")
    return lines.where(F.trim("value") != "").select(F.when(m != "", F.lower(m)).otherwise(bad).alias("md5"), p.alias("rel_path"))


def unfinished(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest's entries whose file is missing or has another checksum; files(rel_path, content)."""
    return wanted.join(files.select("rel_path", F.md5("content").alias("md5")), ["rel_path", "md5"], "left_anti")


def allowed_entries(entries: DataFrame, categories: Sequence[str], participants: Sequence[str]) -> DataFrame:
    """Entries of the categories and, if any are given, of the participants; an empty result raises when it is read."""
    parts = F.split("rel_path", "/")
    out = entries.where(parts[0].isin(*categories))
    return out.where(F.regexp_extract("rel_path", r"(P\d{2})", 1).isin(*participants)) if participants else out


def participant_videos(paths: DataFrame) -> DataFrame:
    """Distinct (participant, video_id) of paths participant/video_id/..., in order, without dotfiles."""
    parts = F.split("rel_path", "/")
    return paths.select(parts[0].alias("participant"), parts[1].alias("video_id")).where("video_id is not null and video_id not like '.%'").distinct().orderBy("participant", "video_id")


def first_readable(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """The first of the paths that exists, by Spark's own file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return json_lines(spark, p, schema)
    raise FileNotFoundError(f"none of {list(paths)} exists")


def path_mapping(value: None | str | Mapping[str, str], video_ids: Sequence[str], default: str) -> dict[str, str]:
    """A path for each video: from a mapping, a template with {video_id}, one path for all, or the default template."""
    if isinstance(value, Mapping):
        missing = [v for v in video_ids if v not in value]
        if missing:
            raise ValueError(f"no path for {missing}")
        return {v: value[v] for v in video_ids}
    template = value or default
    if "{video_id}" not in template and len(video_ids) > 1:
        raise ValueError("one path can't serve several videos")
    return {v: template.format(video_id=v) for v in video_ids}


@dataclass(frozen=True)
class Config:
    """Settings of a run; relative paths stand below the folder of the file that they come from."""

    data_root: str
    output_root: str
    video_fps: float = 30.0
    sampling_fps: float = 1.0
    detection_fps: float = 0.2
    videos: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, settings: Mapping, folder: str) -> Config:
        below = lambda p: p if "://" in p or p.startswith("/") else str(PurePosixPath(folder) / p)
        known = {k: settings[k] for k in cls.__dataclass_fields__ if k in settings}
        known |= {k: below(known[k]) for k in ("data_root", "output_root")}
        return cls(**known | {"videos": tuple(settings.get("videos", ()))})

    def frames_path(self, video_id: str) -> str:
        return f"{self.data_root}/{video_id.split('-')[0]}/{video_id}/framewise_info.jsonl"

    def video_path(self, video_id: str) -> str:
        return f"{self.data_root}/{video_id.split('-')[0]}/{video_id}.mp4"

    def output_path(self, video_id: str) -> str:
        return f"{self.output_root}/{video_id}"


def resolve_videos(cli: Sequence[str], participants: Sequence[str], configured: Sequence[str], known: Sequence[str]) -> list[str]:
    """Ids of the command line, else those of the participants, else the configured ones."""
    if cli:
        return list(dict.fromkeys(cli))
    if participants:
        return [v for v in known if v.split("-")[0] in set(participants)]
    return list(dict.fromkeys(configured))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Terms, one a line, lower-cased, each once."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).where("term <> ''").distinct()
