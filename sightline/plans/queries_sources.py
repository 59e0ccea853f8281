"""Queries of the sources and sinks: tables are written in a source's format to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import readers as S
from ..sources import writers as W
from ..sources.keyed_table import KeyedTable
from ..sources.scratch import shared_folder
from . import adapters as A
from .registry import query

c = F.col
OBJECT = "concat('a', cast(assoc_id as string))"


def one_line_each(rows, value, path):
    """A JSON map in each line."""
    rows.select(F.to_json(value).alias("value")).write.text(path)
    return path


def mask_document(m, video, path):
    """Masks by their ids in maps by video."""
    place = F.when(c("x").isNotNull(), F.array("x", "y", "z"))
    value = F.struct("frame_number", place.alias("3d_location"), F.lit(None).cast("array<double>").alias("bbox"), "fixture")
    W.write_maps(m, [video], F.concat_ws("/", c("track_id").cast("string"), c("frame_number").cast("string")), value, path)
    return path


@query("src1_src7_src20_object_documents", """
SELECT 'P0' || CAST(t.assoc_id % 4 + 1 AS VARCHAR) AS video_id, 'a' || CAST(t.assoc_id AS VARCHAR) AS assoc_id, CAST(t.track_pos AS BIGINT) AS track_pos, CAST(t.track_id AS VARCHAR) AS track_id, t.start_sec, t.end_sec, coalesce(m.n, 0) AS n_masks, m.first_mask
FROM tracks t LEFT JOIN (SELECT track_id, count(*) AS n, CAST(arg_min(frame_number, frame_number) AS VARCHAR) AS first_mask FROM masks GROUP BY track_id) m ON m.track_id = t.track_id""", A.TRACKS, A.MASKS)
def object_documents(spark, d):
    m = A.masks(spark, d).groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list("frame_number")), lambda x: x.cast("string")).alias("masks"))
    t = A.tracks(spark, d).join(m, "track_id", "left").withColumn("masks", F.coalesce("masks", F.array().cast("array<string>")))
    track = F.struct("track_pos", c("track_id").cast("string").alias("track_id"), F.array("start_sec", "end_sec").alias("time_segment"), "masks")
    per_object = t.groupBy("assoc_id").agg(F.sort_array(F.collect_list(track)).alias("tracks"))
    entry = F.create_map(F.expr(OBJECT), F.struct(F.concat(F.lit("object "), c("assoc_id").cast("string")).alias("name"), F.transform("tracks", lambda x: F.struct(x["track_id"].alias("track_id"), x["time_segment"].alias("time_segment"), x["masks"].alias("masks"))).alias("tracks")))
    video = F.concat(F.lit("P0"), (c("assoc_id") % 4 + 1).cast("string"))
    path = one_line_each(per_object, F.create_map(video, entry), shared_folder(spark, "objects"))
    _, tracks, masks = S.object_tables(spark, path, lines=True)
    counted = masks.groupBy("video_id", "assoc_id", "track_pos").agg(F.count("*").alias("n_masks"), F.min_by("mask_id", "mask_pos").alias("first_mask"))
    return tracks.join(counted, ["video_id", "assoc_id", "track_pos"], "left").select("video_id", "assoc_id", c("track_pos").cast("long"), "track_id", "start_sec", "end_sec", F.coalesce("n_masks", F.lit(0)).alias("n_masks"), "first_mask")


@query("src1_mask_documents", """
SELECT 'v' || CAST(track_id % 40 AS VARCHAR) AS video_id, CAST(track_id AS VARCHAR) || '/' || CAST(frame_number AS VARCHAR) AS mask_id, frame_number, x, z, fixture FROM masks""", A.MASKS)
def mask_documents(spark, d):
    path = mask_document(A.masks(spark, d), F.concat(F.lit("v"), (c("track_id") % 40).cast("string")), shared_folder(spark, "masks"))
    return S.masks_table(spark, path, lines=True).select("video_id", "mask_id", "frame_number", F.get("xyz", 0).alias("x"), F.get("xyz", 2).alias("z"), "fixture")


@query("src2_src3_src22_json_lines", "SELECT video_id, event_id, score, fixture, count(*) OVER () AS written FROM samples", A.SAMPLES)
def json_lines(spark, d):
    path = shared_folder(spark, "lines")
    n = W.write_json_lines(A.samples(spark, d).select("video_id", "event_id", "score", "fixture"), path)
    return S.json_lines(spark, path, "event_id long, score double, fixture string, video_id string").select("video_id", "event_id", "score", "fixture", F.lit(n).cast("long").alias("written"))


@query("src4_sound_table", "SELECT 'v' || CAST(assoc_id AS VARCHAR) AS video_id, status AS class, start_sec, end_sec AS stop_sec FROM spans WHERE end_sec IS NOT NULL", A.SPANS)
def sound_table(spark, d):
    clock = lambda t: F.format_string("%02d:%02d:%04.1f", F.floor(c(t) / 3600).cast("long"), F.floor(c(t) % 3600 / 60).cast("long"), c(t) % 60)
    path = shared_folder(spark, "sounds")
    s = A.spans(spark, d).where("end_sec is not null")
    s.select(F.concat(F.lit("v"), c("assoc_id").cast("string")).alias("video_id"), c("status").alias("class"), clock("start_sec").alias("start_timestamp"), clock("end_sec").alias("stop_timestamp")).write.csv(path, header=True)
    return S.sounds_table(spark, path)


@query("src5_narrations", "SELECT conv_id, turn, text FROM conversations")
def narrations(spark, d):
    path = shared_folder(spark, "narrations")
    A.read(spark, d, "conversations").select("conv_id", "turn", "text").write.parquet(path)
    return S.narrations_table(spark, path)


@query("src6_frame_poses", "SELECT vec_id AS frame_index, tx AS x, ty AS y, tz AS z, gx, c AS first_cell FROM points", A.POINTS)
def frame_poses(spark, d):
    p = A.points(spark, d)
    rows = F.array(*(F.slice("pose", i, 4) for i in (1, 5, 9)))
    value = F.struct(c("vec_id").alias("frame_index"), rows.alias("T_world_device"), F.array("gaze.x", "gaze.y", "gaze.z").alias("gaze_direction_in_world"))
    f = S.frame_poses(spark, one_line_each(p, value, shared_folder(spark, "frames")))
    return f.select(c("frame_index").cast("long"), "position.x", "position.y", "position.z", c("gaze")[0].alias("gx"), c("world_from_device")[0].alias("first_cell"))


@query("src13_src14_participant_videos", "SELECT DISTINCT 'P0' || CAST(user_id % 4 + 1 AS VARCHAR) AS participant, 'video-' || CAST(user_id AS VARCHAR) AS video_id FROM events")
def participant_videos(spark, d):
    e = A.read(spark, d, "events")
    return S.participant_videos(e.select(F.concat(F.lit("P0"), (c("user_id") % 4 + 1).cast("string"), F.lit("/video-"), c("user_id").cast("string"), F.lit("/frames.jsonl")).alias("rel_path")))


@query("src15_corner_boxes", "SELECT label, min(ax) AS x0, min(ay) AS y0, max(az) AS z1 FROM points GROUP BY label", A.POINTS)
def corner_boxes(spark, d):
    b = S.box_of_corners(A.points(spark, d).select("label", "a.x", "a.y", "a.z"), "label")
    return b.select("label", c("bbox_min")[0].alias("x0"), c("bbox_min")[1].alias("y0"), c("bbox_max")[2].alias("z1"))


@query("src16_region_map", "SELECT 'P' || CAST(p_size AS VARCHAR) AS participant, p_type AS fixture_type, CAST(p_partkey AS VARCHAR) AS fixture_id, p_name AS description FROM part")
def region_map(spark, d):
    path = shared_folder(spark, "regions")
    W.write_maps(A.read(spark, d, "part"), [F.concat(F.lit("P"), c("p_size").cast("string")), c("p_type")], c("p_partkey").cast("string"), c("p_name"), path)
    return S.regions_table(spark, path, lines=True)


@query("src17_src26_merged_tracks", """
SELECT 'a' || CAST(assoc_id AS VARCHAR) AS assoc_id, i, time_sec, in_view AS visible, false AS stable, status, fixture FROM samples""", A.SAMPLES)
def merged_documents(spark, d):
    """Parallel arrays of each object; those of stable flags are missing."""
    s = A.samples(spark, d).groupBy("assoc_id").agg(F.sort_array(F.collect_list(F.struct("i", "time_sec", "in_view", "status", "fixture"))).alias("all"))
    part = lambda f, name: F.transform("all", lambda x: x[f]).alias(name)
    value = F.create_map(F.expr(OBJECT), F.struct(F.lit("x").alias("name"), part("time_sec", "sampled_times_sec"), part("in_view", "visible"), part("status", "status"), part("fixture", "fixture")))
    path = one_line_each(s, value, shared_folder(spark, "merged"))
    return S.merged_samples(spark, path, "v", lines=True).select("assoc_id", c("i").cast("long"), "time_sec", "visible", "stable", "status", "fixture")


@query("src21_vocabulary", "SELECT DISTINCT lower(trim(p_type)) AS term FROM part")
def vocabulary(spark, d):
    path = shared_folder(spark, "terms")
    A.read(spark, d, "part").select(F.concat(F.lit(" "), F.upper("p_type")).alias("value")).write.text(path)
    return S.vocabulary(spark, path)


@query("src23_yaml_lines", """SELECT '"' || c_name || '": [' || printf('%.6f', CAST(c_acctbal AS DOUBLE)) || ', ' || printf('%.6f', CAST(c_nationkey AS DOUBLE)) || ']' AS value FROM customer""")
def yaml_lines(spark, d):
    path = shared_folder(spark, "yaml")
    rows = A.read(spark, d, "customer").select("c_name", F.array(c("c_acctbal").cast("double"), c("c_nationkey").cast("double")).alias("numbers"))
    W.write_yaml(rows, "c_name", "numbers", path)
    return spark.read.text(path)


@query("src24_src25_first_readable", "SELECT event_id, score FROM samples", A.SAMPLES)
def first_readable(spark, d):
    """The refined file isn't there, so the coarse one is read; paths come from a template."""
    root = shared_folder(spark, "fallback")
    coarse = S.path_mapping(None, ["v"], root + "/{video_id}/coarse")["v"]
    A.samples(spark, d).select("event_id", "score").write.json(coarse)
    return S.first_readable(spark, [S.path_mapping(root + "/{video_id}/refined", ["v"], "")["v"], coarse], "event_id long, score double")


@query("src27_calibration", """
SELECT CAST(1408 AS INTEGER) AS width, 'FISHEYE624' AS model, tx AS x, ty AS y FROM points""", A.POINTS)
def calibrations(spark, d):
    p = A.points(spark, d)
    camera = F.struct(
        F.array(F.lit(1408), F.lit(1408)).alias("image_size"), F.lit("FISHEYE624").alias("model_name"), F.array(*(F.lit(x) for x in A.LENS)).alias("projection_params"),
        F.array(*(F.slice("pose", i, 4) for i in (1, 5, 9))).alias("T_device_camera"), F.lit(700.0).alias("valid_radius"),
    )
    path = one_line_each(p, F.struct(F.create_map(F.lit("camera-rgb"), camera).alias("cameras")), shared_folder(spark, "calibration"))
    t = c("device_from_camera")
    return S.calibration(spark, path, lines=True).select("width", "model", t[3].alias("x"), t[7].alias("y"))


MANIFEST = "lines AS (SELECT page_id, 'pages/' || CAST(page_id AS VARCHAR) || '.html' AS rel_path, md5(CASE WHEN page_id % 3 = 0 THEN 'other' ELSE coalesce(url, '') END) AS found, md5(coalesce(url, '')) AS md5 FROM pages)"


@query("src18_src19_unfinished", "SELECT md5, rel_path FROM lines WHERE found <> md5", MANIFEST)
def unfinished(spark, d):
    """Entries of a manifest whose content has another checksum; a third of the files hold something else."""
    p = A.read(spark, d, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.concat(F.lit("pages/"), c("page_id").cast("string"), F.lit(".html")).alias("rel_path"))
    wanted = S.manifest(p.select(F.concat(F.md5("url"), F.lit("  ./"), c("rel_path")).alias("value")))
    files = p.select("rel_path", F.when(c("page_id") % 3 == 0, "other").otherwise(c("url")).cast("binary").alias("content"))
    return S.unfinished(wanted, files).select("md5", "rel_path")


@query("flt15_allowed_entries", "SELECT md5, rel_path FROM (SELECT md5(p_name) AS md5, p_type || '/P' || printf('%02d', p_size) || '/' || CAST(p_partkey AS VARCHAR) AS rel_path, p_type, p_size FROM part) WHERE p_type IN (SELECT min(p_type) FROM part) AND p_size IN (7, 21)")
def allowed_entries(spark, d):
    p = A.read(spark, d, "part")
    first = p.agg(F.min("p_type")).first()[0]
    rel = F.format_string("%s/P%02d/%s", "p_type", "p_size", c("p_partkey").cast("string"))
    return S.allowed_entries(p.select(F.md5("p_name").alias("md5"), rel.alias("rel_path")), [first], ["P07", "P21"])


MESH_VERTICES = """v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, count(*) OVER (PARTITION BY label) AS total, round_even(ax * 1000, 0) AS x, round_even(ay * 1000, 0) AS y, round_even(az * 1000, 0) AS z FROM points)"""


@query("src10_mesh_triangles", """
SELECT CAST(a.label AS VARCHAR) AS participant, a.n AS face, k.part, a.x + 0 AS x0, b.y + 0 AS y1, d.z + 0 AS z2
FROM v a, (VALUES (1), (2)) k(part), v b, v d WHERE a.n + 3 <= a.total AND b.label = a.label AND d.label = a.label AND b.n = a.n + k.part AND d.n = a.n + k.part + 1""", A.POINTS, MESH_VERTICES)
def mesh_triangles(spark, d):
    """A mesh for each label: its places as vertices in thousandths, and a face of four corners from each on, by numbers from the file's start, with texture numbers, or back from its end."""
    p = A.points(spark, d)
    w = Window.partitionBy("label")
    n, total = F.row_number().over(w.orderBy("vec_id")), F.count("*").over(w)
    v = p.select("label", n.alias("n"), total.alias("total"), *(F.rint(c("a")[x] * 1000).cast("long").cast("string").alias(x) for x in "xyz"))
    corner = lambda i: F.when(c("n") % 3 == 0, (c("n") + i - c("total") - 1).cast("string")).when(c("n") % 3 == 1, F.concat((c("n") + i).cast("string"), F.lit("/1/1"))).otherwise((c("n") + i).cast("string"))
    lines = v.select("label", F.lit(0).alias("kind"), "n", F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    faces = v.where("n + 3 <= total").select("label", F.lit(1).alias("kind"), "n", F.concat_ws(" ", F.lit("f"), *(corner(i) for i in range(4))).alias("value"))
    path = shared_folder(spark, "meshes")
    lines.unionByName(faces).repartition("label").sortWithinPartitions("label", "kind", "n").select("label", "value").write.partitionBy("label").text(path)
    t = S.mesh_triangles(spark, path, F.regexp_extract("path", "label=(-?[0-9]+)", 1), "*.txt")
    return t.select("participant", "face", c("part").alias("part"), c("v0.x").alias("x0"), c("v1.y").alias("y1"), c("v2.z").alias("z2"))


@query("src20_qst20_upserted_twice", """
SELECT k AS event_id, CASE WHEN s.doc_id IS NOT NULL THEN 'toxic' WHEN f.doc_id IS NOT NULL THEN 'quality ' || f.quality ELSE 'unscored' END AS score, CASE WHEN s.doc_id IS NOT NULL THEN 2 WHEN f.doc_id IS NOT NULL THEN 1 ELSE 0 END AS scored_at
FROM (SELECT event_id AS k FROM events UNION SELECT doc_id FROM labels UNION SELECT -doc_id - 1 FROM labels WHERE toxic = 1) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) f ON f.doc_id = k
LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT -doc_id - 1 FROM labels WHERE toxic = 1) s ON s.doc_id = k""")
def upserted_twice(spark, d):
    """Verdicts of all events, in the place of which two rounds put others; some have new keys."""
    table = KeyedTable(shared_folder(spark, "verdicts"), "event_id", 32)
    entry = lambda rows, key, score, at: rows.select(key.alias("event_id"), score.alias("score"), F.lit(at).alias("scored_at"))
    table.write(entry(A.read(spark, d, "events"), c("event_id"), F.lit("unscored"), 0), ["scored_at"])
    labels = A.read(spark, d, "labels")
    table.upsert(entry(labels, c("doc_id"), F.concat(F.lit("quality "), c("quality").cast("string")), 1), ["score"])
    toxic = labels.where("toxic = 1")
    table.upsert(entry(toxic, c("doc_id"), F.lit("toxic"), 2).unionByName(entry(toxic, -c("doc_id") - 1, F.lit("toxic"), 2)), ["score"])
    return table.read(spark)


@query("src7_video_source", """
SELECT 'objects' AS what, count(DISTINCT assoc_id) AS n FROM tracks WHERE assoc_id % 4 = 1 UNION ALL SELECT 'tracks', count(*) FROM tracks WHERE assoc_id % 4 = 1
UNION ALL SELECT 'track_masks', count(*) FROM tracks JOIN masks USING (track_id) WHERE assoc_id % 4 = 1 UNION ALL SELECT 'masks', count(*) FROM masks WHERE track_id % 4 = 1 UNION ALL SELECT 'frames', count(*) FROM points UNION ALL SELECT 'calibration', 1""", A.TRACKS, A.MASKS, A.POINTS)
def video_source(spark, d):
    """All documents of all videos are written, and what one of them consists of is read; each table is counted."""
    root, video = shared_folder(spark, "videos"), lambda k: F.concat(F.lit("P0"), (k % 4 + 1).cast("string"), F.lit("-v"))
    config = S.Config(data_root=root, output_root=root)
    m = A.masks(spark, d)
    listed = m.groupBy("track_id").agg(F.sort_array(F.collect_list(F.concat_ws("/", c("track_id").cast("string"), c("frame_number").cast("string")))).alias("masks"))
    t = A.tracks(spark, d).join(listed, "track_id", "left").withColumn("masks", F.coalesce("masks", F.array().cast("array<string>")))
    track = F.struct("track_pos", c("track_id").cast("string").alias("track_id"), F.array("start_sec", "end_sec").alias("time_segment"), "masks")
    objects = t.groupBy("assoc_id").agg(F.sort_array(F.collect_list(track)).alias("tracks"))
    entry = F.struct(F.concat(F.lit("object "), c("assoc_id").cast("string")).alias("name"), F.transform("tracks", lambda x: x.dropFields("track_pos")).alias("tracks"))
    one_line_each(objects, F.create_map(video(c("assoc_id")), F.create_map(F.expr(OBJECT), entry)), f"{root}/assoc_info.json")
    mask_document(m, video(c("track_id")), f"{root}/mask_info.json")
    p = A.points(spark, d)
    rows = F.array(*(F.slice("pose", i, 4) for i in (1, 5, 9)))
    one_line_each(p, F.struct(c("vec_id").alias("frame_index"), rows.alias("T_world_device"), F.array("gaze.x", "gaze.y", "gaze.z").alias("gaze_direction_in_world")), config.frames_path("P02-v"))
    camera = F.struct(F.array(F.lit(1408), F.lit(1408)).alias("image_size"), F.lit("FISHEYE624").alias("model_name"), F.array(*(F.lit(x) for x in A.LENS)).alias("projection_params"), F.array(*(F.lit([1.0, 0.0, 0.0, 0.0]) for _ in range(3))).alias("T_device_camera"), F.lit(700.0).alias("valid_radius"))
    one_line_each(spark.range(1), F.struct(F.create_map(F.lit("camera-rgb"), camera).alias("cameras")), f"{root}/P02/P02-v/calibration.json")
    out = None
    for name, rows in S.video_source(spark, config, "P02-v").items():
        counted = rows.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out
