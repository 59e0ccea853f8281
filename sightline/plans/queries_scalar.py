"""Queries of the scalar operators: geometry, predicates, names, sets and seeded choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names as N
from ..operators import rank as R
from ..operators import rays, sets
from . import adapters as A
from .registry import query

c = F.col


def r6(x, name):
    return F.round(x, 6).alias(name)


@query("geo5_geo15_project_fisheye", """
SELECT vec_id, CASE WHEN cz > 1e-9 THEN round(600.0 * (x + (2 * x * x + rr) * 0.001 + 2 * x * y * -0.002 + 0.0005 * rr + 0.0001 * rr * rr) + 704.0, 4) END AS u,
  CASE WHEN cz > 1e-9 THEN round(600.0 * (y + (2 * y * y + rr) * -0.002 + 2 * x * y * 0.001 + -0.0003 * rr + 0.0002 * rr * rr) + 704.0, 4) END AS v FROM (
  SELECT *, x * x + y * y AS rr FROM (SELECT *, a * s0 AS x, b * s0 AS y FROM (
    SELECT *, th * (1 + 0.1 * th * th - 0.05 * th * th * th * th + 0.01 * th * th * th * th * th * th) / r AS s0 FROM (SELECT *, sqrt(a * a + b * b) AS r, atan(sqrt(a * a + b * b)) AS th FROM (SELECT *, cx / cz AS a, cy / cz AS b FROM points)))))""", A.POINTS)
def project(spark, d):
    p = G.project_fisheye(c("camera"), A.LENS)
    return A.points(spark, d).select("vec_id", F.round(p["u"], 4).alias("u"), F.round(p["v"], 4).alias("v"))


@query("geo1_geo2_geo3_geo4_geo6_geo7_pose_compose_invert", """
SELECT vec_id, round(c * ax + s * az + tx, 6) AS wx, round(ay + ty, 6) AS wy, round(-s * ax + c * az + tz, 6) AS wz, round(-(c * tx - s * tz), 6) AS ox, round(-ty, 6) AS oy, round(-(s * tx + c * tz), 6) AS oz, round(ax, 6) AS back, 16 AS cells FROM points""", A.POINTS)
def pose(spark, d):
    p = A.points(spark, d)
    w, o = G.transform(c("pose"), c("a")), G.camera_position(c("pose"))
    back = G.transform(G.compose(G.invert(c("pose")), c("pose")), c("a"))
    return p.select("vec_id", r6(w["x"], "wx"), r6(w["y"], "wy"), r6(w["z"], "wz"), r6(o["x"], "ox"), r6(o["y"], "oy"), r6(o["z"], "oz"), r6(back["x"], "back"), F.size(G.to_4x4(c("pose"))).alias("cells"))


DISTANCE = "sqrt((ax - qx) * (ax - qx) + (ay - qy) * (ay - qy) + (az - qz) * (az - qz))"


@query("geo11_geo12_geo13_geo18_gaze_and_distance", f"""
SELECT vec_id, round({DISTANCE}, 6) AS d, CASE WHEN {DISTANCE} < 1.0 THEN 'close' WHEN {DISTANCE} < 1.5 THEN 'medium' ELSE 'far' END AS bucket, round(exp(-{DISTANCE} / 1.5), 6) AS near,
  round((gx * (qx - ax) + gy * (qy - ay) + gz * (qz - az)) / (sqrt(gx * gx + gy * gy + gz * gz) * {DISTANCE}), 6) AS cosine FROM points""", A.POINTS)
def gaze(spark, d):
    dist = G.distance(c("a"), c("b"))
    return A.points(spark, d).select("vec_id", r6(dist, "d"), G.distance_bucket(dist).alias("bucket"), r6(G.proximity(dist), "near"), r6(G.gaze_cosine(c("gaze"), c("a"), c("b")), "cosine"))


@query("geo16_geo17_qst5_qst6_anchored_quadrant", """
SELECT vec_id, round(x, 6) AS x, round(z, 6) AS z, CASE WHEN abs(z) >= 0.05 AND abs(x) >= 0.05 AND abs(abs(degrees(atan2(x, z))) - 90) >= 5 THEN (CASE WHEN z > 0 THEN 'Front' ELSE 'Back' END) || (CASE WHEN x > 0 THEN '-right' ELSE '-left' END) END AS quadrant,
  CASE WHEN abs(z) < 0.05 THEN 'z' WHEN abs(x) < 0.05 THEN 'x' WHEN abs(abs(degrees(atan2(x, z))) - 90) < 5 THEN 'angle' END AS rejected
FROM (SELECT vec_id, c * (ax - qx) + s * (az - qz) AS x, -s * (ax - qx) + c * (az - qz) AS z FROM points)""", A.POINTS)
def quadrants(spark, d):
    v = G.anchored(c("pose"), c("a"), c("b"))
    return A.points(spark, d).select("vec_id", v.alias("v")).select("vec_id", r6(c("v.x"), "x"), r6(c("v.z"), "z"), G.quadrant(c("v")).alias("quadrant"), G.quadrant_rejection(c("v")).alias("rejected"))


AXIS = "CASE {i} WHEN 0 THEN CASE WHEN {v} > 0 THEN 'to the right' ELSE 'to the left' END WHEN 1 THEN CASE WHEN {v} > 0 THEN 'above' ELSE 'below' END ELSE CASE WHEN {v} > 0 THEN 'in front of' ELSE 'behind' END END"


@query("geo19_dominant_axis_label", f"""
SELECT vec_id, CASE WHEN abs(ay) >= abs(ax) AND abs(ay) >= abs(az) THEN CASE WHEN ay > 0 THEN 'above' ELSE 'below' END WHEN abs(ax) >= abs(az) THEN CASE WHEN ax > 0 THEN 'to the right' ELSE 'to the left' END ELSE CASE WHEN az > 0 THEN 'in front of' ELSE 'behind' END END AS label,
  CASE WHEN abs(o[1].m) > 1e-12 AND abs(degrees(atan(abs(o[2].v) / abs(o[1].v))) - 45) <= 10 + 1e-12 THEN {AXIS.format(i='o[2].i', v='o[2].v')} END AS second
FROM (SELECT *, list_sort([{{'m': -abs(ax), 'i': 0, 'v': ax}}, {{'m': -abs(ay), 'i': 1, 'v': ay}}, {{'m': -abs(az), 'i': 2, 'v': az}}]) AS o FROM points)""", A.POINTS)
def axis(spark, d):
    return A.points(spark, d).select("vec_id", G.dominant_axis(c("a")).alias("label"), G.second_axis(c("a")).alias("second"))


HEADING = "degrees(atan2(0.0, -s))"
DELTA = "degrees(atan2(ax * qz - az * qx, ax * qx + az * qz))"


@query("geo20_geo21_geo22_geo23_geo24_flt20_turns", f"""
SELECT vec_id, round({HEADING}, 6) AS heading, round({DELTA}, 6) AS delta, CASE WHEN abs({DELTA}) < 8 THEN 'no significant rotation' ELSE (CASE WHEN {DELTA} > 0 THEN 'left' ELSE 'right' END) || (CASE WHEN abs({DELTA}) < 15 THEN ', about 10 degrees' ELSE ', about 20 degrees' END) END AS rotation,
  CASE WHEN abs({DELTA}) < 8 THEN 'no significant rotation' WHEN {DELTA} > 0 THEN 'left' ELSE 'right' END AS side, CASE WHEN abs({DELTA}) <= 15 THEN 'none' WHEN abs({DELTA}) >= 135 THEN 'back' WHEN {DELTA} > 0 THEN 'left' ELSE 'right' END AS turn,
  CASE WHEN az < 0 AND degrees(atan2(abs(ax), az)) >= 45 THEN 'behind' WHEN ax < 0 THEN 'left' ELSE 'right' END AS bearing,
  abs(abs({DELTA}) - 8) >= 2 AND abs(abs({DELTA}) - 15) >= 2 AND abs(abs({DELTA}) - 25) >= 2 AS clear, CASE WHEN abs(mod(vec_id * 7, 720) - 360) = 180 THEN 180.0 ELSE round(mod(vec_id * 7, 720) - 360 - 360 * floor((mod(vec_id * 7, 720) - 360 + 180) / 360.0), 6) END AS wrapped FROM points""", A.POINTS)
def turns(spark, d):
    delta = G.yaw_delta(c("a.x"), c("a.z"), c("b.x"), c("b.z"))
    p = A.points(spark, d).withColumn("delta", delta)
    w = G.wrapped((c("vec_id") * 7 % 720 - 360).cast("double"))
    return p.select(
        "vec_id", r6(G.heading(c("pose")), "heading"), r6(c("delta"), "d"), G.rotation_label(c("delta")).alias("rotation"), G.side_label(c("delta")).alias("side"), G.turn_label(c("delta")).alias("turn"),
        G.bearing_label(c("a.x"), c("a.z")).alias("bearing"), G.off_boundaries(c("delta")).alias("clear"), r6(w, "wrapped"),
    ).withColumnRenamed("d", "delta")


@query("flt5_flt6_geo25_jn27_containment", """
SELECT vec_id, i0 AS strict, i3 AS loose, CASE WHEN label % 2 = 0 THEN 'not_applicable' WHEN i0 THEN 'inside_strict' WHEN i3 THEN 'inside_loose' ELSE 'outside' END AS state,
  round(CASE WHEN i0 THEN least(least(ax + 0.2, 0.3 - ax) / 0.5, least(ay + 0.3, 0.2 - ay) / 0.5, least(az + 0.25, 0.25 - az) / 0.5)
    ELSE -greatest(greatest(-0.2 - ax, ax - 0.3, 0.0) / 0.5, greatest(-0.3 - ay, ay - 0.2, 0.0) / 0.5, greatest(-0.25 - az, az - 0.25, 0.0) / 0.5) END, 6) AS score
FROM (SELECT *, ax BETWEEN -0.2 AND 0.3 AND ay BETWEEN -0.3 AND 0.2 AND az BETWEEN -0.25 AND 0.25 AS i0, ax BETWEEN -0.23 AND 0.33 AND ay BETWEEN -0.33 AND 0.23 AND az BETWEEN -0.28 AND 0.28 AS i3 FROM points)""", A.POINTS)
def containment(spark, d):
    low, high = F.array(F.lit(-0.2), F.lit(-0.3), F.lit(-0.25)), F.array(F.lit(0.3), F.lit(0.2), F.lit(0.25))
    p = A.points(spark, d).select("vec_id", "label", "a", G.inside_box(c("a"), low, high).alias("strict"), G.inside_box(c("a"), low, high, G.LOOSE_MARGIN).alias("loose"), r6(G.containment_score(c("a"), low, high), "score"))
    return p.select("vec_id", "strict", "loose", G.containment(c("label") % 2 != 0, c("strict"), c("loose")).alias("state"), "score")


@query("flt2_flt3_flt4_src9_geo14_geo30_pixels", """
SELECT vec_id, u >= 0 AND u < 1408 AND v >= 0 AND v < 1408 AS inside, u >= 140.8 AND u <= 1267.2 AND v >= 140.8 AND v <= 1267.2 AS margin, round(u / 1408.0, 6) AS nu, round(v / 1408.0, 6) AS nv, round(u * 640 / 1408.0, 6) AS ru,
  round_even(u, 0) >= 0 AND round_even(u, 0) < 1408 AND round_even(v, 0) >= 0 AND round_even(v, 0) < 1408 AND (round_even(u, 0) - 703.5) * (round_even(u, 0) - 703.5) + (round_even(v, 0) - 703.5) * (round_even(v, 0) - 703.5) <= 700.0 * 700.0 AS valid FROM points""", A.POINTS)
def pixels(spark, d):
    px = c("pixel")
    n = G.normalised_pixel(px)
    return A.points(spark, d).select(
        "vec_id", G.in_image(px, 1408, 1408).alias("inside"), G.inside_margin(px, 1408.0, 1408.0).alias("margin"), r6(n["u"], "nu"), r6(n["v"], "nv"),
        r6(G.rescaled_pixel(px, 1408.0, 1408.0, 640, 640)["u"], "ru"), G.in_valid_circle(px, 1408, 1408, 700.0).alias("valid"),
    )


@query("geo26_geo27_geo28_geo29_regions", """
SELECT vec_id, greatest(0, least(1408, cu - h)) AS x1, greatest(0, least(1408, cu + h)) AS x2, greatest(0, greatest(0, least(1408, cu + h)) - greatest(0, least(1408, cu - h))) * greatest(0, greatest(0, least(1408, cv + h)) - greatest(0, least(1408, cv - h))) AS area,
  round(greatest(0.0, 1 - abs(u - 704) / 300.0), 6) AS centre, round(exp(-abs(ln(1.0 + label)) / 1.2), 6) AS size FROM (
  SELECT *, CAST(round_even(u, 0) AS INTEGER) AS cu, CAST(round_even(v, 0) AS INTEGER) AS cv, CAST(trunc(0.5 * 1.5 * (label * 10 + 5) + 40) AS INTEGER) AS h FROM points)""", A.POINTS)
def regions(spark, d):
    box = G.region_around(c("pixel"), (c("label") * 10 + 5).cast("double"), 1.5, F.lit(40), 1408, 1408)
    return A.points(spark, d).withColumn("r", box).select("vec_id", c("r.x1"), c("r.x2"), G.box_area(c("r")).alias("area"), r6(G.centre_score(F.abs(c("pixel.u") - 704), F.lit(300.0)), "centre"), r6(G.size_score(1.0 + c("label")), "size"))


@query("geo9_sample_pixels", "SELECT vec_id, unnest([u, u - 10, u + 10, u + 10, u - 10, u, u + 10, u, u - 10]) AS su, unnest([v, v - 8, v - 8, v + 8, v + 8, v - 8, v, v + 8, v]) AS sv FROM points", A.POINTS)
def sample_pixels(spark, d):
    u, v = c("pixel.u"), c("pixel.v")
    p = A.points(spark, d).select("vec_id", u.alias("u"), v.alias("v"))
    out = p.select("vec_id", "u", "v", F.posexplode(G.sample_pixels((c("u") - 10, c("v") - 8, c("u") + 10, c("v") + 8))).alias("i", "s"))
    return out.select("vec_id", F.when(c("i") == 0, c("u")).when(c("i").isin(5, 7), c("u")).otherwise(c("s.u")).alias("su"), F.when(c("i").isin(0, 6, 8), c("v")).otherwise(c("s.v")).alias("sv"))


@query("geo31_disagreement", "SELECT event_id, CASE WHEN status IN ('in_view', 'observed_visible_in_open_fixture') THEN 1 - k / 100.0 WHEN status IN ('occluded_inside_closed_fixture', 'geometrically_occluded') THEN k / 100.0 END AS disagreement FROM samples", A.SAMPLES)
def disagreements(spark, d):
    from ..functions.statuses import claim

    return A.samples(spark, d).select("event_id", G.disagreement(claim(c("status")), c("k") / F.lit(100.0)).alias("disagreement"))


@query("geo8_geo10_unproject_round_trip", "SELECT vec_id, CAST(0 AS DOUBLE) AS error, round(c * cx + s * cz + tx, 4) AS wx FROM points WHERE cz > 1e-9", A.POINTS)
def unproject(spark, d):
    """Pixels of the fisheye model turned into directions and projected again: the distance is about 0 wherever the model can be inverted."""
    p = A.points(spark, d).withColumn("px", G.project_fisheye(c("camera"), A.LENS)).where("px is not null")
    back = p.withColumn("dir", rays.pixel_directions(A.LENS)(c("px.u"), c("px.v")))
    world = rays.back_projected(c("dir"), c("camera.z"), c("pose"))
    again = G.project_fisheye(c("dir"), A.LENS)
    return back.select("vec_id", F.round(F.greatest(F.abs(again["u"] - c("px.u")), F.abs(again["v"] - c("px.v"))), 3).alias("error"), F.round(world["x"], 4).alias("wx"))


RAYS = """r AS (SELECT label % 2 AS scene, vec_id AS key, ax AS ox, ay AS oy, az AS oz, cx - ax AS wx, cy - ay AS wy, cz - az AS wz, sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay) + (cz - az) * (cz - az)) AS len FROM points),
ray AS (SELECT scene, key, ox, oy, oz, wx / len AS wx, wy / len AS wy, wz / len AS wz, len FROM r WHERE len >= 1e-6),
tri AS (SELECT label % 2 AS scene, qx AS x0, qy AS y0, qz AS z0, gx - qx AS ax, gy - qy AS ay, gz - qz AS az, gx AS bx, gy AS by_, gz AS bz FROM points),
met AS (SELECT ray.*, t.ax AS e1x, t.ay AS e1y, t.az AS e1z, t.bx AS e2x, t.by_ AS e2y, t.bz AS e2z, ox - x0 AS tx, oy - y0 AS ty, oz - z0 AS tz FROM ray JOIN tri t USING (scene)),
p AS (SELECT *, wy * e2z - wz * e2y AS px, wz * e2x - wx * e2z AS py, wx * e2y - wy * e2x AS pz, ty * e1z - tz * e1y AS qx, tz * e1x - tx * e1z AS qy, tx * e1y - ty * e1x AS qz FROM met),
hit AS (SELECT *, e1x * px + e1y * py + e1z * pz AS det FROM p),
blocked AS (SELECT DISTINCT scene, key FROM hit WHERE abs(det) > 1e-12 AND (tx * px + ty * py + tz * pz) / det >= 0 AND (wx * qx + wy * qy + wz * qz) / det >= 0 AND (tx * px + ty * py + tz * pz) / det + (wx * qx + wy * qy + wz * qz) / det <= 1
  AND (e2x * qx + e2y * qy + e2z * qz) / det > 1e-9 AND (e2x * qx + e2y * qy + e2z * qz) / det < len - 0.02)"""


@query("jn28_jn33_ray_occlusion", """
SELECT p.label % 2 AS scene, p.vec_id AS key, CASE WHEN ray.key IS NOT NULL THEN CASE WHEN b.key IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END END AS occluded_fraction, CASE WHEN ray.key IS NOT NULL THEN b.key IS NOT NULL END AS geometrically_occluded
FROM points p LEFT JOIN ray ON ray.key = p.vec_id LEFT JOIN blocked b ON b.key = p.vec_id""", A.POINTS, RAYS)
def ray_occlusion(spark, d):
    """Lines of sight between embeddings' places against triangles made of others."""
    p = A.points(spark, d)
    scene = (c("label") % 2).alias("scene")
    third = G.vec(c("b.x") + c("gaze.x"), c("b.y") + c("gaze.y"), c("b.z") + c("gaze.z"))
    tri = p.select(scene, c("b").alias("v0"), c("gaze").alias("v1"), third.alias("v2"))
    ray = p.select(scene, c("vec_id").alias("key"), c("a").alias("origin"), c("camera").alias("target"))
    return rays.occlusion_flags(ray.select("scene", "key"), rays.occluded_fraction(ray, tri, "scene"), ["scene", "key"])


NAME = "lower(trim(CASE WHEN p_partkey % 5 = 0 THEN 'Second  ' || p_name || CAST(p_size AS VARCHAR) WHEN p_partkey % 5 = 1 THEN p_name || ', pack of ' || p_type ELSE 'another half of ' || p_name END))"


def raw_names(spark, d):
    k = c("p_partkey") % 5
    size = c("p_size").cast("string")
    name = F.when(k == 0, F.concat(F.lit("Second  "), c("p_name"), size)).when(k == 1, F.concat(c("p_name"), F.lit(", pack of "), c("p_type"))).otherwise(F.concat(F.lit("another half of "), c("p_name")))
    return A.read(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", name.alias("name"))


SQUEEZED = f"trim(regexp_replace({NAME}, '\\s+', ' ', 'g'))"
NO_COMMA = f"trim(regexp_replace(replace({SQUEEZED}, ',', ' '), '\\s+', ' ', 'g'))"
BASE_NAME = f"trim(regexp_replace(trim(regexp_replace(trim(regexp_replace({NO_COMMA}, '\\d+$', '')), '^(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|another|other)\\s+', '')), '^(first|second|third|fourth|fifth|another|other)\\s+half\\s+of\\s+', ''))"


@query("str9_str10_str11_name_normalize", f"""
SELECT p_partkey, {BASE_NAME} AS base, trim(regexp_replace(replace(trim(regexp_replace({SQUEEZED}, '\\d+$', '')), ',', ' '), '\\s+', ' ', 'g')) AS class, len(regexp_split_to_array({SQUEEZED}, '\\s+')) AS n_tokens FROM part""")
def normalised_names(spark, d):
    return raw_names(spark, d).select("p_partkey", N.base_name(c("name")).alias("base"), N.class_name(c("name")).alias("class"), F.size(N.name_tokens(c("name"))).alias("n_tokens"))


@query("agg7_agg8_ambiguous_names", f"SELECT p_partkey FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, {BASE_NAME}) AS n FROM part) WHERE n > 1")
def ambiguous_names(spark, d):
    from ..operators.aggregates import ambiguous

    return ambiguous(raw_names(spark, d), ["p_brand"], N.base_name(c("name")), "p_partkey").select("p_partkey")


TOKENS = f"regexp_split_to_array({SQUEEZED}, '\\s+')"


@query("flt16_agg9_agg10_src21_name_filter", f"""
SELECT decision, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 13 = 0 THEN 'duplicate_name'
  WHEN len({TOKENS}) > 2 OR len(list_filter({TOKENS}, lambda t: t IN ('of', 'with', 'for', 'in', 'first', 'second', 'third', 'fourth', 'fifth', 'another', 'other') OR regexp_matches(t, '\\d'))) > 0 THEN 'structural'
  WHEN p_type NOT IN ('ECONOMY', 'SMALL') THEN 'lvis_vocabulary' ELSE 'kept' END AS decision FROM (SELECT * FROM part)) GROUP BY decision""")
def name_filter(spark, d):
    vocabulary = spark.createDataFrame([("ECONOMY",), ("SMALL",)], "term string")
    known = raw_names(spark, d).join(vocabulary.withColumn("known", F.lit(True)), c("p_type") == c("term"), "left")
    decision = N.name_decision(c("name"), c("p_partkey") % 13 == 0, "lvis", F.coalesce("known", F.lit(False)))
    return known.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@query("str4_str5_flt12_flt13_fixture_labels", """
SELECT event_id, label, fixture IS NOT NULL AND label NOT IN ('', 'mid-air') AS valid, coalesce(label = 'counter', false) AS counter, split_part(fixture, '_', 1) AS participant FROM (
  SELECT *, CASE WHEN fixture = 'mid-air' THEN 'mid-air' ELSE lower(regexp_replace(split_part(fixture, '.', 1), '^[^_]*_', '')) END AS label FROM samples)""", A.SAMPLES)
def fixture_labels(spark, d):
    s = A.samples(spark, d).withColumn("label", N.fixture_label(c("fixture")))
    return s.select("event_id", "label", N.valid_fixture(c("label")).alias("valid"), N.is_counter(c("label")).alias("counter"), N.fixture_parts(c("fixture"))["participant"].alias("participant"))


@query("str6_str7_str8_noun_types", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'top_cupboard,cupboard' WHEN 1 THEN 'fridgefreezer,fridge,freezer,top_fridge' WHEN 2 THEN 'drawer,top_drawer,oven' ELSE '' END AS types,
  CASE WHEN p_size % 5 = 3 OR p_size % 7 = 3 THEN 'open' WHEN p_size % 5 = 4 OR p_size % 7 = 4 THEN 'closed' END AS state FROM part""")
def nouns(spark, d):
    k = c("p_partkey") % 4
    said = F.when(k == 0, F.array(F.lit("the Top Cupboard door"))).when(k == 1, F.array(F.lit("fridge freezer"), F.lit("fridge"))).when(k == 2, F.array(F.lit("drawer"), F.lit("oven"), F.lit("table"))).otherwise(F.array(F.lit("table")))
    return A.read(spark, d, "part").select("p_partkey", F.array_join(N.noun_types(said), ",").alias("types"), N.event_state(F.array((c("p_size") % 5).cast("int"), (c("p_size") % 7).cast("int"))).alias("state"))


CLOCK = "lpad(CAST(t // 36000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 36000 // 600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 600 // 10 AS VARCHAR), 2, '0') || '.' || CAST(t % 10 AS VARCHAR)"


@query("str1_str2_str12_str18_str19_time_text", f"""
SELECT event_id, '<TIME ' || {CLOCK} || ' video 1>' AS token, 'h' || CAST(t // 10 AS VARCHAR) || 'p' || CAST(t % 10 AS VARCHAR) AS horizon, substring(sha1(video_id || '|' || CAST(assoc_id AS VARCHAR) || '|' || format('{{:.6f}}', floor(time_sec))), 1, 12) AS item,
  round(t / 10.0, 1) AS seconds, lpad(CAST(CAST(floor(time_sec) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(time_sec) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS minutes
FROM (SELECT *, CAST(round_even(time_sec * 10, 0) AS BIGINT) AS t FROM samples)""", A.SAMPLES)
def time_text(spark, d):
    t = c("time_sec")
    return A.samples(spark, d).select(
        "event_id", N.time_token(t).alias("token"), N.horizon_token(t).alias("horizon"), N.item_id(c("video_id"), c("assoc_id").cast("string"), F.floor(t).cast("double")).alias("item"),
        F.round(N.seconds_of(N.clock(t)), 1).alias("seconds"), N.minutes_of(t).alias("minutes"),
    )


@query("str3_short_numbers", "SELECT event_id, rtrim(rtrim(format('{:.4f}', round_even(score, 4)), '0'), '.') AS text FROM samples", A.SAMPLES)
def short_numbers(spark, d):
    return A.samples(spark, d).select("event_id", N.short_number(c("score")).alias("text"))


@query("str15_str16_str17_str24_set5_set6_text_lists", """
SELECT p_partkey, lower(p_type) || '. ' || lower(p_name) || '.' AS prompt, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9_-]', '_', 'g') AS file, '/data/' || p_brand || '.mp4' AS path, p_type || ',left,right' AS areas FROM part""")
def text_lists(spark, d):
    classes = N.prompt_classes(F.concat(c("p_type"), F.lit(" . "), c("p_name"), F.lit(", "), F.upper("p_name"), F.lit(".")))
    areas = N.with_areas(N.tidy_choices(F.array(c("p_type"), F.lit(" counter "), F.lit(""), c("p_type"))), F.array(F.lit("left"), F.lit("right")))
    return A.read(spark, d, "part").select("p_partkey", N.class_prompt(classes).alias("prompt"), N.file_name(F.concat("p_name", F.lit("/"), "p_brand")).alias("file"), N.path_of("/data/", c("p_brand")).alias("path"), F.array_join(areas, ",").alias("areas"))


HASH = "md5('7|' || CAST(p_partkey AS VARCHAR) || '|' || {x})"


@query("rnd1_rnd2_qst4_str14_shuffled_choices", f"""
SELECT p_partkey, array_to_string(choices, ',') AS choices, list_position(choices, 'b') - 1 AS correct_idx, choices[1] AS first FROM (
  SELECT p_partkey, list_transform(list_sort(list_transform(['a', 'b', 'c', 'd'], lambda x: {{'h': {HASH.format(x='x')}, 'c': x}})), lambda s: s.c) AS choices FROM part)""")
def shuffled(spark, d):
    choices = N.shuffled(F.array(*(F.lit(x) for x in "abcd")), 7, c("p_partkey"))
    return A.read(spark, d, "part").select("p_partkey", choices.alias("x")).select("p_partkey", F.array_join("x", ",").alias("choices"), N.answer_index(c("x"), F.lit("b")).cast("long").alias("correct_idx"), N.answer_text(c("x"), F.lit(0), F.lit("?")).alias("first"))


@query("rnd4_rnd6_hash_sample", "SELECT status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY md5('3|' || status || '|' || CAST(event_id AS VARCHAR)), event_id) AS rn FROM samples) WHERE rn <= 30", A.SAMPLES)
def hash_sample(spark, d):
    return R.sampled_per_group(A.samples(spark, d), ["status"], ["event_id"], 30, 3, salt=True).select("status", "event_id")


@query("rnd5_sampled_frames", """
SELECT span_id, frame_index, round(frame_index / 30.0, 6) AS time_sec FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY md5('5|' || CAST(span_id AS VARCHAR) || '|' || CAST(frame_index AS VARCHAR)), frame_index) AS rn FROM (
  SELECT span_id, unnest(range(CAST(round_even(start_sec * 30, 0) AS BIGINT), CAST(round_even(end_sec * 30, 0) AS BIGINT) + 1)) AS frame_index FROM spans WHERE end_sec IS NOT NULL)) WHERE rn <= 5""", A.SPANS)
def sampled_frames(spark, d):
    s = A.spans(spark, d).where("end_sec is not null").select("span_id", "start_sec", "end_sec")
    return R.sampled_frames(s, ["span_id"], "start_sec", "end_sec", 30.0, 5, 5).select("span_id", "frame_index", "time_sec")


@query("rnd7_rnd8_uniform_times", """
SELECT span_id, CASE WHEN end_sec > start_sec THEN round(start_sec + CAST(('0x' || substring(md5('9|' || CAST(span_id AS VARCHAR)), 1, 12)) AS BIGINT) / 281474976710656.0 * (end_sec - start_sec), 6) END AS t, len(list_distinct(list_transform([0, 1, 2, 3], lambda i: round(start_sec + (end_sec - start_sec) * i / 3.0, 3)))) AS n FROM spans WHERE end_sec IS NOT NULL""", A.SPANS)
def uniform_times(spark, d):
    s = A.spans(spark, d).where("end_sec is not null")
    return R.uniform_times(s, ["span_id"], c("start_sec"), c("end_sec"), 9, "t").select("span_id", "t", F.size(R.ends_and_middle(c("start_sec"), c("end_sec"), 4)).cast("long").alias("n"))


@query("rnd9_chosen_or_sampled", "SELECT event_id FROM samples WHERE assoc_id IN (SELECT assoc_id FROM (SELECT DISTINCT assoc_id FROM samples) ORDER BY md5('1|' || CAST(assoc_id AS VARCHAR)), assoc_id LIMIT 3)", A.SAMPLES)
def chosen(spark, d):
    return R.chosen_or_sampled(A.samples(spark, d), "assoc_id", None, 3, 1).select("event_id")


@query("set1_union", "SELECT assoc_id AS id FROM tracks UNION SELECT user_id FROM events", A.TRACKS)
def unions(spark, d):
    return sets.union_of([(A.tracks(spark, d), "assoc_id"), (A.read(spark, d, "events"), "user_id")], "id")


@query("set2_ordered_union", """
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS ids FROM (SELECT p_partkey, [p_type, p_brand, p_type, p_name, p_brand] AS l FROM part)""")
def ordered_union(spark, d):
    ids = sets.ordered_union(F.array("p_type", "p_brand"), F.array("p_type", "p_name", "p_brand"))
    return A.read(spark, d, "part").select("p_partkey", F.array_join(ids, ",").alias("ids"))


@query("set4_status_domains", """
SELECT assoc_id, array_to_string(list_sort(list_filter(['in_view', 'in_motion', 'out_of_view', 'unobservable_no_data'], lambda x: NOT list_contains(l, x))), ',') AS missing,
  array_to_string(list_sort(list_distinct(list_concat(l, ['geometrically_occluded']))), ',') AS domain FROM (SELECT assoc_id, list(DISTINCT status) AS l FROM samples GROUP BY assoc_id)""", A.SAMPLES)
def status_domains(spark, d):
    out = sets.domains(A.samples(spark, d), ["assoc_id"], "status", ["in_view", "in_motion", "out_of_view", "unobservable_no_data"], ["geometrically_occluded"])
    return out.select("assoc_id", F.array_join("missing", ",").alias("missing"), F.array_join("domain", ",").alias("domain"))


@query("set7_selected_videos", "SELECT DISTINCT video_id FROM samples WHERE split_part(video_id, '-', 1) IN ('P01', 'P03')", A.SAMPLES)
def selected_videos(spark, d):
    """Without an explicit list, the videos of the participants."""
    return R.selected_videos(A.samples(spark, d), "video_id", None, ["P01", "P03"])


@query("src18_manifest", "SELECT page_id, md5(url) AS md5, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages WHERE url IS NOT NULL AND contains(url, '://')")
def manifest(spark, d):
    from ..sources.readers import manifest as parse

    p = A.read(spark, d, "pages").where("url is not null and contains(url, '://')")
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    lines = p.select("page_id", F.concat(F.md5("url"), F.lit("  ./"), rest).alias("value"))
    parsed = lines.withColumn("one", F.struct("value"))
    m = parse(lines.select("value").distinct()).withColumn("value", F.concat("md5", F.lit("  ./"), "rel_path"))
    return parsed.join(m, "value").select("page_id", "md5", F.split("rel_path", "/")[0].alias("host"))
