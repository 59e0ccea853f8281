"""Cases worked by hand: small inputs whose results follow from the rules."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions import names as N
from sightline.functions.statuses import status_ladder
from sightline.operators import islands as I
from sightline.operators import rank as R
from sightline.operators import rays, scan
from sightline.operators import temporal as T
from sightline.operators.aggregates import interval_verdicts
from sightline.plans.adapters import LENS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_runs(spark):
    s = spark.createDataFrame([(1, float(t), f) for t, f in enumerate([True, True, False, False, True])], "o int, t double, f boolean")
    assert rows(I.collapse_runs(s, ["o"], ["t"], "t", "f"), "start_sec", "end_sec", "f") == [(0, 1, True), (2, 3, False), (4, 4, True)]


def test_last_true(spark):
    s = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, False, True, False])], "o int, i int, f boolean")
    s = I.last_true_index(s, ["o"], ["i"], "i", F.col("f"), "a")
    s = I.last_true_index(s, ["o"], ["i"], "i", F.col("f"), "b", inclusive=False)
    assert [(r.a, r.b) for r in s.orderBy("i").collect()] == [(0, None), (0, 0), (2, 0), (2, 2)]


@pytest.mark.parametrize(("events", "want"), [
    ([("open", 4.0, 5.0), ("open", 6.0, 7.0), ("closed", 8.0, 9.0)], [("closed", 0, 5, True), ("closed", 9, 20, False), ("open", 5, 9, False)]),
    ([("closed", 2.0, 3.0)], [("closed", 3, 20, False), ("open", 0, 3, True)]),
])
def test_open_close(spark, events, want):
    e = spark.createDataFrame([("f", *x) for x in events], "f string, state string, start_sec double, end_sec double")
    ends = spark.createDataFrame([("f", 20.0)], "f string, video_end double")
    assert rows(I.open_close_intervals(e, ends, ["f"]), "state", "start_time", "end_time", "backfilled") == want


def test_time_grid(spark):
    g = spark.createDataFrame([(0.0, 2.0)], "a double, b double")
    assert [r.time_sec for r in T.time_grid(g, "a", "b", 2.0).orderBy("time_sec").collect()] == [0, 0.5, 1, 1.5, 2]
    with pytest.raises(Exception, match="ends before"):
        T.time_grid(spark.createDataFrame([(2.0, 0.0)], "a double, b double"), "a", "b", 2.0).collect()
    with pytest.raises(ValueError):
        T.time_grid(g, "a", "b", 0)


@pytest.mark.parametrize(("end", "want"), [(1.0, [0.5]), (4.0, [0, 2, 4]), (8.0, [0, 2, 4, 6, 8])])
def test_adaptive_times(spark, end, want):
    assert one(spark, T.adaptive_times(F.lit(0.0), F.lit(end), 1.0)) == want


@pytest.mark.parametrize(("t", "want"), [(3.0, (0, "in_motion")), (5.0, (0, "past")), (1.0, (0, "future")), (8.0, (1, "in_motion"))])
def test_track_choice(spark, t, want):
    tracks = spark.createDataFrame([(1, 0, "a", 2.0, 4.0), (1, 1, "b", 6.0, 8.0)], "o int, track_pos int, track_id string, start_sec double, end_sec double")
    r = T.choose_track(spark.createDataFrame([(1, t)], "o int, t double"), tracks, ["o"], "t").first()
    assert (r.track_pos, r.relation) == want


@pytest.mark.parametrize(("tie", "want"), [("later", 20), ("earlier", 10)])
def test_nearest_ties(spark, tie, want):
    frames = spark.createDataFrame([(1, 10), (1, 20)], "o int, f int")
    assert T.nearest_join(spark.createDataFrame([(1, 15)], "o int, t int"), frames, ["o"], "t", "f", tie=tie).first().match.f == want


def test_shared_boundary(spark):
    spans = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.0, 9.0)], "o int, start_sec double, end_sec double")
    p = spark.createDataFrame([(1, 5.0)], "o int, t double")
    for bucket in (None, 2.0):
        first = T.first_match(T.stab_join(p, spans, ["o"], "t", "start_sec", "end_sec", bucket=bucket), ["o"], F.col("s_start_sec"), ["s_end_sec"])
        assert first.first().s_end_sec == 5
    assert T.last_started(p, spans, ["o"], "t").first().match.end_sec == 9
    left = T.stab_join(spark.createDataFrame([(1, 50.0)], "o int, t double"), spans, ["o"], "t", "start_sec", "end_sec", bucket=2.0, how="left")
    assert left.first().s_start_sec is None


def test_sound_within_tolerance(spark):
    e = spark.createDataFrame([(1, 10.0, 12.0)], "v int, start_sec double, end_sec double")
    s = spark.createDataFrame([(1, 12.0, 12.4), (1, 7.0, 8.0)], "v int, start_sec double, stop_sec double")
    r = T.snap_to_sound(e, s, ["v"]).first()
    assert (r.start_sec, r.end_sec, r.snapped) == (12.0, 12.4, True)


@pytest.mark.parametrize(("state", "confidence", "occluded", "want"), [
    ("closed", "low", False, "in_view"), ("open", "low", True, "potentially_visible_inside_open_fixture"), ("closed", "assumed_closed", True, "occluded_inside_closed_fixture"), (None, None, True, "geometrically_occluded"),
])
def test_ladder(spark, state, confidence, occluded, want):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, status_ladder(F.lit(False), F.lit(True), F.lit(True), lit(state), lit(confidence), F.lit(occluded))["status"]) == want


def v(x, y, z):
    return G.vec(float(x), float(y), float(z))


def test_projection(spark):
    plain = (600.0, 704.0, 704.0, *[0.0] * 12)
    p = one(spark, G.project_fisheye(v(0.1, 0.2, 1), plain))
    assert (p.u, p.v) == (pytest.approx(763.0289686, abs=1e-6), pytest.approx(822.0579372, abs=1e-6))
    p = one(spark, G.project_fisheye(v(0.1, 0.2, 1), LENS))
    assert (p.u, p.v) == (pytest.approx(763.3167288, abs=1e-6), pytest.approx(822.4781052, abs=1e-6))
    assert one(spark, G.project_fisheye(v(1, 1, 0), LENS)) is None
    axis = one(spark, G.project_fisheye(v(0, 0, 2), LENS))
    assert (axis.u, axis.v) == (704, 704)


def test_unprojection_inverts(spark):
    points = spark.createDataFrame([(x / 10, y / 10) for x in range(-6, 7, 3) for y in range(-6, 7, 3)], "x double, y double")
    px = points.select("x", "y", G.project_fisheye(G.vec(F.col("x"), F.col("y"), 1.0), LENS).alias("p"))
    for r in px.select("x", "y", rays.pixel_directions(LENS)(F.col("p.u"), F.col("p.v")).alias("d")).collect():
        assert (r.d.x / r.d.z, r.d.y / r.d.z) == (pytest.approx(r.x, abs=1e-6), pytest.approx(r.y, abs=1e-6))


def test_ray_blocked_by_a_wall(spark):
    corner = "struct<x: double, y: double, z: double>"
    wall = spark.createDataFrame([("s", (-9.0, -9.0, 5.0), (9.0, -9.0, 5.0), (0.0, 20.0, 5.0))], f"scene string, v0 {corner}, v1 {corner}, v2 {corner}")
    ray = spark.createDataFrame([("s", 1, (0.0, 0.0, 0.0), (0.0, 0.0, 9.0)), ("s", 1, (0.0, 0.0, 0.0), (0.0, 0.0, 4.0)), ("s", 2, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)), ("s", 3, (0.0, 0.0, 9.0), (1.0, 0.0, 20.0))], f"scene string, key int, origin {corner}, target {corner}")
    assert rows(rays.occluded_fraction(ray, wall, "scene"), "key", "n_rays", "n_blocked", "fraction") == [(1, 2, 1, 0.5), (3, 1, 0, 0.0)]


@pytest.mark.parametrize(("x", "z", "label", "why"), [(-1, 2, "Front-left", None), (1, -2, "Back-right", None), (0.04, 1, None, "x"), (1, 0.05, None, "angle"), (1, 0.01, None, "z")])
def test_quadrants(spark, x, z, label, why):
    assert (one(spark, G.quadrant(v(x, 0, z))), one(spark, G.quadrant_rejection(v(x, 0, z)))) == (label, why)


def test_small_geometry(spark):
    assert one(spark, G.proximity(F.lit(1.0))) == pytest.approx(0.5134171, abs=1e-7)
    assert [one(spark, G.distance_bucket(F.lit(d))) for d in (0.99, 1.0, 1.5)] == ["close", "medium", "far"]
    assert (one(spark, G.dominant_axis(v(1, 0, 0.9))), one(spark, G.second_axis(v(1, 0, 0.9)))) == ("to the right", "in front of")
    assert one(spark, G.inside_box(v(1, 0.5, 0.5), F.array(*[F.lit(0.0)] * 3), F.array(*[F.lit(1.0)] * 3)))
    assert not one(spark, G.in_image(F.struct(F.lit(1408.0).alias("u"), F.lit(0.0).alias("v")), 1408, 1408))


def test_names(spark):
    assert one(spark, N.fixture_label(F.lit("P04_counter.004"))) == "counter"
    assert one(spark, N.fixture_label(F.lit("mid-air"))) == "mid-air"
    assert one(spark, N.fixture_label(F.lit("P01_top_cupboard.001"))) == "top_cupboard"
    assert one(spark, N.noun_types(F.array(F.lit("top cupboard")))) == ["top_cupboard", "cupboard"]
    assert one(spark, N.noun_types(F.array(F.lit("fridge freezer")))) == ["fridgefreezer", "fridge", "freezer"]
    assert one(spark, N.base_name(F.lit("Second orange3"))) == "orange"
    assert one(spark, N.base_name(F.lit("pack of orange"))) == "pack of orange"
    assert one(spark, N.time_token(F.lit(27.2))) == "<TIME 00:00:27.2 video 1>"
    assert one(spark, N.horizon_token(F.lit(5.0))) == "h5p0"
    assert one(spark, N.file_name(F.lit("/é x/"))) == "é_x"


@pytest.mark.parametrize(("best", "second", "want"), [(0.6, 0.5, "medium"), (0.6, 0.4, "high"), (0.1, -1.0, "low"), (0.05, -1.0, "very_low")])
def test_confidence(spark, best, second, want):
    assert one(spark, R.confidence_of(F.lit(best), F.lit(second))) == want


def test_orders(spark):
    f = spark.createDataFrame([(1, t, x) for t, x in enumerate("AABA")], "o int, t int, f string")
    assert [r.place_order for r in R.location_first(f, ["o"], "f", "t").orderBy("t").collect()] == [1, 3, 2, 4]
    r = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4)], "v int, g string, i int")
    assert [x.i for x in R.round_robin(r, ["v"], "g", ["i"], 3).orderBy("turn").collect()] == [1, 4, 2]
    n = spark.range(5).withColumn("k", F.lit(1))
    assert [x.id for x in R.evenly_spaced(n, ["k"], ["id"], 3).orderBy("id").collect()] == [0, 2, 4]


def test_smoother_and_verdicts(spark):
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate([1.0, 0.0, 1.0])], "o int, i int, x double")
    assert [round(r.e, 6) for r in scan.exponential_average(s, ["o"], ["i"], "x", 0.7, "e").orderBy("i").collect()] == [1, 0.3, 0.79]
    a = spark.createDataFrame([(1, "detected"), (1, "not_detected"), (2, "skipped")], "o int, verdict string")
    assert rows(interval_verdicts(a, ["o"]), "o", "verdict") == [(1, "detected"), (2, "skipped")]


def test_nulls_and_repeats_in_points(spark):
    """Null columns besides, and points that occur twice, change no answer."""
    from sightline.functions.statuses import priority
    from sightline.operators import temporal as T
    from sightline.operators import visibility as V

    points = spark.createDataFrame([("a", 1.0, None), ("a", 1.0, None), ("a", 9.0, "x"), ("b", 1.0, None), (None, 1.0, None), ("a", None, "y")], "k string, t double, extra string")
    tracks = spark.createDataFrame([("a", 0, "t1", 0.0, 2.0)], "k string, track_pos int, track_id string, start_sec double, end_sec double")
    got = sorted((str(r.k), str(r.t), str(r.extra), r.relation, str(r.track_id)) for r in T.choose_track(points, tracks, ["k"], "t").collect())
    assert got == sorted([("a", "1.0", "None", "in_motion", "t1")] * 2 + [("a", "9.0", "x", "past", "t1"), ("b", "1.0", "None", "no_track_available", "None"), ("None", "1.0", "None", "no_track_available", "None"), ("a", "None", "y", "no_track_available", "None")])
    spans = spark.createDataFrame([("a", 0.0, 2.0, "in_view"), ("a", 0.5, None, "in_motion")], "k string, start_sec double, end_sec double, status string")
    shut = spans.where("end_sec is not null")
    got = sorted((str(r.k), str(r.t), r.status) for r in T.strongest_span(points, shut, ["k"], "t", priority(F.col("s_status")), bucket=4.0).collect())
    assert got == sorted([("a", "1.0", "in_view")] * 2 + [("a", "9.0", "out_of_view"), ("b", "1.0", "out_of_view"), ("None", "1.0", "out_of_view"), ("a", "None", "out_of_view")])
    for bucket in (None, 4.0):
        got = sorted((str(r.k), str(r.t), str(r.s_status)) for r in T.stab_join(points, spans, ["k"], "t", "start_sec", "end_sec", bucket=bucket, how="left").collect())
        assert got == sorted([("a", "1.0", "in_view"), ("a", "1.0", "in_motion")] * 2 + [("a", "9.0", "in_motion"), ("b", "1.0", "None"), ("None", "1.0", "None"), ("a", "None", "None")])
    got = sorted((str(r.k), str(r.t), str(r.s_status)) for r in T.stab_first(points, spans, ["k"], "t", "start_sec", "end_sec").collect())
    assert got == sorted([("a", "1.0", "in_view")] * 2 + [("a", "9.0", "in_motion"), ("b", "1.0", "None"), ("None", "1.0", "None"), ("a", "None", "None")])
    around = points.where("t is not null").select("*", (F.col("t") - 0.1).alias("f"), (F.col("t") + 0.1).alias("u"))
    got = sorted((str(r.k), r.t, r.overlaps) for r in T.overlapping(around, shut, ["k"], "f", "u").collect())
    assert got == [("None", 1.0, True), ("a", 1.0, True), ("a", 1.0, True), ("a", 9.0, False), ("b", 1.0, True)]
    pixels = points.select("k", "extra", F.struct(F.lit(10.0).alias("u"), F.lit(500.0).alias("v")).alias("pixel"))
    boxes = spark.createDataFrame([("a", 1, -100.0, 400.0, 20.0, 520.0), ("a", 2, 25.0, 490.0, 40.0, 800.0), ("a", 3, 90.0, 0.0, 99.0, 9.0)], "k string, box_id int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((str(r.k), r.n_boxes, str(r.box_id)) for r in V.matched_boxes(pixels, boxes, ["k"]).collect())
    assert got == sorted([("None", 0, "None"), ("b", 0, "None")] + [("a", 2, "1")] * 4)


def test_the_first_span_that_holds_a_time(spark):
    """Against all pairs: many overlapping spans, ties of starts and ends, some without an end."""
    import random

    from sightline.operators import temporal as T

    rng = random.Random(4)
    spans = [(rng.choice("ab"), i, float(s := rng.randint(0, 60)), None if rng.random() < 0.1 else float(s + rng.randint(0, 30))) for i, _ in enumerate(range(60))]
    points = [(rng.choice("abc"), i, rng.randint(-10, 900) / 8) for i in range(400)]
    out = T.stab_first(spark.createDataFrame(points, "k string, i int, t double"), spark.createDataFrame(spans, "k string, span int, s double, e double"), ["k"], "t", "s", "e", ["span"], bucket=8.0)
    for r in out.collect():
        held = sorted((s, n) for k, n, s, e in spans if k == r.k and s <= r.t and (e is None or r.t <= e))
        assert r.s_span == (held[0][1] if held else None)
    assert out.count() == 400


def test_short_numbers_keep_the_sign_of_what_rounds_to_zero(spark):
    xs = [-0.00003, -0.0, 0.0, 0.00003, -0.5, 0.12345, -0.00005, -20.0]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", N.short_number(F.col("x")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == ["-0", "-0", "0", "0", "-0.5", "0.1234", "-0", "-20"]
