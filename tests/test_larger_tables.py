"""Mechanisms that larger tables need: the same results as plain loops, with blocks and rounds so small that there are several."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import fixtures as X
from sightline.operators import rank as R


def test_best_interactions_are_those_of_all_scores(spark, monkeypatch):
    """Events share windows, and fixtures come in several blocks; two fixtures of the same place tie."""
    monkeypatch.setattr(X, "FIXTURES", 3)
    rng = random.Random(4)
    at = lambda: tuple(rng.uniform(-2, 2) for _ in range(3))
    frames = spark.createDataFrame([(p, i, at(), at()) for p in "pq" for i in range(0, 120, 3)], "place string, frame_index int, camera struct<x double, y double, z double>, gaze struct<x double, y double, z double>")
    places = [(p, f"f{i:02}", at()) for p in "pq" for i in range(11)]
    fixtures = spark.createDataFrame([*places, ("p", "f99", places[0][2])], "place string, fixture string, position struct<x double, y double, z double>")
    events = spark.createDataFrame([(n, rng.choice("pqr"), s := rng.choice([0.0, 1.0, 2.5, 30.0]), s + rng.choice([0.0, 1.0])) for n in range(60)], "e int, place string, start_sec double, end_sec double")
    scores = X.interaction_scores(events, frames, fixtures, ["e"], "place", 30.0)
    want = {r.e: r for r in R.best_and_runner_up(scores, ["e"], "score", "fixture").collect()}
    got = {r.e: r for r in X.best_interactions(events, frames, fixtures, ["e"], "place", 30.0).collect()}
    assert got == want and len(got) > 20


def test_rays_meet_triangles_in_rounds(spark):
    """A ray is tested against part of the triangles first; whatever the rounds, those are blocked that all pairs block. Some run far past the scene, some along an axis."""
    from sightline.operators import rays

    rng = random.Random(8)
    at = lambda r: tuple(rng.uniform(-r, r) for _ in range(3))
    struct = "struct<x double, y double, z double>"
    lines = [(n % 2, n, a := at(2), at(2) if n % 3 else (a[0], a[1], a[2] + 1.5)) for n in range(120)] + [(0, 900, at(1), (1e5, 3e4, -2e4)), (1, 901, (50.0, 50.0, 50.0), (60.0, 50.0, 50.0))]
    faces = [(rng.randrange(2), v := at(2), *(tuple(x + rng.uniform(-1.5, 1.5) for x in v) for _ in range(2))) for _ in range(150)]
    ray, tri = spark.createDataFrame(lines, f"scene int, key int, origin {struct}, target {struct}"), spark.createDataFrame(faces, f"scene int, v0 {struct}, v1 {struct}, v2 {struct}")
    size = rays.norm(rays.minus(F.col("target"), F.col("origin")))
    way = rays.vec(*((F.col("target")[c] - F.col("origin")[c]) / size for c in "xyz"))
    pairs = ray.join(tri, "scene").where(rays.hit_distance(F.col("origin"), way, F.col("v0"), F.col("v1"), F.col("v2")) < size - rays.TOLERANCE)
    want = {r.key for r in pairs.select("key").distinct().collect()}
    assert 20 < len(want) < 110
    for first, growth in ((4, 3), (1000, 16)):
        got = rays.occluded_fraction(ray, tri, "scene", first=first, growth=growth).collect()
        assert len(got) == len(lines) and {r.key for r in got if r.n_blocked} == want


def test_anchors_are_chosen_in_blocks_and_pools(spark, monkeypatch):
    """The smallest hash among the other objects of a time, from blocks of few; and the first candidates of each video whose anchor has a place, from pools that grow."""
    import hashlib

    from sightline.operators import questions as Q

    monkeypatch.setattr(Q, "ANCHORS", 3)
    rng = random.Random(6)
    candidates = [(f"v{n % 3}", rng.randrange(12), float(rng.randrange(4))) for n in range(40)]
    states = [(f"v{rng.randrange(3)}", float(rng.randrange(3)), rng.randrange(12)) for _ in range(70)]
    c, s = spark.createDataFrame(candidates, "video_id string, assoc_id int, query_sec double"), spark.createDataFrame(states, "video_id string, query_sec double, anchor_id int")
    order = lambda a, o: (hashlib.md5(f"11|{a}|{o}".encode()).hexdigest(), o)
    want = []
    for v, a, t in candidates:
        others = [o for w, u, o in states if (w, u) == (v, t) and o != a]
        want += [(v, a, t, min(others, key=lambda o: order(a, o)))] if others else []  # noqa: B023
    assert sorted((r.video_id, r.assoc_id, r.query_sec, r.anchor_id) for r in Q.with_anchor(c, s, 11).collect()) == sorted(want)
    once = sorted({(v, a, t) for v, a, t in candidates})
    objects = {(v, o) for v, _, o in states}
    got = Q.first_with_anchor(spark.createDataFrame(once, c.schema), s.select("video_id", "anchor_id"), spark.range(0, 12, 3).select(F.col("id").cast("int").alias("anchor_id")), 11, ["query_sec", "assoc_id"], 1).collect()
    for v in ("v0", "v1", "v2"):
        chosen = [(t, a, min((o for w, o in objects if w == v and o != a), key=lambda o: order(a, o))) for w, a, t in once if w == v]  # noqa: B023
        first = min((x for x in chosen if x[2] % 3 == 0), default=None)
        assert min(((r.query_sec, r.assoc_id, r.anchor_id) for r in got if r.video_id == v), default=None) == first


def test_frames_are_drawn_without_a_row_for_each(spark):
    """As by numbering all frames of a key; a key may have several spans, and nothing of the plan lists frames before the spans have met."""
    spans = spark.createDataFrame([("a", 0.0, 3.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("c", 5.0, 5.05), ("d", None, 1.0)], "k string, s double, e double")
    got = R.sampled_frames(spans, ["k"], "s", "e", 30.0, 4, 5)
    frames = spans.withColumn("frame_index", F.explode(F.sequence(F.rint(F.col("s") * 30).cast("long"), F.rint(F.col("e") * 30).cast("long"))))
    want = R.sampled_per_group(frames, ["k"], ["frame_index"], 4, 5, salt=True)
    assert sorted((r.k, r.frame_index) for r in got.collect()) == sorted((r.k, r.frame_index) for r in want.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Generate") < plan.index("Aggregate")


def test_all_frames_of_a_span_can_be_drawn(spark):
    """The query draws from whole spans: some frames lie in each tenth of them."""
    from sightline.plans import adapters as A
    from sightline.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    drawn = QUERIES["rnd5_sampled_frames"](spark, sf).join(A.spans(spark, sf).where("end_sec > start_sec + 5"), "span_id")
    part = F.floor((F.col("time_sec") - F.col("start_sec")) / (F.col("end_sec") - F.col("start_sec")) * 10)
    assert {r[0] for r in drawn.select(part).distinct().collect()} >= set(range(10))


def test_first_numbers_by_hash(monkeypatch):
    """As by hashing one after another, with pieces of any size, texts of any length, negative numbers, ranges that share a key, and hashes whose leading bits are equal."""
    import hashlib

    import numpy as np

    from sightline.functions import digests as D

    rng = random.Random(2)
    for trial in range(60):
        monkeypatch.setattr(D, "CHUNK", rng.choice([1, 7, 300, 32768]))
        begins = [f"5|{'x' * rng.choice([0, 3, 48, 60, 130])}{rng.randrange(10 ** rng.randrange(1, 8))}|".encode() for _ in range(rng.randrange(1, 8))]
        owner = np.sort(np.array([rng.randrange(len(begins)) for _ in range(rng.randrange(12))], np.int64))
        low = np.array([rng.choice([0, -50, 10**9]) + rng.randrange(-100, 100) for _ in owner], np.int64)
        high, count = low + np.array([rng.randrange(120) for _ in owner], np.int64), rng.choice([1, 3, 5, 40, 500])
        got = list(zip(*(x.tolist() for x in D.first_numbers(begins, owner, low, high, count))))
        want = []
        for k, begin in enumerate(begins):
            own = sorted((hashlib.md5(begin + str(f).encode()).hexdigest(), f, i) for i in range(len(owner)) if owner[i] == k for f in range(low[i], high[i] + 1))
            want += [(k, i, f) for _, f, i in own[:count]]
        assert got == want
    at = D._first_of_each(np.array([5, 5, 5, 9, 1 << 60, 2 << 60, 3 << 60], np.uint64), np.array([4, 3]), np.array([0, 4]), 2)
    assert sorted(at) == [0, 1, 2, 3, 4, 5]


def test_least_other_of_each_time(monkeypatch):
    """As by hashing every pair of each time, though a pair is hashed once; lists shorter and longer than the others' number, an object alone at a time, and hashes whose leading bits are equal."""
    import hashlib

    import numpy as np

    from sightline.functions import digests as D

    hashed = []
    monkeypatch.setattr(D, "digests", lambda a, n, e, picked, f=D.digests: hashed.append(len(picked)) or f(a, n, e, picked))
    rng = random.Random(5)
    flat = lambda lists: (np.cumsum([0, *map(len, lists)]), np.array([x for one in lists for x in one], np.int64))
    for trial in range(16):
        monkeypatch.setattr(D, "CHUNK", rng.choice([60, 300, 32768]))
        names, last = [str(n).encode() for n in range(0, 120, rng.choice([1, 7]))], rng.choice([2, 9, 60])
        times = lambda most: [sorted(rng.sample(range(last), rng.randrange(min(last, most) + 1))) for _ in names]  # noqa: E731, B023
        asked, offered = times(6), times(rng.choice([1, 4]))
        hashed.clear()
        got = D.least_others(([b"11|" + x + b"|" for x in names], *flat(asked)), (names, *flat(offered)), np.arange(len(names)))
        want = []
        for i, x in enumerate(names):
            for t in asked[i]:
                others = [(hashlib.md5(b"11|" + x + b"|" + o).hexdigest(), j) for j, o in enumerate(names) if j != i and t in offered[j]]
                want += [(i, t, min(others)[1], min(others)[0])] if others else []
        assert sorted((i, t, o, f"{h:016x}{l:016x}") for i, t, o, h, l in zip(*(x.tolist() for x in got))) == sorted(want)
        assert sum(hashed) <= len(names) ** 2
    h, l = np.array([9, 8, 8, 8, 1], np.uint64) << np.uint64(3), np.array([0, 7, 5, 5, 0], np.uint64)
    assert D._least_of_lists(h, l, np.array([0, 1, 3, 2, 1, 4, 4]), np.array([0, 4, 6]), np.array([4]), np.uint64(3)).tolist() == [2, 1, -1]


def test_a_pair_of_objects_has_one_hash(spark, monkeypatch):
    """Anchors are chosen by blocks of a video's objects, not by pairs of each time: all times of an object stand in one row, in blocks of either side."""
    from sightline.operators import questions as Q

    monkeypatch.setattr(Q, "ASKED", 2)
    monkeypatch.setattr(Q, "ANCHORS", 3)
    objects = spark.range(8).select(F.concat(F.lit("v"), (F.col("id") % 2).cast("string")).alias("video_id"), F.col("id").alias("assoc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(30).cast("long"))).alias("query_sec"))
    got = Q.with_anchor(objects, objects.withColumnRenamed("assoc_id", "anchor_id"), 11)
    assert "MapInArrow" in plan_of(got)
    other = objects.select("video_id", F.col("assoc_id").alias("anchor_id")).distinct()
    pairs = objects.join(other, "video_id").where("assoc_id <> anchor_id").groupBy("video_id", "assoc_id", "query_sec").agg(F.expr("min_by(anchor_id, md5(concat('11|', assoc_id, '|', anchor_id)))").alias("anchor_id"))
    columns = ["video_id", "assoc_id", "query_sec", "anchor_id"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, pairs.select(columns).collect())) and got.count() == 248


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_right_row_of_each_time_is_sorted(spark):
    """Many right rows share their times: one of each is left before the sort, the last backward and the first forward, with blocks or without."""
    from sightline.operators import temporal as T

    rng = random.Random(7)
    right = [(rng.choice("ab"), float(rng.randrange(6)) * 10, n) for n in range(200)]
    left = [(n, rng.choice("abc"), rng.choice([rng.uniform(-5, 60), 20.0])) for n in range(80)]
    r, q = spark.createDataFrame(right, "k string, t double, id int"), spark.createDataFrame(left, "n int, k string, s double")
    for block in (None, 15.0):
        out = T.asof_both(q, (r, "t", ["id"], False, "at"), (r, "t", ["id"], True, "next"), ["k"], "s", block=block)
        assert "max_by" in plan_of(out) and "min_by" in plan_of(out)
        for x in out.collect():
            at = max(((t, i) for k, t, i in right if k == x.k and t <= x.s), default=None)
            after = min(((t, i) for k, t, i in right if k == x.k and t > x.s), default=None)
            assert (x.at and tuple(x.at)) == at and (x.next and tuple(x.next)) == after


def test_first_spans_in_blocks(spark):
    """A key's spans are split by their starts; spans that reach over several blocks, have no end, or are equal to others count as in one window."""
    from sightline.operators import temporal as T

    rng = random.Random(9)
    rows = [(n, rng.choice("ab"), s := float(rng.randrange(200)), None if n in (5, 6) else s + rng.choice([0.0, 1.0, 4.0, 50.0])) for n in range(150)]
    spans = spark.createDataFrame(rows, "id int, k string, s double, e double")
    kept = lambda block: sorted(tuple(r) for r in T.first_spans(spans.where("e is not null"), ["k"], "s", "e", ["id"], block).collect())
    assert kept(16.0) == kept(None) and len(kept(None)) > 10
    points = spark.createDataFrame([(n, rng.choice("ab"), rng.uniform(0, 260)) for n in range(200)], "n int, k string, t double")
    for x in T.stab_first(points, spans, ["k"], "t", "s", "e", ["id"], 16.0).collect():
        want = min(((s, i) for i, k, s, e in rows if k == x.k and s <= x.t and (e is None or x.t <= e)), default=(None, None))
        assert (x.s_s, x.s_id) == want


def test_equal_spans_meet_the_skyline_once(spark):
    from sightline.operators import temporal as T

    rng = random.Random(3)
    rows = [("a", s := float(rng.randrange(8)), s + rng.randrange(3), n) for n in rng.sample(range(300), 300)]
    pieces = T.skyline(spark.createDataFrame(rows, "k string, s double, e double, r int"), spark.createDataFrame([("a", 9.0)], "k string, t double"), ["k"], "t", "s", "e", [F.col("s_r")])
    assert "min_by" in plan_of(pieces)
    points = spark.createDataFrame([("a", n / 4) for n in range(50)], "k string, t double")
    got = T.stab_strongest(points, spark.createDataFrame(rows, "k string, s double, e double, r int"), ["k"], "t", "s", "e", [F.col("s_r")]).collect()
    assert len(got) == 50 and all(x.s_r == min((r for _, s, e, r in rows if s <= x.t <= e), default=None) for x in got)


def test_sounds_are_looked_up_in_blocks(spark):
    """Events with the same middle share a lookup; the nearest sound may lie in another block."""
    from sightline.operators import temporal as T

    sounds = spark.createDataFrame([("a", 9.0, 10.0), ("a", 30.0, 31.0), ("b", 5.0, 6.0)], "k string, start_sec double, stop_sec double")
    events = spark.createDataFrame([(1, "a", 10.0, 11.0), (2, "a", 9.5, 11.5), (3, "a", 10.0, 11.0), (4, "a", 20.0, 21.0), (5, "c", 5.0, 6.0), (6, None, 5.0, 6.0)], "n int, k string, start_sec double, end_sec double")
    out = T.snap_to_sound(events, sounds, ["k"], block=10.0)
    assert "_block" in plan_of(out)
    assert sorted((r.n, r.start_sec, r.end_sec, r.snapped) for r in out.collect()) == [(1, 9.0, 10.0, True), (2, 9.0, 10.0, True), (3, 9.0, 10.0, True), (4, 20.0, 21.0, False), (5, 5.0, 6.0, False), (6, 5.0, 6.0, False)]


def test_lines_of_other_videos_are_not_parsed(spark, tmp_path):
    """A video's name may be spelt with escapes, and may stand in another place of a line."""
    from sightline.sources import readers as S

    lines = [r'{"\u005002-v": {"m1": {"frame_number": 1}}}', r'{"P02-v": {"m2": {"frame_number": 2}}}', r'{"P03-v": {"P02-v": {"frame_number": 3}}}', r'{"P04-v": {"m4": {"frame_number": 4}}}']
    (tmp_path / "m.json").write_text("\n".join(lines))
    found = S.masks_table(spark, str(tmp_path / "m.json"), lines=True, video_id="P02-v")
    assert sorted(r.mask_id for r in found.collect()) == ["m1", "m2"]
    assert S.json_document(spark, str(tmp_path / "m.json"), S.MASKS, True, "P02-v").count() == 3


def test_a_document_is_parsed_once(spark, tmp_path):
    from sightline.sources import readers as S

    path = tmp_path / "m.json"
    path.write_text('{"v": {"m1": {"frame_number": 1}, "m2": {"frame_number": 2}}, "w": {}, "x": null}\n{}\nnone\n')
    masks = S.masks_table(spark, str(path), lines=True)
    assert sorted((r.video_id, r.mask_id, r.frame_number) for r in masks.collect()) == [("v", "m1", 1), ("v", "m2", 2)]
    others = [S.object_tables(spark, str(path), True)[1], S.regions_table(spark, str(path), True), S.fixture_metadata(spark, str(path), True), S.merged_samples(spark, str(path), "v", True)]
    for df in [masks, *others]:
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_entries_of_a_map_share_lines(spark, tmp_path):
    """Keys and ids with quotes, braces, escapes, other alphabets and none of these; an id that occurs twice stays twice."""
    from sightline.sources import readers as S
    from sightline.sources import writers as W

    names = ['a"b', "c\\d", "}{", "é\n", "", "x"]
    want = sorted((names[n % 6], names[n // 6 % 6], names[n // 36 % 6] + str(n % 250), None if n % 7 == 0 else f"{{{n}") for n in range(600))
    rows = spark.createDataFrame(want, "p string, t string, i string, d string").coalesce(1)
    W.write_maps(rows, [F.col("p"), F.col("t")], F.col("i"), F.col("d"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() <= 72
    found = S.regions_table(spark, str(tmp_path / "r"), lines=True).collect()
    order = lambda r: tuple(x or "" for x in r)
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)
    nothing = spark.createDataFrame([], "p string, t string, i string, d string")
    W.write_maps(nothing, [F.col("p"), F.col("t")], F.col("i"), F.col("d"), str(tmp_path / "n"))
    assert S.regions_table(spark, str(tmp_path / "n"), lines=True).count() == 0
    with pytest.raises(Exception, match="key is null"):
        W.write_maps(rows, [F.lit(None).cast("string")], F.col("i"), F.col("d"), str(tmp_path / "b"))


def test_masks_share_lines(spark, monkeypatch):
    """The document of masks has at most a line for each of its videos in a batch."""
    from sightline.plans import queries_sources as Q

    seen = {}
    monkeypatch.setattr(Q.S, "masks_table", lambda spark, path, lines, f=Q.S.masks_table: seen.setdefault("rows", f(spark, seen.setdefault("path", path), lines)))
    assert Q.mask_documents(spark, "/root/testdata/sf0.001").count() > 5000
    assert spark.read.text(seen["path"]).count() <= 40 * 4
