"""Rays through grids, sums along frames, pools that grow, meshes in splits, tables that are changed in place and manifests that grow."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.functions.geometry import vec
from sightline.operators import detect as D
from sightline.operators import fixtures as X
from sightline.operators import manifest as M
from sightline.operators import rays
from sightline.sources import readers as S
from sightline.sources.keyed_table import KeyedTable


def point(p):
    return vec(*(F.lit(float(x)) for x in p))


@pytest.mark.parametrize("a, b, most", [((0, 0, 0), (1000, 0, 1000), 1002), ((0.5, 1.5, 2.5), (707.3, 411.9, -555.1), 1500), ((3, 3, 3), (3, 3, 3.5), 1), ((2, 2, 2), (-6, 2, 2), 6)])
def test_a_ray_lists_the_cells_that_it_passes(spark, a, b, most):
    cells = [tuple(x) for x in spark.range(1).select(rays.crossed_cells(point(a), point(b), F.lit(2.0)).alias("c")).first().c]
    assert len(cells) == len(set(cells)) <= most
    on_the_way = {tuple(int(x) for x in np.floor((np.array(a) + t * (np.array(b) - np.array(a))) / 2)) for t in np.linspace(0.0005, 0.9995, 999)}
    assert on_the_way <= set(cells)


def test_rays_against_triangles_of_all_sizes(spark):
    rng = np.random.default_rng(3)
    triangles = [(i % 2, *(rng.uniform(-40, 40, 3) + rng.normal(0, s, 3) for _ in range(3))) for i, s in enumerate(np.repeat([0.5, 3, 30, 200], 15))]
    lines = [(i % 2, i, rng.uniform(-60, 60, 3), rng.uniform(-60, 60, 3)) for i in range(60)]
    struct = "struct<x double, y double, z double>"
    tri = spark.createDataFrame([(s, *(tuple(map(float, v)) for v in vs)) for s, *vs in triangles], f"scene int, v0 {struct}, v1 {struct}, v2 {struct}")
    ray = spark.createDataFrame([(s, k, tuple(map(float, o)), tuple(map(float, t))) for s, k, o, t in lines], f"scene int, key int, origin {struct}, target {struct}")

    def hit(o, t, v0, v1, v2):
        way, length = (t - o) / np.linalg.norm(t - o), np.linalg.norm(t - o)
        m = np.array([-way, v1 - v0, v2 - v0]).T
        d, u, v = np.linalg.solve(m, o - v0)
        return u >= 0 and v >= 0 and u + v <= 1 and 1e-9 < d < length - rays.TOLERANCE

    got = {r.key: r.fraction for r in rays.occluded_fraction(ray, tri, "scene").collect()}
    want = {k: float(any(hit(o, t, *vs) for s2, *vs in triangles if s2 == s)) for s, k, o, t in lines}
    assert got == want and 0 < sum(want.values()) < 60


def test_scores_are_the_means_over_an_events_frames(spark):
    rng = random.Random(1)
    frames = [("p", i * 3, *(None if rng.random() < 0.1 else tuple(rng.uniform(-1, 1) for _ in "xyz") for _ in range(2))) for i in range(60)] + [("q", 4, (0.0, 0.0, 0.0), (0.0, 0.0, 1.0))] * 2
    fixtures = [("p", f"f{i}", tuple(rng.uniform(-1, 1) for _ in "xyz")) for i in range(4)] + [("p", "nowhere", None), ("q", "g", (0.0, 0.0, 2.0)), ("r", "h", (1.0, 1.0, 1.0))]
    events = [(n, rng.choice("pqr"), s := rng.uniform(-1, 6), s + rng.choice([0.0, 0.4, 3.0])) for n in range(80)]
    struct = "struct<x double, y double, z double>"
    f, x = spark.createDataFrame(frames, f"place string, frame_index int, camera {struct}, gaze {struct}"), spark.createDataFrame(fixtures, f"place string, fixture string, position {struct}")
    got = {(r.e, r.fixture): r.score for r in X.interaction_scores(spark.createDataFrame(events, "e int, place string, start_sec double, end_sec double"), f, x, ["e"], "place", 30.0).collect()}

    def look(gaze, camera, at):
        d, g = np.array(at) - np.array(camera), np.array(gaze)
        return max(0.0, float(g @ d) / float(np.linalg.norm(g) * np.linalg.norm(d))) * np.exp(-np.linalg.norm(d) / 1.5)

    want = {}
    for n, place, s, e in events:
        used = [(g, cam) for p, i, cam, g in frames if p == place and cam and g and round(s * 30) <= i <= round(e * 30)]
        for p, name, at in fixtures:
            if p == place and at and used:
                want[n, name] = np.mean([look(g, cam, at) for g, cam in used])
    assert got.keys() == want.keys() and len(want) > 50
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_a_pool_grows_until_the_quota_is_filled(spark):
    """Each call that the detector gets is counted; the first pool is enough for one key, one needs all pools and one never fills its quota."""
    @D.register("by_size")
    def by_size():
        return lambda regions: pd.DataFrame({"score": regions["rx1"] / 10.0, "x1": 1, "y1": 1, "x2": 2, "y2": 2})

    rows = []
    for key, passing in (("easy", {0, 1, 2, 3}), ("late", {3, 30}), ("never", {5}), ("few", {1})):
        n = 3 if key == "few" else 40
        rows += [(key, i, (i * 7) % n, "cup", 10 if i in passing else None if i == 6 else 1, 0, 9, 9) for i in range(n)]
    shown = D.escalated(spark.createDataFrame(rows, "k string, place int, t int, phrase string, rx1 int, ry1 int, rx2 int, ry2 int"), "by_size", ["k"], ["place"], ["t"], 2, 2, 16, visible=0.9).collect()
    for key in ("easy", "late", "never", "few"):
        own = [(p, t, x) for k, p, t, _, x, *_ in rows if k == key]
        want, accepted, low, m = [], 0, 0, 2
        while accepted < 2 and m <= 16:
            for p, t, x in sorted((r for r in own if 2 * low <= r[0] < 2 * m), key=lambda r: r[1]):
                if accepted < 2:
                    want.append((len(want) + 1, p, m, x == 10))
                    accepted += x == 10
            low, m = m, m * 2
        assert sorted((r.call, r.place, r.multiplier, r.accepted) for r in shown if r.k == key) == want
    assert {r.verdict for r in shown} == {"visible", "not_visible", "skipped"}
    assert max(r.x1 - r.rx1 for r in shown if r.rx1) == 1
    with pytest.raises(ValueError, match="multiplier"):
        D.escalated(spark.range(1), "by_size", ["id"], ["id"], ["id"], 1, 2, 1)


@pytest.mark.parametrize("split", ["128m", "150"])
def test_meshes_in_splits(spark, tmp_path, split):
    rng = random.Random(6)
    want = set()
    for name in ("a", "b"):
        lines, vertices, faces = ["# made", "o thing"], [], 0
        for _ in range(60):
            if len(vertices) < 4 or rng.random() < 0.5:
                vertices.append(tuple(float(rng.randint(-99, 99)) for _ in "xyz"))
                lines.append("v  {} {}\t{} 1.0".format(*vertices[-1]))
                lines.append("vt 0 0")
            else:
                corners = rng.sample(range(len(vertices)), rng.choice([3, 4]))
                faces += 1
                lines.append("f " + " ".join(rng.choice([f"{i + 1}", f"{i + 1}/7", f"{i + 1}//3", f"{i - len(vertices)}"]) for i in corners))
                want |= {(name, faces, k - 1, vertices[corners[0]], vertices[corners[k - 1]], vertices[corners[k]]) for k in range(2, len(corners))}
        (tmp_path / f"{name}.obj").write_text("\n".join([*lines, "f 1 2 999"]) + "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        text = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
        got = {(r.path[-5], r.face, r.part, tuple(r.v0), tuple(r.v1), tuple(r.v2)) for r in S.mesh_triangles(spark, str(tmp_path), F.lit("P01")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and (text > 3) == (split == "150")


def test_an_upsert_leaves_the_other_buckets_files(spark, tmp_path):
    files = lambda: {p.relative_to(tmp_path) for p in tmp_path.rglob("*.parquet")}
    t = KeyedTable(str(tmp_path / "t"), "k", 16)
    t.write(spark.createDataFrame([(i, f"old {i}", i) for i in range(200)] + [(3, "older", -1)], "k int, v string, at int"), ["at"])
    before = files()
    changes = spark.createDataFrame([(3, "new", 2), (3, "newer", 5), (999, "added", 1)], "k int, v string, at int")
    n = t.upsert(changes, ["at"])
    assert n in (1, 2)
    kept = before & files()
    assert len({p.parent for p in before - kept}) <= n and len(kept) >= len(before) - n
    want = {i: f"old {i}" for i in range(200)} | {3: "newer", 999: "added"}
    assert {r.k: r.v for r in t.read(spark).collect()} == want and t.read(spark).count() == 201
    assert t.upsert(changes.limit(0), ["at"]) == 0
    assert t.upsert(spark.createDataFrame([(5, 1.0)], "k int, x double"), ["x"]) == 1
    with pytest.raises(Exception, match="a row without k"):
        t.upsert(spark.createDataFrame([(None, "x", 1)], "k int, v string, at int"), ["at"])
    assert {r.k: r.v for r in t.read(spark).collect()} == want | {5: None}


def test_a_manifest_keeps_what_it_has(spark):
    rows = [(s, "v", str(i), "cup", float(i), float(i) + 2) for s in ("seen", "gone", "moving") for i in range(9)]
    pool = spark.createDataFrame(rows, "status string, video_id string, assoc_id string, object_name string, start_sec double, end_sec double")
    first = M.extended(None, pool, ["seen", "nothing"], 4, 2, 30.0, 1)
    grown = M.extended(first, pool.repartition(3), ["moving", "seen"], 4, 2, 30.0, 1)
    plain = lambda rows: [(*r[:8], str(r.frames), *r[9:]) for r in rows.collect()]
    got = plain(grown)
    assert set(plain(first)) < set(got) and len(got) == 16 and {r[1] for r in got} == {"seen", "moving"}
    assert set(plain(M.extended(None, pool, ["seen", "moving"], 4, 2, 30.0, 1))) == set(got)
    assert len({r[2] for r in got}) == 16 and all(len(r.frames) == 1 and r.frames[0].image_path == f"frames/{r.status}/{r.item_id}.jpg" for r in grown.collect())
    whole = M.extended(None, pool, ["gone"], 4, 2, 30.0, 1, by_interval=True).collect()
    assert len(whole) == 4 and all(len(r.frames) == 2 and r.frames[0].time_sec < r.frames[1].time_sec for r in whole)
    for change in ({"seed": 2}, {"config": {"vocabulary": True}}, {"pool": pool.limit(20)}):
        with pytest.raises(ValueError, match="another pool"):
            M.extended(first, change.get("pool", pool), ["gone"], 4, 2, 30.0, change.get("seed", 1), config=change.get("config"))
