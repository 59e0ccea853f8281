"""Queries without SQL use whole tables."""

import pytest

from sightline.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_places_are_projected_from_the_poses_of_all_frames(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        turn, other = (0.6, 0.8) if r.vec_id % 2 == 0 else (0.8, -0.6)
        e = [float(x) for x in r.embedding]
        want[r.vec_id] = -other * e[0] + turn * e[2] + e[14]
    got = {r.frame_index: r.z for r in QUERIES["jn30_jn34_projected_at_frame"](spark, SF).collect()}
    assert got.keys() <= want.keys() and len(got) == len(want)
    assert all(got[i] == pytest.approx(want[i], abs=1e-4) for i in want)
