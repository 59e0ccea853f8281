"""Skylines, as-of joins by time blocks, lookups within a tolerance and scans in chunks, against all pairs and loops."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import islands as I
from sightline.operators import scan
from sightline.operators import temporal as T


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(9)
    spans = [(rng.choice(["a", "b", None]), i, float(s := rng.randint(-20, 60)), None if rng.random() < 0.1 else s + rng.choice([0.0, 1.0, 7.5, 30.0, 100.0]), rng.randint(0, 4)) for i in range(150)]
    points = [(rng.choice(["a", "b", "c", None]), i, rng.choice([None, rng.randint(-200, 700) / 8])) for i in range(500)]
    points += points[:20]
    return (
        spans, points, spark.createDataFrame(spans, "k string, span int, s double, e double, strength int").repartition(3),
        spark.createDataFrame(points, "k string, i int, t double").repartition(3),
    )


@pytest.mark.parametrize("bucket", [4.0, 1000.0])
@pytest.mark.parametrize("eps", [0.0, 0.25])
def test_the_strongest_span_that_holds_a_time(cases, bucket, eps):
    spans, points, s, p = cases
    rank = [-F.col("s_strength"), F.col("s_span")]
    got = T.stab_strongest(p, s, ["k"], "t", "s", "e", rank, eps, bucket).collect()
    assert len(got) == len(points)
    for r in got:
        held = [(-w, n, a, e) for k, n, a, e, w in spans if r.t is not None and r.k is not None and k == r.k and a - eps <= r.t and (e is None or r.t <= e + eps)]
        best = min(held, default=(None, None, None, None))
        assert (r.s_span, r.s_s, r.s_e) == best[1:], r


def test_pieces_are_disjoint_and_few(cases):
    spans, _, s, p = cases
    pieces = T.skyline(s, p, ["k"], "t", "s", "e", [-F.col("s_strength"), F.col("s_span")], bucket=1e6).collect()
    for k in ("a", "b"):
        times = sorted(r["_from"] for r in pieces if r.k == k)
        assert len(set(times)) == len(times) <= 2 * 2 * sum(x[0] == k for x in spans)


@pytest.mark.parametrize("block", [None, 3.0, 50.0])
def test_as_of_in_blocks(cases, block):
    spans, points, s, p = cases
    right = s.select("k", "s", "span")
    both = T.asof_both(p, (right, "s", ["span"], False, "at"), (right, "s", ["span"], True, "after"), ["k"], "t", block)
    out = T.asof_join(T.asof_join(both, right, ["k"], "t", "s", ["span"], strict=True, name="before", block=block), right, ["k"], "t", "s", ["span"], "forward", name="next", block=block).collect()
    assert len(out) == len(points)
    for r in out:
        same = [(x[2], x[1]) for x in spans if x[0] == r.k] if r.t is not None else []
        want = [max((x for x in same if x[0] <= r.t), default=None), min((x for x in same if x[0] > r.t), default=None), max((x for x in same if x[0] < r.t), default=None), min((x for x in same if x[0] >= r.t), default=None)]
        assert [m and (m.s, m.span) for m in (r["at"], r.after, r.before, r.next)] == want
    near = T.nearest_join(p, right, ["k"], "t", "s", ["span"], block=block).collect()
    assert all((r.match is None) == (r.t is None or r.k not in {x[0] for x in spans}) for r in near)
    samples = p.where("t is not null").withColumn("flag", F.col("i") % 3 == 0)
    for r in I.last_true_time(samples, ["k"], [], "t", F.col("flag"), "seen", block=block).collect():
        assert r.seen == max((t for k, i, t in points if k == r.k and t is not None and i % 3 == 0 and t < r.t), default=None)


def test_times_that_are_the_same_within_a_tolerance(spark):
    left = [("a", i, t) for i, t in enumerate([1.0, 1.0 + 9e-7, 1.0 - 9e-7, 1.0 + 2.1e-6, None, 7.0, 7.0])] + [("b", 9, 1.0), (None, 10, 1.0)]
    right = [("a", 1.0, 5), ("a", 1.0, 3), ("a", 1.0000004, 1), ("a", 7.0, 2), ("a", None, 8)]
    out = T.exact_join(spark.createDataFrame(left, "k string, i int, t double"), spark.createDataFrame(right, "k string, at double, x int"), ["k"], "t", "at", ["x"])
    got = sorted((r.i, r.match and r.match.x) for r in out.collect())
    assert got == [(0, 3), (1, 3), (2, 3), (3, None), (4, None), (5, 2), (6, 2), (9, None), (10, None)]


def test_positions_of_one_long_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("few").cast("string")).when(F.col("id") % 500 != 1, F.lit("most")).alias("k"), (F.col("id") * 7919 % 5003).alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {}
        for r in scan.positions(rows, ["k"], ["o"], "n").collect():
            got.setdefault(r.k, []).append((r.o, r.n))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {"few", "most", None}
    for each in got.values():
        assert [n for _, n in sorted(each)] == list(range(len(each)))


@pytest.mark.parametrize("alpha", [1.0, 0.99, 0.7, 0.1, 0.001])
def test_average_in_chunks(spark, alpha):
    rng = random.Random(2)
    rows = [(k, i, None if rng.random() < 0.05 else rng.uniform(-5, 5)) for k, n in (("long", 3000), ("short", 3), (None, 2)) for i in range(n)]
    got = {(r.k, r.i): r.m for r in scan.exponential_average(spark.createDataFrame(rows, "k string, i int, x double").repartition(4), ["k"], ["i"], "x", alpha, "m").collect()}
    state = {}
    for k, i, x in rows:
        if x is None:
            assert got[k, i] is None
            continue
        state[k] = x if k not in state else alpha * x + (1 - alpha) * state[k]
        assert got[k, i] == pytest.approx(state[k], rel=1e-9, abs=1e-9)
    assert len(got) == len(rows)
    with pytest.raises(ValueError, match="alpha"):
        scan.exponential_average(spark.range(1), [], ["id"], "id", 0.0, "m")


def test_intervals_that_are_equal_but_for_their_id(spark):
    rows = [("a", 2, 0.0, 5.0), ("a", 1, 0.0, 5.0), ("a", 3, 0.0, 5.0), ("a", 4, 5.0, 6.0)]
    s = spark.createDataFrame(rows, "k string, span int, start_sec double, end_sec double").withColumn("status", F.lit("in_view"))
    got = sorted(r.span for r in I.interval_violations(s, ["k"], ["in_view"], order=["span"]).collect())
    assert got == [2, 3]
