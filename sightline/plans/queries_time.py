"""Queries of the time operators: lookups, stabbing joins, runs and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.statuses import is_stable, is_visible, priority, status_ladder
from ..operators import islands as I
from ..operators import scan
from ..operators import temporal as T
from ..operators.visibility import classified_samples, coarse_intervals, merged_tracks, run_stages
from . import adapters as A
from .registry import query

OBJ = ["assoc_id"]
PRIORITY_SQL = "CASE {s} WHEN 'occluded_inside_closed_fixture' THEN 70 WHEN 'geometrically_occluded' THEN 60 WHEN 'observed_not_visible_in_open_fixture' THEN 50 WHEN 'out_of_view' THEN 40 WHEN 'in_motion' THEN 30 WHEN 'observed_visible_in_open_fixture' THEN 20 WHEN 'in_view' THEN 10 ELSE 0 END"
VISIBLE_SQL = "status IN ('in_view', 'observed_visible_in_open_fixture', 'in_motion')"
STABLE_SQL = "status IN ('in_view', 'observed_visible_in_open_fixture')"
RANK_SQL = "CASE {t} WHEN 'very_low' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'very_high' THEN 4 WHEN 'assumed_closed' THEN 4 ELSE -1 END"


@query("flt7_flt8_status_ladder", f"""
SELECT event_id, CASE WHEN raw_status = 'in_motion' THEN 'in_motion' WHEN NOT has_data THEN 'unobservable_no_data' WHEN NOT in_view THEN 'out_of_view'
  WHEN k % 3 = 0 AND {RANK_SQL.format(t='tier')} >= 2 THEN 'occluded_inside_closed_fixture' WHEN k % 3 = 1 THEN 'potentially_visible_inside_open_fixture'
  WHEN occluded THEN 'geometrically_occluded' ELSE 'in_view' END AS status, {RANK_SQL.format(t='tier')} AS confidence_rank FROM samples""", A.SAMPLES)
def status_ladder_query(spark, d):
    from ..functions.statuses import confidence_rank

    state = F.when(F.col("k") % 3 == 0, "closed").when(F.col("k") % 3 == 1, "open")
    rung = status_ladder(F.col("raw_status") == "in_motion", F.col("has_data"), F.col("in_view"), state, F.col("tier"), F.col("occluded"))
    return A.samples(spark, d).select("event_id", rung["status"].alias("status"), confidence_rank(F.col("tier")).alias("confidence_rank"))


@query("win1_run_collapse_bool", """
SELECT assoc_id, run, in_view, min(time_sec) AS start_sec, max(time_sec) AS end_sec, count(*) AS n_samples FROM (
  SELECT *, sum(c) OVER (PARTITION BY assoc_id ORDER BY time_sec, event_id) AS run FROM (
    SELECT *, CASE WHEN in_view IS DISTINCT FROM lag(in_view, 1, in_view) OVER (PARTITION BY assoc_id ORDER BY time_sec, event_id) THEN 1 ELSE 0 END AS c FROM samples))
GROUP BY assoc_id, run, in_view""", A.SAMPLES)
def run_collapse_bool(spark, d):
    return I.collapse_runs(A.samples(spark, d), OBJ, ["time_sec", "event_id"], "time_sec", "in_view")


RUNS_SQL = """runs AS (
  SELECT video_id, assoc_id, run, status, min(time_sec) AS start_sec, max(time_sec) AS end_sec, count(*) AS n_samples, arg_min(coalesce(fixture, ''), (time_sec, event_id)) AS fixture FROM (
  SELECT *, sum(c) OVER (PARTITION BY video_id, assoc_id ORDER BY time_sec, event_id) AS run FROM (
    SELECT *, CASE WHEN status IS DISTINCT FROM lag(status, 1, status) OVER (PARTITION BY video_id, assoc_id ORDER BY time_sec, event_id) THEN 1 ELSE 0 END AS c FROM samples))
  GROUP BY video_id, assoc_id, run, status)"""


def status_runs(spark, d):
    s = A.samples(spark, d).withColumn("fixture", F.coalesce("fixture", F.lit("")))
    return I.collapse_runs(s, ["video_id", "assoc_id"], ["time_sec", "event_id"], "time_sec", "status", ["fixture"])


query("win2_run_collapse_status", "SELECT * FROM runs", A.SAMPLES, RUNS_SQL)(status_runs)


@query("win3_win4_last_visible_index", f"""
SELECT event_id, last_value(CASE WHEN {VISIBLE_SQL} THEN i END IGNORE NULLS) OVER (PARTITION BY assoc_id ORDER BY time_sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_index,
  last_value(CASE WHEN {VISIBLE_SQL} THEN i END IGNORE NULLS) OVER (PARTITION BY assoc_id ORDER BY time_sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS index_before FROM samples""", A.SAMPLES)
def last_visible_index(spark, d):
    s, o = A.samples(spark, d), ["time_sec", "event_id"]
    s = I.last_true_index(s, OBJ, o, "i", is_visible(F.col("status")), "last_index")
    return I.last_true_index(s, OBJ, o, "i", is_visible(F.col("status")), "index_before", inclusive=False).select("event_id", "last_index", "index_before")


@query("win7_win9_win18_last_visible_time", f"""
SELECT s.event_id, max(CASE WHEN {VISIBLE_SQL.replace('status', 'b.status')} THEN b.time_sec END) AS seen_sec, max(CASE WHEN {STABLE_SQL.replace('status', 'b.status')} THEN b.time_sec END) AS stable_sec
FROM samples s LEFT JOIN samples b ON s.assoc_id = b.assoc_id AND b.time_sec < s.time_sec GROUP BY s.event_id""", A.SAMPLES)
def last_visible_time(spark, d):
    s = I.last_true_time(A.samples(spark, d), OBJ, [], "time_sec", is_visible(F.col("status")), "seen_sec", block=500.0)
    return I.last_true_time(s, OBJ, [], "time_sec", is_stable(F.col("status")), "stable_sec", block=500.0).select("event_id", "seen_sec", "stable_sec")


@query("win8_last_stable_in_clip", f"""
SELECT s.event_id, max(b.time_sec) AS last_stable_sec FROM samples s
LEFT JOIN samples b ON s.assoc_id = b.assoc_id AND b.time_sec <= s.time_sec AND {STABLE_SQL.replace('status', 'b.status')} AND b.time_sec >= s.time_sec - 40 - 1e-9 GROUP BY s.event_id""", A.SAMPLES)
def last_stable_in_clip(spark, d):
    s = A.samples(spark, d)
    out = T.asof_join(s.select("assoc_id", "event_id", "time_sec"), s.where(is_stable(F.col("status"))).select("assoc_id", F.col("time_sec").alias("stable_sec")), OBJ, "time_sec", "stable_sec")
    t = F.col("match")["stable_sec"]
    return out.select("event_id", F.when(t >= F.col("time_sec") - 40 - T.EPS, t).alias("last_stable_sec"))


@query("win10_stable_window_3s", f"""
SELECT s.event_id, count(b.time_sec) AS n_near, min(b.time_sec) AS first_near, max(b.time_sec) AS last_near FROM samples s
LEFT JOIN samples b ON s.assoc_id = b.assoc_id AND b.time_sec BETWEEN s.time_sec - 3 AND s.time_sec + 3 AND {STABLE_SQL.replace('status', 'b.status')} GROUP BY s.event_id""", A.SAMPLES)
def stable_window(spark, d):
    s = I.within_seconds(A.samples(spark, d), OBJ, "time_sec", is_stable(F.col("status")), 3.0, "near")
    return s.select("event_id", F.size("near").cast("long").alias("n_near"), F.array_min("near").alias("first_near"), F.array_max("near").alias("last_near"))


@query("win5_agg6_relocation_counts", """
SELECT supp AS place, count(*) AS n, count(CASE WHEN fixture <> pf THEN 1 END) AS n_transitions,
  count(CASE WHEN sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) >= 0.15 THEN 1 END) AS n_shifts FROM (
  SELECT *, lag(fixture) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM (SELECT *, track_id % 150 AS supp FROM masks WHERE x IS NOT NULL)
  WINDOW w AS (PARTITION BY supp ORDER BY track_id, frame_number)) GROUP BY supp""", A.MASKS)
def relocation_counts(spark, d):
    from ..operators.aggregates import relocations

    m = A.masks(spark, d).withColumn("place", F.col("track_id") % 150)
    return relocations(m, ["place"], ["track_id", "frame_number"]).drop("total")


@query("win6_open_close_states", """
SELECT assoc_id, state, end_sec AS start_time, coalesce(lead(end_sec) OVER (PARTITION BY assoc_id ORDER BY start_sec, end_sec, state), 2500.0) AS end_time, false AS backfilled FROM kept
UNION ALL SELECT assoc_id, CASE state WHEN 'open' THEN 'closed' ELSE 'open' END, 0.0, end_sec, true FROM (SELECT *, row_number() OVER (PARTITION BY assoc_id ORDER BY start_sec, end_sec, state) AS rn FROM kept) WHERE rn = 1""",
A.SPANS, """kept AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY assoc_id ORDER BY start_sec, end_sec, state) AS before FROM spans WHERE end_sec IS NOT NULL) WHERE before IS NULL OR before <> state)""")
def open_close_states(spark, d):
    s = A.spans(spark, d).where("end_sec is not null").select("assoc_id", "state", "start_sec", "end_sec")
    return I.open_close_intervals(s, s.select("assoc_id").distinct().withColumn("video_end", F.lit(2500.0)), OBJ)


@query("win15_ema_smoother", """
SELECT event_id, round(smooth + 1e-10, 6) AS smooth FROM ema""", "RECURSIVE " + A.SAMPLES.strip(), """ema AS (
  SELECT assoc_id, i, event_id, score AS smooth FROM samples WHERE i = 0 UNION ALL
  SELECT s.assoc_id, s.i, s.event_id, CAST(0.7 AS DOUBLE) * s.score + (1 - CAST(0.7 AS DOUBLE)) * e.smooth FROM ema e JOIN samples s ON s.assoc_id = e.assoc_id AND s.i = e.i + 1)""")
def ema_smoother(spark, d):
    """Chunks of the history are summed up by themselves; decimal ties are moved off, as sums in another order differ in the last bit."""
    return scan.exponential_average(A.samples(spark, d).select("assoc_id", "event_id", "time_sec", "score"), OBJ, ["time_sec", "event_id"], "score", 0.7, "smooth").select("event_id", F.round(F.col("smooth") + 1e-10, 6).alias("smooth"))


@query("flt22_interval_invariants", """
SELECT span_id, rule FROM (SELECT span_id, unnest([CASE WHEN status NOT IN ('in_view', 'out_of_view') THEN 'unknown_status' END, CASE WHEN end_sec < start_sec THEN 'negative_length' END,
  CASE WHEN lag(end_sec) OVER (PARTITION BY assoc_id ORDER BY start_sec, end_sec, span_id) > start_sec THEN 'overlap' END, CASE WHEN rank < 0 THEN 'negative_count' END]) AS rule FROM spans WHERE end_sec IS NOT NULL) WHERE rule IS NOT NULL""", A.SPANS)
def interval_invariants(spark, d):
    s = A.spans(spark, d).where("end_sec is not null")
    return I.interval_violations(s, OBJ, ["in_view", "out_of_view"], ["rank"], ["span_id"]).select("span_id", "rule")


@query("jn1_track_choice", """
SELECT s.event_id, coalesce(i.track_id, p.track_id, f.track_id) AS track_id, CASE WHEN i.track_id IS NOT NULL THEN 'in_motion' WHEN p.track_id IS NOT NULL THEN 'past' WHEN f.track_id IS NOT NULL THEN 'future' ELSE 'no_track_available' END AS relation
FROM samples s
LEFT JOIN (SELECT s.event_id, arg_min(t.track_id, t.track_pos) AS track_id FROM samples s JOIN tracks t ON s.assoc_id = t.assoc_id AND s.time_sec BETWEEN t.start_sec AND t.end_sec GROUP BY 1) i USING (event_id)
LEFT JOIN (SELECT s.event_id, arg_max(t.track_id, (t.end_sec, -t.track_pos)) AS track_id FROM samples s JOIN tracks t ON s.assoc_id = t.assoc_id AND t.end_sec < s.time_sec GROUP BY 1) p USING (event_id)
LEFT JOIN (SELECT s.event_id, arg_min(t.track_id, (t.start_sec, t.track_pos)) AS track_id FROM samples s JOIN tracks t ON s.assoc_id = t.assoc_id AND t.start_sec > s.time_sec GROUP BY 1) f USING (event_id)""", A.SAMPLES, A.TRACKS)
def track_choice(spark, d):
    return T.choose_track(A.samples(spark, d).select("assoc_id", "event_id", "time_sec"), A.tracks(spark, d), OBJ, "time_sec").select("event_id", "track_id", "relation")


@query("jn2_jn21_mask_pick", """
SELECT track_id, arg_max(frame_number, (frame_number, -mask_pos)) AS last_frame, arg_max(fixture, (frame_number, -mask_pos)) AS last_fixture, arg_min(frame_number, (frame_number, mask_pos)) AS first_frame
FROM masks WHERE track_id IN (SELECT track_id FROM tracks) GROUP BY track_id""", A.MASKS, A.TRACKS)
def mask_pick(spark, d):
    t, m = A.tracks(spark, d), A.masks(spark, d).select("track_id", "frame_number", "mask_pos", "fixture")
    last = T.pick_mask(t, m).select("track_id", F.col("frame_number").alias("last_frame"), F.col("fixture").alias("last_fixture"))
    return last.join(T.pick_mask(t, m, last=False).select("track_id", F.col("frame_number").alias("first_frame")), "track_id")


def nearest_sql(tie: str, tolerance: str = "") -> str:
    order = "(abs(b.t - s.time_sec), -b.t)" if tie == "later" else "(abs(b.t - s.time_sec), b.t)"
    return f"""
SELECT s.event_id, arg_min(b.t, {order}) AS nearest_sec FROM samples s LEFT JOIN (SELECT DISTINCT assoc_id, start_sec AS t FROM spans) b ON s.assoc_id = b.assoc_id {tolerance} GROUP BY s.event_id"""


def nearest(spark, d, tie, tolerance=None, block=None):
    s, b = A.samples(spark, d).select("assoc_id", "event_id", "time_sec"), A.spans(spark, d).select("assoc_id", F.col("start_sec").alias("t")).distinct()
    return T.nearest_join(s, b, OBJ, "time_sec", "t", tie=tie, tolerance=tolerance, block=block).select("event_id", F.col("match")["t"].alias("nearest_sec"))


@query("jn3_asof_nearest_late_tie", nearest_sql("later"), A.SAMPLES, A.SPANS)
def nearest_late(spark, d):
    return nearest(spark, d, "later")


@query("jn4_jn14_asof_nearest_first_tie", nearest_sql("earlier"), A.SAMPLES, A.SPANS)
def nearest_first(spark, d):
    return nearest(spark, d, "earlier", block=600.0)


@query("jn12_flt21_nearest_within_tolerance", nearest_sql("earlier", "AND abs(b.t - s.time_sec) <= 0.51"), A.SAMPLES, A.SPANS)
def nearest_tolerance(spark, d):
    return nearest(spark, d, "earlier", max(1e-6, 0.51), block=600.0)


@query("jn5_jn7_stab_first_match", """
SELECT s.event_id, arg_min(p.span_id, (p.start_sec, p.span_id)) AS span_id FROM samples s JOIN spans p ON s.assoc_id = p.assoc_id AND p.start_sec <= s.time_sec AND (p.end_sec IS NULL OR s.time_sec <= p.end_sec) GROUP BY s.event_id""", A.SAMPLES, A.SPANS)
def stab_first(spark, d):
    p = A.spans(spark, d).select("assoc_id", "span_id", "start_sec", "end_sec")
    held = T.stab_first(A.samples(spark, d).select("assoc_id", "event_id", "time_sec"), p, OBJ, "time_sec", "start_sec", "end_sec", ["span_id"], bucket=16.0)
    return held.where("s_span_id is not null").select("event_id", F.col("s_span_id").alias("span_id"))


@query("jn6_stab_last_started", """
SELECT s.event_id, CASE WHEN b.end_sec IS NULL OR b.end_sec >= s.time_sec THEN b.span_id END AS span_id FROM samples s
LEFT JOIN (SELECT s.event_id, arg_max(p, (p.start_sec, coalesce(p.end_sec, -1e9), p.span_id)) AS b FROM samples s JOIN spans p ON s.assoc_id = p.assoc_id AND p.start_sec <= s.time_sec GROUP BY 1) USING (event_id)""", A.SAMPLES, A.SPANS)
def stab_last_started(spark, d):
    p = A.spans(spark, d).select("assoc_id", "span_id", "start_sec", "end_sec", F.coalesce("end_sec", F.lit(-1e9)).alias("e"))
    out = T.asof_join(A.samples(spark, d).select("assoc_id", "event_id", "time_sec"), p, OBJ, "time_sec", "start_sec", order=["start_sec", "e", "span_id"])
    m = F.col("match")
    return out.select("event_id", F.when(m["end_sec"].isNull() | (m["end_sec"] >= F.col("time_sec")), m["span_id"]).alias("span_id"))


@query("jn8_stab_priority", f"""
SELECT s.event_id, coalesce(arg_max(p.status, ({PRIORITY_SQL.format(s='p.status')}, -(p.end_sec - p.start_sec), p.start_sec)), 'out_of_view') AS status FROM samples s
LEFT JOIN (SELECT * FROM spans WHERE end_sec IS NOT NULL) p ON s.assoc_id = p.assoc_id AND s.time_sec BETWEEN p.start_sec - 1e-9 AND p.end_sec + 1e-9 GROUP BY s.event_id""", A.SAMPLES, A.SPANS)
def stab_priority(spark, d):
    p = A.spans(spark, d).where("end_sec is not null").select("assoc_id", "start_sec", "end_sec", "status")
    return T.strongest_span(A.samples(spark, d).select("assoc_id", "event_id", "time_sec"), p, OBJ, "time_sec", priority(F.col("s_status"))).select("event_id", "status")


@query("jn9_sound_snap", """
SELECT t.track_id, coalesce(b.s, t.start_sec) AS start_sec, coalesce(b.e, t.end_sec) AS end_sec, b.s IS NOT NULL AS snapped FROM tracks t
LEFT JOIN (SELECT t.track_id, arg_min({'s': n.s, 'e': n.e}, (abs(n.mid - (t.start_sec + t.end_sec) / 2), n.mid, n.s, n.e)) AS b FROM tracks t
  JOIN (SELECT assoc_id, time_sec AS s, time_sec + 0.5 AS e, (time_sec + (time_sec + 0.5)) / 2 AS mid FROM samples) n
  ON t.assoc_id = n.assoc_id AND abs(n.mid - (t.start_sec + t.end_sec) / 2) <= 1.5 GROUP BY 1) USING (track_id)""", A.SAMPLES, A.TRACKS)
def sound_snap(spark, d):
    sounds = A.samples(spark, d).select("assoc_id", F.col("time_sec").alias("start_sec"), (F.col("time_sec") + 0.5).alias("stop_sec"))
    return T.snap_to_sound(A.tracks(spark, d).select("assoc_id", "track_id", "start_sec", "end_sec"), sounds, OBJ).select("track_id", "start_sec", "end_sec", "snapped")


@query("jn13_jn15_exact_time_lookup", "SELECT s.event_id, count(b.span_id) AS n FROM samples s JOIN spans b ON s.assoc_id = b.assoc_id AND round(s.time_sec, 0) = round(b.start_sec, 0) GROUP BY s.event_id", A.SAMPLES, A.SPANS)
def exact_time(spark, d):
    s = A.samples(spark, d).select("assoc_id", "event_id", F.round("time_sec", 0).alias("t"))
    return s.join(A.spans(spark, d).select("assoc_id", F.round("start_sec", 0).alias("t")), ["assoc_id", "t"]).groupBy("event_id").agg(F.count("*").alias("n"))


@query("jn13_epsilon_lookup", """
SELECT s.event_id, arg_min(b.span_id, (b.start_sec, b.rank, b.span_id)) AS span_id, min(b.start_sec) AS start_sec
FROM (SELECT event_id, assoc_id, round(time_sec, 0) + (k % 5 - 2) * 6e-7 AS t FROM samples) s LEFT JOIN spans b ON s.assoc_id = b.assoc_id AND abs(b.start_sec - s.t) <= 1e-6 GROUP BY s.event_id""", A.SAMPLES, A.SPANS)
def epsilon_lookup(spark, d):
    """Times that are up to 1.2e-6 off whole seconds find the span that starts then, if they are within 1e-6."""
    s = A.samples(spark, d).select("assoc_id", "event_id", (F.round("time_sec", 0) + (F.col("k") % 5 - 2) * F.lit(6e-7)).alias("t"))
    b = A.spans(spark, d).select("assoc_id", "span_id", "start_sec", "rank")
    found = T.exact_join(s, b, OBJ, "t", "start_sec", ["rank", "span_id"])
    return found.select("event_id", F.col("match")["span_id"].alias("span_id"), F.col("match")["start_sec"].alias("start_sec"))


LONG = "w AS (SELECT assoc_id % 4 AS video, event_id, time_sec FROM samples), v AS (SELECT assoc_id % 4 AS video, start_sec AS t, min(span_id) AS first_id, max(span_id) AS last_id FROM spans GROUP BY 1, 2)"


@query("jn3_jn4_win7_long_keys", """
SELECT w.event_id, arg_min(v.t, (abs(v.t - w.time_sec), -v.t)) AS nearest_sec, max(CASE WHEN v.t < w.time_sec THEN v.t END) AS before_sec, arg_max(v.last_id, CASE WHEN v.t <= w.time_sec THEN v.t END) AS last_id,
  arg_min(v.first_id, CASE WHEN v.t >= w.time_sec THEN v.t END) AS next_id FROM w LEFT JOIN v ON w.video = v.video GROUP BY w.event_id""", A.SAMPLES, A.SPANS, LONG)
def long_keys(spark, d):
    """Four keys hold all rows, which time blocks split over tasks."""
    s = A.samples(spark, d).select((F.col("assoc_id") % 4).alias("video"), "event_id", "time_sec")
    b = A.spans(spark, d).select((F.col("assoc_id") % 4).alias("video"), F.col("start_sec").alias("t"), "span_id")
    out = T.nearest_join(s, b, ["video"], "time_sec", "t", ["span_id"], name="near", block=50.0).withColumn("nearest_sec", F.col("near")["t"]).drop("near")
    out = T.asof_both(out, (b, "t", ["span_id"], False, "at"), (b, "t", ["span_id"], False, "next"), ["video"], "time_sec", block=50.0)
    out = out.withColumn("last_id", F.col("at")["span_id"]).withColumn("next_id", F.col("next")["span_id"]).drop("at", "next")
    out = T.asof_join(out, b, ["video"], "time_sec", "t", ["span_id"], strict=True, name="before", block=50.0)
    return out.select("event_id", "nearest_sec", F.col("before")["t"].alias("before_sec"), "last_id", "next_id")


@query("jn17_jn18_other_objects_with_past_track", f"""
SELECT s.event_id, count(DISTINCT o.assoc_id) AS n_others FROM samples s JOIN samples o ON s.video_id = o.video_id AND s.assoc_id <> o.assoc_id AND floor(s.time_sec) = floor(o.time_sec) AND {STABLE_SQL.replace('status', 'o.status')}
JOIN (SELECT assoc_id, min(end_sec) AS first_end FROM tracks GROUP BY 1) t ON t.assoc_id = o.assoc_id AND t.first_end <= o.time_sec + 1e-9 GROUP BY s.event_id""", A.SAMPLES, A.TRACKS)
def other_objects(spark, d):
    s = A.samples(spark, d).withColumn("t", F.floor("time_sec"))
    done = A.tracks(spark, d).groupBy("assoc_id").agg(F.min("end_sec").alias("first_end"))
    o = s.where(is_stable(F.col("status"))).join(done, "assoc_id").where(F.col("first_end") <= F.col("time_sec") + T.EPS).select("video_id", "t", F.col("assoc_id").alias("other"))
    # Objects of a video and second are counted once, and each sample takes off its own.
    there = o.distinct().groupBy("video_id", "t").agg(F.count("*").alias("n"))
    own = o.distinct().select("video_id", "t", F.col("other").alias("assoc_id"), F.lit(1).alias("own"))
    out = s.join(there, ["video_id", "t"]).join(own, ["video_id", "t", "assoc_id"], "left").select("event_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n_others"))
    return out.where("n_others > 0")


@query("jn19_overlap_exists", """
SELECT p.event_id, NOT EXISTS (SELECT 1 FROM tracks t WHERE t.assoc_id = p.assoc_id) OR EXISTS (SELECT 1 FROM tracks t WHERE t.assoc_id = p.assoc_id AND t.start_sec <= p.time_sec + 1 AND t.end_sec >= p.time_sec - 1) AS overlaps
FROM samples p""", A.SAMPLES, A.TRACKS)
def overlap_exists(spark, d):
    p = A.samples(spark, d).select("assoc_id", "event_id", (F.col("time_sec") - 1).alias("from_sec"), (F.col("time_sec") + 1).alias("to_sec"))
    return T.overlapping(p, A.tracks(spark, d), OBJ, "from_sec", "to_sec").select("event_id", "overlaps")


@query("jn20_placement_before", """
SELECT p.span_id, arg_max(t.track_id, (t.end_sec, t.track_id)) AS track_id, CASE WHEN max(t.end_sec) IS NOT NULL THEN greatest(max(t.end_sec), arg_max(coalesce(m.sec, -1), (t.end_sec, t.track_id))) END AS placement_sec FROM spans p
LEFT JOIN tracks t ON p.assoc_id = t.assoc_id AND t.end_sec <= p.start_sec LEFT JOIN (SELECT track_id, max(frame_number) / 30.0 AS sec FROM masks GROUP BY 1) m USING (track_id)
GROUP BY p.span_id""", A.TRACKS, A.MASKS)
def placement_before(spark, d):
    p = A.spans(spark, d).select("assoc_id", "span_id", "start_sec")
    return T.placement_before(p, A.tracks(spark, d).select("assoc_id", "track_id", "end_sec"), A.masks(spark, d), OBJ, "start_sec").select("span_id", "track_id", "placement_sec")


@query("jn22_flt9_merged_tracks", f"""
SELECT event_id, status, visible, stable, last_value(CASE WHEN visible THEN i END IGNORE NULLS) OVER (PARTITION BY assoc_id ORDER BY time_sec, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_visible_index FROM (
  SELECT *, {VISIBLE_SQL} AS visible, {STABLE_SQL} AS stable FROM (
    SELECT s.event_id, s.assoc_id, s.time_sec, s.i, coalesce(CASE WHEN p.end_sec >= s.time_sec THEN p.status END, CASE WHEN raw_status = 'in_motion' THEN 'in_motion' WHEN NOT in_view THEN 'out_of_view' ELSE raw_status END) AS status FROM samples s
    LEFT JOIN (SELECT s.event_id, arg_max(p.end_sec, (p.start_sec, p.end_sec, p.status)) AS end_sec, arg_max(p.status, (p.start_sec, p.end_sec, p.status)) AS status
      FROM samples s JOIN spans p ON s.assoc_id = p.assoc_id AND p.end_sec IS NOT NULL AND p.start_sec <= s.time_sec GROUP BY 1) p USING (event_id)))""", A.SAMPLES, A.SPANS)
def merged(spark, d):
    s = A.samples(spark, d).select("assoc_id", "event_id", "i", "time_sec", "raw_status", "in_view")
    return merged_tracks(s, A.spans(spark, d).where("end_sec is not null").select("assoc_id", "start_sec", "end_sec", "status"), OBJ).select("event_id", "status", "visible", "stable", "last_visible_index")


@query("jn23_placeholder_anti", """
SELECT 'v' || CAST(assoc_id % 4 AS VARCHAR) AS video_id, assoc_id AS fixture, state, end_sec AS start_time, coalesce(lead(end_sec) OVER (PARTITION BY assoc_id ORDER BY start_sec, end_sec, state), 2500.0) AS end_time, false AS backfilled, 'medium' AS confidence FROM kept
UNION ALL SELECT 'v' || CAST(assoc_id % 4 AS VARCHAR), assoc_id, CASE state WHEN 'open' THEN 'closed' ELSE 'open' END, 0.0, end_sec, true, 'medium' FROM (SELECT *, row_number() OVER (PARTITION BY assoc_id ORDER BY start_sec, end_sec, state) AS rn FROM kept) WHERE rn = 1
UNION ALL SELECT 'v' || CAST(c_custkey % 4 AS VARCHAR), c_custkey, 'closed', 0.0, 2500.0, false, 'assumed_closed' FROM customer WHERE c_custkey NOT IN (SELECT assoc_id FROM kept)""",
A.SPANS, """kept AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY assoc_id ORDER BY start_sec, end_sec, state) AS before FROM spans WHERE end_sec IS NOT NULL) WHERE before IS NULL OR before <> state)""")
def placeholder(spark, d):
    """Customers are a catalog of fixtures; those that no span speaks of are assumed closed."""
    from ..operators.fixtures import fixture_intervals

    video = lambda k: F.concat(F.lit("v"), (F.col(k) % 4).cast("string")).alias("video_id")
    events = A.spans(spark, d).where("end_sec is not null").select(video("assoc_id"), F.col("assoc_id").alias("fixture"), "state", "start_sec", "end_sec")
    catalog = A.read(spark, d, "customer").select(video("c_custkey"), F.col("c_custkey").alias("fixture"))
    ends = spark.range(4).select(video("id"), F.lit(2500.0).alias("video_end"))
    return fixture_intervals(events, catalog, ends)


@query("tim1_jn24_time_grid", """
SELECT span_id, round(start_sec + g.i / 2.0, 6) AS time_sec FROM spans, LATERAL (SELECT unnest(range(CAST(floor((end_sec - start_sec) * 2 + 1e-9) AS BIGINT) + 1)) AS i) g WHERE end_sec IS NOT NULL""", A.SPANS)
def grid(spark, d):
    return T.time_grid(A.spans(spark, d).where("end_sec is not null"), "start_sec", "end_sec", 2.0).select("span_id", "time_sec")


@query("tim2_adaptive_times", """
SELECT span_id, unnest(CASE WHEN len <= 5 THEN [round((start_sec + end_sec) / 2.0, 6)] WHEN len <= 20 THEN list_distinct([round(start_sec, 6), round((start_sec + end_sec) / 2.0, 6), round(end_sec, 6)])
  ELSE list_distinct([round(start_sec, 6), round(start_sec + 0.25 * len, 6), round((start_sec + end_sec) / 2.0, 6), round(start_sec + 0.75 * len, 6), round(end_sec, 6)]) END) AS time_sec
FROM (SELECT *, end_sec - start_sec AS len FROM spans WHERE end_sec IS NOT NULL)""", A.SPANS)
def adaptive(spark, d):
    return A.spans(spark, d).where("end_sec is not null").select("span_id", F.explode(T.adaptive_times(F.col("start_sec"), F.col("end_sec"), 0.2)).alias("time_sec"))


@query("tim3_tim4_next_seconds", """
SELECT event_id, len(list_filter([floor(time_sec) + 1, floor(time_sec) + 2, floor(time_sec) + 3], lambda t: t <= time_sec + 2.5 AND t <= 2000)) AS n_times, CAST(round_even(time_sec * 30, 0) AS BIGINT) AS frame FROM samples""", A.SAMPLES)
def next_seconds(spark, d):
    t = F.col("time_sec")
    return A.samples(spark, d).select("event_id", F.size(T.next_seconds(t, t + 2.5, F.lit(2000.0))).cast("long").alias("n_times"), T.frame_of(t).alias("frame"))


@query("tim5_thinned_frames", "SELECT assoc_id, arg_min(event_id, (time_sec, event_id)) AS event_id FROM samples GROUP BY assoc_id, floor(time_sec * 0.1 + 1e-9)", A.SAMPLES)
def thinned(spark, d):
    s = A.samples(spark, d).select("assoc_id", "event_id", "time_sec")
    return T.thinned(s, OBJ, "time_sec", 0.1, ["event_id"]).select("assoc_id", "event_id")


@query("flt9_flt10_flt11_flt17_sample_flags", f"""
SELECT event_id, coalesce(CASE WHEN k % 2 = 0 THEN status END, CASE WHEN raw_status = 'in_motion' THEN 'in_motion' WHEN NOT in_view THEN 'out_of_view' ELSE raw_status END) AS fallback,
  coalesce(CASE WHEN k % 5 = 0 THEN true END, raw_status = 'in_motion' OR (raw_status = 'ok' AND in_view)) AS live, {VISIBLE_SQL} AND {STABLE_SQL} AND k % 3 <> 0 AS usable, {STABLE_SQL} AS queryable FROM samples""", A.SAMPLES)
def sample_flags(spark, d):
    from ..functions import statuses as S

    c = F.col
    return A.samples(spark, d).select(
        "event_id", S.fallback_status(F.when(c("k") % 2 == 0, c("status")), c("raw_status"), c("in_view")).alias("fallback"), S.live_visible(F.when(c("k") % 5 == 0, F.lit(True)), c("raw_status"), c("in_view")).alias("live"),
        S.usable_sample(S.is_visible(c("status")), S.is_stable(c("status")), F.when(c("k") % 3 != 0, c("k"))).alias("usable"), S.queryable(c("status")).alias("queryable"),
    )


@query("flt18_hidden_window", "SELECT span_id, start_sec <= greatest(0.0, start_sec + 7 - 5) + 0.5 AND end_sec >= least(2400.0, start_sec + 7 + 5) - 0.5 AS covers FROM spans WHERE end_sec IS NOT NULL", A.SPANS)
def hidden_window(spark, d):
    from ..functions.statuses import covers_hidden_window

    s = A.spans(spark, d).where("end_sec is not null")
    return s.select("span_id", covers_hidden_window(F.col("start_sec"), F.col("end_sec"), F.col("start_sec") + 7, 5.0, F.lit(2400.0), 1.0).alias("covers"))


def intervals(spark, d):
    keyed = A.spans(spark, d).withColumn("fixture", F.element_at(F.array(*(F.lit(x) for x in ("P01_cupboard.002", "P01_drawer.001", "P01_fridge.003"))), (F.col("span_id") % 3 + 1).cast("int")))
    return keyed.select("fixture", "state", F.lit("medium").alias("confidence"), "start_sec", "end_sec")


INTERVALS = """iv AS (SELECT ['P01_cupboard.002', 'P01_drawer.001', 'P01_fridge.003'][span_id % 3 + 1] AS fixture, state, start_sec, end_sec FROM spans),
held AS (SELECT s.event_id, arg_min(v.state, (v.start_sec, coalesce(v.end_sec, CAST('infinity' AS DOUBLE)), v.state)) AS state FROM samples s JOIN iv v ON s.fixture = v.fixture AND s.time_sec >= v.start_sec AND (v.end_sec IS NULL OR s.time_sec <= v.end_sec) GROUP BY 1),
rung AS (SELECT *, CASE WHEN raw_status = 'in_motion' THEN 0 WHEN raw_status IN ('no_track_available', 'no_valid_mask') THEN 1 WHEN NOT in_view THEN 2 WHEN state = 'closed' THEN 3 WHEN state = 'open' THEN 4 WHEN occluded THEN 5 ELSE 6 END AS r FROM samples LEFT JOIN held USING (event_id)),
cls AS (SELECT video_id, assoc_id, i, time_sec, fixture, ['in_motion', 'unobservable_no_data', 'out_of_view', 'occluded_inside_closed_fixture', 'potentially_visible_inside_open_fixture', 'geometrically_occluded', 'in_view'][r + 1] AS status,
  ['object in motion', 'no stable track or mask available', 'projection outside image', 'inside a closed fixture', 'inside an open fixture', 'line of sight blocked by scene geometry', 'in view, not inside a fixture'][r + 1] AS reason, CASE WHEN r IN (3, 4) THEN 'medium' END AS confidence FROM rung)"""


@query("visibility_pipeline_coarse_intervals", """
SELECT video_id, assoc_id, run, status, min(time_sec) AS start_sec, max(time_sec) AS end_sec, count(*) AS n_samples, arg_min(reason, (time_sec, i)) AS reason, nullif(arg_min(coalesce(fixture, ''), (time_sec, i)), '') AS fixture,
  nullif(arg_min(coalesce(confidence, ''), (time_sec, i)), '') AS confidence FROM (
  SELECT *, sum(ch) OVER (PARTITION BY video_id, assoc_id ORDER BY time_sec, i) AS run FROM (SELECT *, CASE WHEN status IS DISTINCT FROM lag(status, 1, status) OVER (PARTITION BY video_id, assoc_id ORDER BY time_sec, i) THEN 1 ELSE 0 END AS ch FROM cls))
GROUP BY video_id, assoc_id, run, status""", A.SAMPLES, A.SPANS, INTERVALS)
def pipeline(spark, d):
    """The engine's main path: samples are classified against fixture intervals and collapsed to spans."""
    return coarse_intervals(classified_samples(A.samples(spark, d), intervals(spark, d), ["fixture"]))



@query("qst23_stages", """
SELECT video_id, assoc_id, run, CASE WHEN status <> 'potentially_visible_inside_open_fixture' THEN status WHEN run % 3 = 0 THEN 'observed_visible_in_open_fixture' WHEN run % 3 = 1 THEN 'observed_not_visible_in_open_fixture' ELSE 'assumed_not_visible_in_open_fixture' END AS status, min(time_sec) AS start_sec, max(time_sec) AS end_sec FROM (
  SELECT *, sum(ch) OVER (PARTITION BY video_id, assoc_id ORDER BY time_sec, i) AS run FROM (SELECT *, CASE WHEN status IS DISTINCT FROM lag(status, 1, status) OVER (PARTITION BY video_id, assoc_id ORDER BY time_sec, i) THEN 1 ELSE 0 END AS ch FROM cls))
GROUP BY video_id, assoc_id, run, status""", A.SAMPLES, A.SPANS, INTERVALS)
def stages(spark, d):
    """All stages: lines of sight, fixtures, runs, and a detector's answers for two thirds of the runs."""
    s = A.samples(spark, d)
    flags = s.select("video_id", "assoc_id", "i", F.col("occluded").alias("geometrically_occluded"))
    runs = coarse_intervals(classified_samples(s, intervals(spark, d), ["fixture"])).where("run % 3 <> 2")
    answers = runs.select("video_id", "assoc_id", "run", F.when(F.col("run") % 3 == 0, "visible").otherwise("not_visible").alias("label"), F.lit(0.9).alias("score"))
    return run_stages(s.withColumn("occluded", F.lit(False)), intervals(spark, d), ["fixture"], flags, answers).select("video_id", "assoc_id", "run", "status", "start_sec", "end_sec")
