"""Queries of aggregates, rankings, question records, exports and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions.statuses import CLAIMS, STATUSES, claim, is_stable, is_visible
from ..operators import aggregates as G
from ..operators import detect as D
from ..operators import export as E
from ..operators import fixtures as X
from ..operators import manifest as M
from ..operators import questions as Q
from ..operators import rank as R
from ..operators import visibility as V
from . import adapters as A
from .queries_time import PRIORITY_SQL, RUNS_SQL, STABLE_SQL, VISIBLE_SQL, status_runs
from .registry import query

c = F.col
OBJ = ["video_id", "assoc_id"]


@query("agg1_fixture_catalog", """
SELECT participant, fixture_type, fixture, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) OVER (PARTITION BY participant, fixture_type) AS n_instances FROM masks GROUP BY participant, fixture_type, fixture""", A.MASKS)
def fixture_catalog(spark, d):
    return G.fixture_catalog(A.masks(spark, d))


@query("agg2_agg24_video_ends", """
SELECT video_id, first_sec, last_sec, coalesce(last_sec, 0.0) AS video_end FROM (SELECT 'P0' || CAST(track_id % 40 AS VARCHAR) AS video_id, min(frame_number) / 30.0 AS first_sec, max(frame_number) / 30.0 AS last_sec FROM masks GROUP BY 1)""", A.MASKS)
def video_ends(spark, d):
    m = A.masks(spark, d).select(F.concat(F.lit("P0"), (c("track_id") % 40).cast("string")).alias("video_id"), c("frame_number").alias("frame_index"))
    extent = G.time_extent(m, ["video_id"], "frame_index", 30.0)
    none = extent.select("video_id", F.lit(None).cast("double").alias("end_sec"))
    return extent.join(G.video_ends(m, none, extent.select("video_id"), 30.0), "video_id")


@query("agg3_set4_refined_verdicts", """
SELECT assoc_id, fixture, n_visible, n_partial, n_tested, max_score, CASE WHEN n_tested = 0 THEN 'assumed_not_visible_in_open_fixture' WHEN n_visible + n_partial >= 2 THEN 'observed_visible_in_open_fixture' ELSE 'observed_not_visible_in_open_fixture' END AS status FROM (
  SELECT assoc_id, coalesce(fixture, '') AS fixture, count(CASE WHEN l = 'visible' THEN 1 END) AS n_visible, count(CASE WHEN l = 'partially_visible' THEN 1 END) AS n_partial, count(CASE WHEN l <> 'skipped' THEN 1 END) AS n_tested, max(CASE WHEN l <> 'skipped' THEN s END) AS max_score
  FROM (SELECT *, score / 500.0 AS s, CASE WHEN k % 9 = 0 THEN 'skipped' WHEN score / 500.0 >= 0.5 THEN 'visible' WHEN score / 500.0 >= 0.3 THEN 'partially_visible' ELSE 'not_visible' END AS l FROM samples) GROUP BY 1, 2)""", A.SAMPLES)
def refined(spark, d):
    s = A.samples(spark, d).withColumn("fixture", F.coalesce("fixture", F.lit(""))).withColumn("score", c("score") / F.lit(500.0))
    s = s.withColumn("label", D.label_of(F.when(c("k") % 9 != 0, c("score"))))
    return G.refined_verdicts(s, ["assoc_id", "fixture"], 2)


DURATIONS = "durations AS (SELECT video_id, assoc_id, status, round(sum(greatest(0.0, end_sec - start_sec)), 3) AS duration_sec FROM runs GROUP BY video_id, assoc_id, status)"


@query("agg4_duration_by_status", "SELECT * FROM durations", A.SAMPLES, RUNS_SQL, DURATIONS)
def durations(spark, d):
    return G.duration_by_status(status_runs(spark, d), OBJ)


@query("agg4_duration_map", """
SELECT video_id, assoc_id, string_agg(status || '=' || printf('%.3f', seconds), ',' ORDER BY status) AS duration_by_status FROM (SELECT video_id, assoc_id, status, round(sum(greatest(0.0, end_sec - start_sec)), 3) AS seconds FROM runs GROUP BY ALL) GROUP BY ALL""", A.SAMPLES, RUNS_SQL)
def duration_map(spark, d):
    """The map of each object, its entries written out."""
    entry = lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.3f", e["value"]))
    return G.duration_map(durations(spark, d), OBJ).select(*OBJ, F.array_join(F.transform(F.array_sort(F.map_entries("duration_by_status")), entry), ",").alias("duration_by_status"))


@query("agg5_centroids", "SELECT track_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM masks WHERE x IS NOT NULL GROUP BY track_id", A.MASKS)
def centroids(spark, d):
    return G.centroids(A.masks(spark, d), ["track_id"])


STATUS_VALUES = ", ".join(f"('{s}', {'true' if CLAIMS.get(s) else 'false' if s in CLAIMS else 'CAST(NULL AS BOOLEAN)'})" for s in STATUSES)
VERDICT = "CASE WHEN k % 10 = 0 THEN 'skipped' WHEN k % 3 = 0 THEN 'not_detected' ELSE 'detected' END"
REPORT = f"""frames AS (SELECT assoc_id, status, {VERDICT} AS verdict FROM samples),
verdicts AS (SELECT assoc_id, status, CASE WHEN count(CASE WHEN verdict <> 'skipped' THEN 1 END) = 0 THEN 'skipped' WHEN count(CASE WHEN verdict = 'detected' THEN 1 END) >= count(CASE WHEN verdict = 'not_detected' THEN 1 END) THEN 'detected' ELSE 'not_detected' END AS verdict FROM frames GROUP BY assoc_id, status)"""


def audit_frames(spark, d):
    return A.samples(spark, d).select("assoc_id", "status", F.when(c("k") % 10 == 0, "skipped").when(c("k") % 3 == 0, "not_detected").otherwise("detected").alias("verdict"))


@query("agg12_interval_majority", "SELECT * FROM verdicts", A.SAMPLES, REPORT)
def interval_majority(spark, d):
    return G.interval_verdicts(audit_frames(spark, d), ["assoc_id", "status"])


@query("agg11_agg20_audit_report", f"""
SELECT status, claim, coalesce(f.n, 0) AS n_frames, coalesce(f.hit, 0) AS n_frames_detected, round(f.hit / nullif(f.n, 0), 6) AS frames_rate, coalesce(v.n, 0) AS n_intervals, coalesce(v.hit, 0) AS n_intervals_detected, round(v.hit / nullif(v.n, 0), 6) AS intervals_rate,
  round(CASE WHEN claim THEN 1 - round(f.hit / nullif(f.n, 0), 6) WHEN NOT claim THEN round(f.hit / nullif(f.n, 0), 6) END, 6) AS frame_disagreement, round(CASE WHEN claim THEN 1 - round(v.hit / nullif(v.n, 0), 6) WHEN NOT claim THEN round(v.hit / nullif(v.n, 0), 6) END, 6) AS interval_disagreement
FROM (VALUES {STATUS_VALUES}) s(status, claim) LEFT JOIN (SELECT status, count(CASE WHEN verdict <> 'skipped' THEN 1 END) AS n, count(CASE WHEN verdict = 'detected' THEN 1 END) AS hit FROM frames GROUP BY 1) f USING (status)
LEFT JOIN (SELECT status, count(CASE WHEN verdict <> 'skipped' THEN 1 END) AS n, count(CASE WHEN verdict = 'detected' THEN 1 END) AS hit FROM verdicts GROUP BY 1) v USING (status)""", A.SAMPLES, REPORT)
def audit_report(spark, d):
    frames = audit_frames(spark, d)
    statuses = spark.createDataFrame([(s, CLAIMS.get(s)) for s in STATUSES], "status string, claim boolean")
    return G.audit_report(frames, statuses, G.interval_verdicts(frames, ["assoc_id", "status"]))


@query("agg13_export_counts", "SELECT question_class, count(*) AS n_total, count(CASE WHEN is_mcq THEN 1 END) AS n_mcq, count(CASE WHEN NOT is_mcq THEN 1 END) AS n_open, count(CASE WHEN skipped THEN 1 END) AS n_skipped FROM steps GROUP BY question_class", A.STEPS)
def export_counts(spark, d):
    return E.export_counts(A.steps(spark, d), ["question_class"])


@query("agg14_agg22_value_counts", "SELECT * FROM (SELECT event_type, k, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, k) AS rn FROM samples GROUP BY event_type, k) WHERE rn <= 10", A.SAMPLES)
def value_counts(spark, d):
    return G.value_counts(A.samples(spark, d), ["event_type"], "k")


@query("agg15_majority_baseline", "SELECT question_class, arg_max(correct_idx, (n, correct_idx)) AS majority, max(n) AS n_majority, CAST(sum(n) AS BIGINT) AS n_total, round(max(n) / sum(n), 6) AS accuracy FROM (SELECT question_class, correct_idx, count(*) AS n FROM steps GROUP BY 1, 2) GROUP BY question_class", A.STEPS)
def majority(spark, d):
    return G.majority_baseline(A.steps(spark, d), ["question_class"], "correct_idx")


@query("agg16_totals", "SELECT video_id, count(*) AS n, count(DISTINCT assoc_id) AS n_objects, count(DISTINCT fixture) AS n_fixtures, min(time_sec) AS first_sec, max(time_sec) AS last_sec FROM samples GROUP BY video_id", A.SAMPLES)
def totals(spark, d):
    return A.samples(spark, d).groupBy("video_id").agg(F.count("*").alias("n"), F.count_distinct("assoc_id").alias("n_objects"), F.count_distinct("fixture").alias("n_fixtures"), F.min("time_sec").alias("first_sec"), F.max("time_sec").alias("last_sec"))


@query("agg17_srt5_visible_seconds", f"SELECT video_id, assoc_id, round(sum(CASE WHEN {VISIBLE_SQL} THEN end_sec - start_sec + 1.0 ELSE 0.0 END), 6) AS visible_sec FROM runs GROUP BY 1, 2", A.SAMPLES, RUNS_SQL)
def visible_seconds(spark, d):
    return G.visible_seconds(status_runs(spark, d), OBJ, is_visible(c("status")), 1.0)


@query("agg18_coverage_density", f"""
SELECT bucket, round(count(*) / CAST((SELECT count(DISTINCT assoc_id) FROM runs) AS DOUBLE), 6) AS density FROM (SELECT unnest(range(greatest(0, least(599, CAST(floor(start_sec / 4.0) AS INTEGER))), greatest(0, least(599, CAST(floor(end_sec / 4.0) AS INTEGER))) + 1)) AS bucket FROM runs WHERE {VISIBLE_SQL}) GROUP BY bucket""", A.SAMPLES, RUNS_SQL)
def coverage(spark, d):
    runs = status_runs(spark, d)
    objects = runs.agg(F.count_distinct("assoc_id")).first()[0]
    return G.coverage(runs, is_visible(c("status")), 2400.0, objects).withColumn("bucket", c("bucket").cast("long"))


@query("agg19_fixture_names", "SELECT DISTINCT CASE WHEN fixture = 'mid-air' THEN 'mid-air' ELSE lower(regexp_replace(split_part(fixture, '.', 1), '^[^_]*_', '')) END AS label FROM samples WHERE fixture IS NOT NULL", A.SAMPLES)
def fixture_names(spark, d):
    return A.samples(spark, d).where("fixture is not null").select(N.fixture_label(c("fixture")).alias("label")).distinct().orderBy("label")


@query("agg21_balanced_objects", "SELECT assoc_id, least(count(CASE WHEN in_view THEN 1 END), count(CASE WHEN NOT in_view THEN 1 END)) AS balance, count(CASE WHEN in_view THEN 1 END) AS n_true, count(CASE WHEN NOT in_view THEN 1 END) AS n_false FROM samples GROUP BY assoc_id HAVING least(count(CASE WHEN in_view THEN 1 END), count(CASE WHEN NOT in_view THEN 1 END)) >= 10", A.SAMPLES)
def balanced(spark, d):
    return G.balanced_objects(A.samples(spark, d), ["assoc_id"], c("in_view"))


@query("agg23_time_shares", "SELECT video_id, assoc_id, status, round(d / nullif(sum(d) OVER (PARTITION BY video_id, assoc_id), 0), 6) AS share FROM (SELECT video_id, assoc_id, status, sum(greatest(0.0, end_sec - start_sec)) AS d FROM runs GROUP BY 1, 2, 3)", A.SAMPLES, RUNS_SQL)
def shares(spark, d):
    return G.time_shares(status_runs(spark, d), OBJ)


@query("agg25_sight_lists", f"""
SELECT video_id, CAST(floor(time_sec) AS BIGINT) AS t, coalesce(array_to_string(list_sort(list(CAST(assoc_id AS VARCHAR)) FILTER ({VISIBLE_SQL})), ','), '') AS seen, coalesce(array_to_string(list_sort(list(CAST(assoc_id AS VARCHAR)) FILTER (NOT ({VISIBLE_SQL}))), ','), '') AS unseen FROM samples GROUP BY 1, 2""", A.SAMPLES)
def sight_lists(spark, d):
    s = A.samples(spark, d).select("video_id", F.floor("time_sec").cast("long").alias("t"), c("assoc_id").cast("string").alias("name"), "status")
    return G.sight_lists(s, ["video_id", "t"], is_visible(c("status")), "name").select("video_id", "t", F.array_join("in_sight", ",").alias("seen"), F.array_join("out_of_sight", ",").alias("unseen"))


@query("srt1_srt4_relocation_rank", """
SELECT place, n_transitions + n_shifts AS total, row_number() OVER (ORDER BY n_transitions + n_shifts DESC, n_transitions DESC, n_shifts DESC, place) AS rank FROM (
SELECT place, count(CASE WHEN fixture <> pf THEN 1 END) AS n_transitions, count(CASE WHEN sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) >= 0.15 THEN 1 END) AS n_shifts FROM (
  SELECT *, lag(fixture) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM (SELECT *, track_id % 150 AS place FROM masks WHERE x IS NOT NULL)
  WINDOW w AS (PARTITION BY place ORDER BY track_id, frame_number)) GROUP BY place) QUALIFY rank <= 40""", A.MASKS)
def relocation_rank(spark, d):
    m = A.masks(spark, d).withColumn("place", c("track_id") % 150)
    top = G.relocations(m, ["place"], ["track_id", "frame_number"]).orderBy(c("total").desc(), c("n_transitions").desc(), c("n_shifts").desc(), "place").limit(40)
    return R.numbered(top, [], [c("total").desc(), c("n_transitions").desc(), c("n_shifts").desc(), c("place")], "rank").select("place", "total", c("rank").cast("long"))


@query("srt2_srt3_interaction_score_top2", """
SELECT assoc_id, best, best_score, runner_up_score, CASE WHEN best_score >= 0.55 AND best_score - runner_up_score >= 0.12 THEN 'high' WHEN best_score >= 0.30 THEN 'medium' WHEN best_score >= 0.10 THEN 'low' ELSE 'very_low' END AS confidence FROM (
SELECT assoc_id, max(CASE WHEN rn = 1 THEN fixture END) AS best, max(CASE WHEN rn = 1 THEN score END) AS best_score, coalesce(max(CASE WHEN rn = 2 THEN score END), -1.0) AS runner_up_score FROM (
  SELECT *, row_number() OVER (PARTITION BY assoc_id ORDER BY score DESC, fixture) AS rn FROM (SELECT assoc_id, fixture, round(avg(score) / 120.0, 6) AS score FROM samples WHERE fixture IS NOT NULL GROUP BY 1, 2)) GROUP BY assoc_id)""", A.SAMPLES)
def top_two(spark, d):
    s = A.samples(spark, d).where("fixture is not null").groupBy("assoc_id", "fixture").agg(F.round(F.avg("score") / 120.0, 6).alias("score"))
    return R.best_and_runner_up(s, ["assoc_id"], "score", "fixture")


STATUS_RANK = "CASE status WHEN 'in_view' THEN 0 WHEN 'observed_visible_in_open_fixture' THEN 1 WHEN 'in_motion' THEN 2 WHEN 'out_of_view' THEN 3 ELSE 4 END"
CLAIM_RANK = "CASE WHEN status IN ('in_view', 'observed_visible_in_open_fixture') THEN 0 WHEN status IN ('occluded_inside_closed_fixture', 'geometrically_occluded', 'observed_not_visible_in_open_fixture', 'assumed_not_visible_in_open_fixture') THEN 2 ELSE 1 END"


@query("srt6_flattened_items", f"""
SELECT video_id, assoc_id, run, row_number() OVER (PARTITION BY video_id ORDER BY {STATUS_RANK}, assoc_id, start_sec, end_sec, fixture, n_samples, run) AS place FROM runs""", A.SAMPLES, RUNS_SQL)
def flattened_items(spark, d):
    """Seven sort keys, the status's rank first."""
    rank = F.expr(STATUS_RANK)
    return R.numbered(status_runs(spark, d), ["video_id"], [rank, "assoc_id", "start_sec", "end_sec", "fixture", "n_samples", "run"], "place").select("video_id", "assoc_id", "run", c("place").cast("long"))


@query("srt7_confidence_order", "SELECT event_id, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, event_id) AS place FROM samples WHERE score >= 100", A.SAMPLES)
def confidence_order(spark, d):
    return D.confident(A.samples(spark, d), 100, ["video_id"], ["event_id"]).select("event_id", c("place").cast("long"))


@query("srt10_claim_order", f"SELECT event_id, row_number() OVER (PARTITION BY video_id ORDER BY {CLAIM_RANK}, event_id) AS place FROM samples", A.SAMPLES)
def claim_order(spark, d):
    """What is said to be visible, then what nothing is said of, then what is said to be hidden."""
    says = claim(c("status"))
    return R.numbered(A.samples(spark, d), ["video_id"], [F.when(says, 0).when(~says, 2).otherwise(1), "event_id"], "place").select("event_id", c("place").cast("long"))


@query("srt8_evenly_spaced", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY assoc_id ORDER BY time_sec, event_id) - 1 AS rn, count(*) OVER (PARTITION BY assoc_id) AS n FROM samples)
WHERE list_contains(list_transform([0, 1, 2, 3, 4], lambda q: CAST(round_even(q * (n - 1) / 4.0, 0) AS BIGINT)), rn)""", A.SAMPLES)
def evenly_spaced(spark, d):
    return R.evenly_spaced(A.samples(spark, d), ["assoc_id"], ["time_sec", "event_id"], 5).select("event_id")


@query("srt9_closest_sample", "SELECT assoc_id, arg_min(event_id, (abs(time_sec - 1000), time_sec, event_id)) AS event_id FROM samples GROUP BY assoc_id", A.SAMPLES)
def closest(spark, d):
    s = A.samples(spark, d)
    return R.closest_sample(s, ["assoc_id"], "time_sec", F.lit(1000.0), ["event_id"])


PLACED = """placed AS (SELECT *, row_number() OVER (PARTITION BY assoc_id ORDER BY again, event_id) AS place_order FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY assoc_id, fixture ORDER BY event_id) > 1 THEN 1 ELSE 0 END AS again FROM samples))"""


@query("win11_location_diversity", "SELECT event_id, place_order FROM placed", A.SAMPLES, PLACED)
def location_diversity(spark, d):
    return R.location_first(A.samples(spark, d), ["assoc_id"], "fixture", "event_id").select("event_id", c("place_order").cast("long"))


@query("win12_round_robin", """
SELECT event_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rn, assoc_id) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY video_id, assoc_id ORDER BY event_id) AS rn FROM samples)) WHERE turn <= 100""", A.SAMPLES)
def round_robin(spark, d):
    return R.round_robin(A.samples(spark, d), ["video_id"], "assoc_id", ["event_id"], 100).select("event_id", c("turn").cast("long"))


@query("win13_name_cap", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 2")
def name_cap(spark, d):
    return R.top_per_group(A.read(spark, d, "part"), ["p_name"], ["p_partkey"], 2).select("p_partkey")


@query("win14_video_cap_ids", """
SELECT event_id, row_number() OVER (ORDER BY video_id, rn) AS record_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY event_id) AS rn FROM samples) WHERE rn <= 50""", A.SAMPLES)
def video_cap(spark, d):
    return R.capped_with_ids(A.samples(spark, d), ["video_id"], ["event_id"], 50).select("event_id", c("record_id").cast("long"))


@query("win16_keep_first", "SELECT min(event_id) AS event_id FROM samples GROUP BY video_id, assoc_id, round(time_sec, 0)", A.SAMPLES)
def keep_first(spark, d):
    return R.keep_first(A.samples(spark, d), [c("video_id"), c("assoc_id"), F.round("time_sec", 0)], ["event_id"]).select("event_id")


@query("win17_step_dependencies", """
SELECT trajectory_id, step, array_to_string(CASE WHEN is_branch THEN (SELECT list(b.step ORDER BY b.position) FROM steps b WHERE b.trajectory_id = s.trajectory_id AND NOT b.is_branch)
  ELSE (SELECT list(b.step ORDER BY b.position) FROM steps b WHERE b.trajectory_id = s.trajectory_id AND NOT b.is_branch AND b.position < s.position) END, ',') AS depends_on FROM steps s""", A.STEPS)
def dependencies(spark, d):
    out = E.step_dependencies(A.steps(spark, d), "trajectory_id", "position")
    return out.select("trajectory_id", "step", F.when(F.size("depends_on") > 0, F.array_join("depends_on", ",")).alias("depends_on"))


@query("win19_first_unscored", "SELECT min(event_id) AS event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def first_unscored(spark, d):
    return E.first_unscored(A.read(spark, d, "events"), A.read(spark, d, "labels").select(c("doc_id").alias("event_id")), "event_id", "event_id")


@query("jn10_type_priority_resolve", """
SELECT l_orderkey, arg_min(l_returnflag, p) AS fixture_type FROM (SELECT l_orderkey, l_returnflag, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS p FROM lineitem) GROUP BY l_orderkey""")
def type_priority(spark, d):
    li = A.read(spark, d, "lineitem").select("l_orderkey", c("l_returnflag").alias("fixture_type"), c("l_suppkey").alias("fixture"))
    events = li.select("l_orderkey").distinct().withColumn("candidate_types", F.array(F.lit("R"), F.lit("N"), F.lit("A"))).withColumn("place", c("l_orderkey"))
    catalog = li.select(c("l_orderkey").alias("place"), "fixture_type", "fixture")
    return X.first_existing_type(events, catalog, ["l_orderkey"], "place").select("l_orderkey", "fixture_type")


@query("jn11_interaction_scores", """
SELECT track_id, best, best_score, runner_up_score, CASE WHEN best_score >= 0.55 AND best_score - runner_up_score >= 0.12 THEN 'high' WHEN best_score >= 0.30 THEN 'medium' WHEN best_score >= 0.10 THEN 'low' ELSE 'very_low' END AS confidence FROM (
  SELECT track_id, max(CASE WHEN rn = 1 THEN fixture END) AS best, max(CASE WHEN rn = 1 THEN score END) AS best_score, coalesce(max(CASE WHEN rn = 2 THEN score END), -1.0) AS runner_up_score FROM (
    SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, fixture) AS rn FROM (
      SELECT e.track_id, f.vec_id AS fixture, round(avg(look), 6) AS score FROM (
        SELECT track_id, CAST(assoc_id % 10 AS INTEGER) AS place, round_even(start_sec / 100 * 30, 0) AS low, round_even((end_sec / 100 + 1) * 30, 0) AS high FROM tracks) e
      JOIN points p ON p.label = e.place AND p.vec_id BETWEEN e.low AND e.high
      JOIN (SELECT fr.vec_id AS frame, fx.vec_id, greatest(0.0, CASE WHEN dist < 1e-6 OR gn < 1e-6 THEN -1.0 ELSE (fr.gx * dx + fr.gy * dy + fr.gz * dz) / (gn * dist) END) * exp(-dist / 1.5) AS look FROM points fr JOIN points fx ON fr.label = fx.label,
        LATERAL (SELECT fx.ax - fr.cx AS dx, fx.ay - fr.cy AS dy, fx.az - fr.cz AS dz), LATERAL (SELECT sqrt(dx * dx + dy * dy + dz * dz) AS dist, sqrt(fr.gx * fr.gx + fr.gy * fr.gy + fr.gz * fr.gz) AS gn)) f ON f.frame = p.vec_id
      GROUP BY 1, 2)) GROUP BY track_id)""", A.TRACKS, A.POINTS)
def interactions(spark, d):
    """Looks of embeddings at fixtures of their label during events."""
    p = A.points(spark, d)
    frames = p.select(c("label").alias("place"), c("vec_id").alias("frame_index"), "camera", "gaze")
    fixtures = p.select(c("label").alias("place"), c("vec_id").alias("fixture"), c("a").alias("position"))
    events = A.tracks(spark, d).select("track_id", (c("assoc_id") % 10).cast("int").alias("place"), (c("start_sec") / 100).alias("start_sec"), (c("end_sec") / 100 + 1).alias("end_sec"))
    return X.best_interactions(events, frames, fixtures, ["track_id"], "place", 30.0)


@query("jn16_name_lookup", """
SELECT e.event_id, coalesce(n.n_name, 'unknown') AS area FROM events e LEFT JOIN nation n ON lower(trim(n.n_name)) = lower('Nation_' || CAST(e.user_id % 30 AS VARCHAR))""")
def lookups(spark, d):
    n = A.read(spark, d, "nation").select(F.lower(F.trim("n_name")).alias("key"), c("n_name").alias("area"))
    e = A.read(spark, d, "events").select("event_id", F.lower(F.concat(F.lit("Nation_"), (c("user_id") % 30).cast("string"))).alias("key"))
    return X.looked_up(e, n, ["key"], "area", F.lit("unknown")).select("event_id", "area")


@query("jn25_area_of_fixture", """
SELECT s.event_id, coalesce(r.area, 'counter') AS area FROM samples s
LEFT JOIN (SELECT participant, fixture, min(fixture_type) AS area FROM masks GROUP BY 1, 2) r ON r.participant = split_part(s.video_id, '-', 1) AND r.fixture = 'f' || CAST(s.k % 17 AS VARCHAR)""", A.SAMPLES, A.MASKS)
def areas(spark, d):
    r = A.masks(spark, d).groupBy("participant", "fixture").agg(F.min("fixture_type").alias("area"))
    s = A.samples(spark, d).select("event_id", F.split("video_id", "-")[0].alias("participant"), F.concat(F.lit("f"), (c("k") % 17).cast("string")).alias("fixture"))
    return X.looked_up(s, r, ["participant", "fixture"], "area", F.lit("counter")).select("event_id", "area")


@query("jn35_state_or_live", """
SELECT s.event_id, coalesce(p.flag, s.in_view OR s.raw_status = 'in_motion') AS visible FROM samples s LEFT JOIN (SELECT doc_id, max(quality) = 1 AS flag FROM labels GROUP BY doc_id) p ON p.doc_id = s.event_id""", A.SAMPLES)
def state_or_live(spark, d):
    """A precomputed flag where there is one, else what the sample itself says."""
    from ..functions.statuses import live_visible

    p = A.read(spark, d, "labels").groupBy(c("doc_id").alias("event_id")).agg((F.max("quality") == 1).alias("flag"))
    s = A.samples(spark, d).select("event_id", "raw_status", "in_view")
    live = F.coalesce(c("in_view"), F.lit(False)) | (c("raw_status") == "in_motion")
    return X.looked_up(s, p, ["event_id"], "flag", live).select("event_id", live_visible(c("flag"), c("raw_status"), c("in_view")).alias("visible"))


@query("jn26_qst20_merged_scores", """
SELECT event_id, coalesce(s.quality, CASE WHEN event_id % 4 = 0 THEN -1 END) AS score FROM events LEFT JOIN (SELECT doc_id, arg_max(quality, (toxic, quality)) AS quality FROM labels GROUP BY doc_id) s ON s.doc_id = event_id""")
def merged_scores(spark, d):
    items = A.read(spark, d, "events").select("event_id", F.when(c("event_id") % 4 == 0, F.lit(-1)).alias("score"))
    new = A.read(spark, d, "labels").select(c("doc_id").alias("event_id"), c("quality").alias("score"), c("toxic").alias("scored_at"))
    return E.merged_scores(items, new, "event_id")


@query("jn29_matched_boxes", """
SELECT p.vec_id, count(b.vec_id) AS n_boxes, arg_min(b.vec_id, ((p.u - (b.u + 15)) * (p.u - (b.u + 15)) + (p.v - (b.v + 10)) * (p.v - (b.v + 10)), b.vec_id)) AS box_id FROM points p LEFT JOIN points b ON p.label = b.label AND p.u BETWEEN b.u - 20 AND b.u + 50 AND p.v BETWEEN b.v - 20 AND b.v + 40 GROUP BY p.vec_id""", A.POINTS)
def boxes(spark, d):
    p = A.points(spark, d)
    u, v = c("pixel.u"), c("pixel.v")
    b = p.select("label", c("vec_id").alias("box_id"), u.alias("x1"), v.alias("y1"), (u + 30).alias("x2"), (v + 20).alias("y2"))
    return V.matched_boxes(p.select("label", "vec_id", "pixel"), b, ["label"]).select("vec_id", c("n_boxes").cast("long"), "box_id")


@query("jn31_jn32_anchor_relations", """
SELECT p.vec_id, a.vec_id AS anchor_id, round(p.c * (p.ax - a.ax) + p.s * (p.az - a.az), 6) AS rx FROM points p JOIN (SELECT label, arg_min(vec_id, ((u - 704) * (u - 704) + (v - 704) * (v - 704), vec_id)) AS vec_id FROM points GROUP BY label) m USING (label) JOIN points a ON a.vec_id = m.vec_id WHERE p.vec_id <> a.vec_id""", A.POINTS)
def anchors(spark, d):
    s = A.points(spark, d).select("label", c("vec_id").alias("assoc_id"), "pixel", c("a").alias("world"), c("pose").alias("camera_from_world"))
    central = V.central_object(s, ["label"], F.lit(True), 1408, 1408)
    placed = central.join(s.select("label", c("assoc_id").alias("anchor_id"), "world"), ["label", "anchor_id"]).withColumnRenamed("anchor_id", "assoc_id")
    return V.relative_to_anchor(s, placed, ["label"]).select(c("assoc_id").alias("vec_id"), "anchor_id", F.round("relative.x", 6).alias("rx"))


@query("jn30_jn34_projected_at_frame", """
SELECT frame_index, round(z, 4) AS z, CASE WHEN z > 1e-9 THEN round(600.0 * (x1 + (2 * x1 * x1 + rr) * 0.001 + 2 * x1 * y1 * -0.002 + 0.0005 * rr + 0.0001 * rr * rr) + 704.0, 3) END AS u FROM (
  SELECT *, x1 * x1 + y1 * y1 AS rr FROM (SELECT *, a * s0 AS x1, b * s0 AS y1 FROM (SELECT *, CASE WHEN r < 1e-12 THEN 1.0 ELSE th * (1 + 0.1 * th * th - 0.05 * th * th * th * th + 0.01 * th * th * th * th * th * th) / r END AS s0 FROM (
    SELECT *, sqrt(a * a + b * b) AS r, atan(sqrt(a * a + b * b)) AS th FROM (SELECT *, x / z AS a, y / z AS b FROM (
      SELECT vec_id AS frame_index, c * ax + s * az + tx AS x, ay + ty AS y, -s * ax + c * az + tz AS z FROM points))))))""", A.POINTS)
def projected(spark, d):
    """Places seen from the pose of the nearest frame."""
    p = A.points(spark, d)
    poses = p.select(c("label").alias("video_id"), c("vec_id").alias("pose_frame"), c("pose").alias("camera_from_world"))
    return V.projected(p.select(c("label").alias("video_id"), c("vec_id").alias("frame_index"), c("a").alias("world")), poses, A.LENS).select("frame_index", F.round("camera.z", 4).alias("z"), F.round("pixel.u", 3).alias("u"))


@query("str21_set3_single_turns", "SELECT CAST(trajectory_id AS VARCHAR) || '__step_' || step AS question_id, row_number() OVER (PARTITION BY trajectory_id ORDER BY position) - 1 AS position, question FROM steps", A.STEPS)
def single_turns(spark, d):
    rows = A.steps(spark, d).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("position", "step", "question"))).alias("all"))
    rows = rows.withColumn("all", F.transform("all", lambda s: F.struct(s["step"].alias("step"), s["question"].alias("question"))))
    return E.single_turns(rows, "trajectory_id", "all").select("question_id", c("position").cast("long"), "question")


@query("str22_str13_multi_turns", "SELECT trajectory_id, 2 * (count(*) - 1) AS n_messages, coalesce(max(CASE WHEN r = n - 1 THEN answer END), '') AS last_said FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY position) AS r, count(*) OVER (PARTITION BY trajectory_id) AS n FROM steps) GROUP BY trajectory_id", A.STEPS)
def multi_turns(spark, d):
    s = F.struct("position", "question", "answer", F.array().cast("array<string>").alias("choices"), F.lit(0).alias("correct_idx"))
    rows = A.steps(spark, d).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(s)).alias("all"))
    out = E.multi_turns(rows, "trajectory_id", "all")
    m = c("gold_history_messages")
    return out.select("trajectory_id", F.size(m).cast("long").alias("n_messages"), F.when(F.size(m) > 0, F.element_at(m, -1)["content"]).otherwise("").alias("last_said"))


@query("flt14_without_failed", "SELECT trajectory_id, step FROM steps WHERE trajectory_id NOT IN (SELECT trajectory_id FROM steps WHERE skipped AND step <> '1')", A.STEPS)
def without_failed(spark, d):
    return E.without_failed(A.steps(spark, d), "trajectory_id", c("skipped"), c("step") == "1").select("trajectory_id", "step")


@query("str20_str23_nested_updates", """
SELECT trajectory_id, count(anchor) AS n_anchors, round(sum(anchor), 6) AS anchors, 2 AS version, arg_min('{"v":{"position":' || CAST(position AS VARCHAR) || ',"step":"' || step || '"}}', position) AS first_step
FROM (SELECT *, coalesce(CASE WHEN position % 2 = 0 THEN correct_idx / 1408.0 END, position / 1408.0) AS anchor FROM steps) GROUP BY trajectory_id""", A.STEPS)
def nested_updates(spark, d):
    """Steps as structs with a field filled in where it is absent, and an older version's structs completed."""
    s = F.struct("position", "step", F.when(c("position") % 2 == 0, c("correct_idx") / F.lit(1408.0)).alias("anchor"))
    rows = A.steps(spark, d).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(s)).alias("steps"))
    filled = E.with_field_if_absent(c("steps"), "anchor", lambda x: x["position"] / F.lit(1408.0))
    one = E.upgraded(F.element_at(filled, 1), {"version": F.lit(2)})
    filled_in = F.filter(F.transform(filled, lambda x: x["anchor"]), lambda x: x.isNotNull())
    return rows.select(
        "trajectory_id", F.size(filled_in).cast("long").alias("n_anchors"), F.round(F.aggregate(filled_in, F.lit(0.0), lambda a, x: a + x), 6).alias("anchors"), one["version"].alias("version"),
        N.text_of_any(F.struct(one["position"].alias("position"), one["step"].alias("step"))).alias("first_step"),
    )


@query("qst19_jn27_incremental_manifest", "SELECT event_id FROM samples WHERE status NOT IN (SELECT status FROM samples WHERE event_id < 2)", A.SAMPLES)
def incremental(spark, d):
    s = A.samples(spark, d)
    return E.missing_statuses(s, s.where("event_id < 2"), "status").select("event_id")


AUDITED = """pool AS (SELECT status, 'v' || CAST(assoc_id % 4 AS VARCHAR) AS video_id, CAST(span_id AS VARCHAR) AS assoc_id, start_sec, start_sec + (end_sec - start_sec) / 10 AS end_sec FROM spans WHERE end_sec IS NOT NULL),
picked AS (SELECT *, count(*) OVER (PARTITION BY status) AS pool_size, row_number() OVER (PARTITION BY status ORDER BY md5('8|' || status || '|' || video_id || '|' || assoc_id || '|' || CAST(start_sec AS VARCHAR) || '|' || CAST(end_sec AS VARCHAR)), video_id, assoc_id, start_sec, end_sec) AS rn FROM pool),
shots AS (SELECT *, row_number() OVER (PARTITION BY status, video_id, assoc_id, start_sec, end_sec ORDER BY md5('8|' || status || '|' || video_id || '|' || assoc_id || '|' || CAST(start_sec AS VARCHAR) || '|' || CAST(end_sec AS VARCHAR) || '|' || CAST(frame_index AS VARCHAR)), frame_index) AS fn FROM (
  SELECT *, unnest(range(CAST(round_even(start_sec * 30, 0) AS BIGINT), CAST(round_even(end_sec * 30, 0) AS BIGINT) + 1)) AS frame_index FROM picked WHERE rn <= 12)),
items AS (SELECT *, printf('%s|%s|%.6f|%.6f', video_id, assoc_id, start_sec, end_sec) AS part, round(frame_index / 30.0, 6) AS time_sec FROM shots WHERE fn <= 3)"""


@query("qst19_incremental_frames", """
SELECT status, substr(sha1(part || printf('|%.6f', time_sec)), 1, 12) AS item_id, assoc_id, time_sec, 'frames/' || status || '/' || substr(sha1(part || printf('|%.6f', time_sec)), 1, 12) || '.jpg' AS image_path, pool_size, least(pool_size, 12) AS n_intervals_sampled, CAST(1 AS BIGINT) AS n_signatures
FROM items""", A.SPANS, AUDITED)
def incremental_frames(spark, d):
    """A manifest of two statuses' frames, extended to all three: what it had stays, and one signature holds for all."""
    s = A.spans(spark, d).where("end_sec is not null")
    pool = s.select("status", F.concat(F.lit("v"), (c("assoc_id") % 4).cast("string")).alias("video_id"), c("span_id").cast("string").alias("assoc_id"), F.lit("object").alias("object_name"), "start_sec", (c("start_sec") + (c("end_sec") - c("start_sec")) / 10).alias("end_sec"))
    first = M.extended(None, pool, ["in_view", "out_of_view"], 12, 3, 30.0, 8)
    grown = M.extended(first, pool, ["out_of_view", "in_view", "geometrically_occluded"], 12, 3, 30.0, 8)
    shot = c("frames")[0]
    marks = grown.agg(F.count_distinct("signature").alias("n_signatures"))
    return grown.select("status", "item_id", "assoc_id", shot["time_sec"].alias("time_sec"), shot["image_path"].alias("image_path"), "pool_size", "n_intervals_sampled").crossJoin(F.broadcast(marks))  # one row


@query("qst19_incremental_intervals", """
SELECT status, substr(sha1(part || '|interval'), 1, 12) AS item_id, count(*) AS n_frames, round(sum(time_sec), 4) AS times FROM items GROUP BY status, part""", A.SPANS, AUDITED)
def incremental_intervals(spark, d):
    s = A.spans(spark, d).where("end_sec is not null")
    pool = s.select("status", F.concat(F.lit("v"), (c("assoc_id") % 4).cast("string")).alias("video_id"), c("span_id").cast("string").alias("assoc_id"), F.lit("object").alias("object_name"), "start_sec", (c("start_sec") + (c("end_sec") - c("start_sec")) / 10).alias("end_sec"))
    grown = M.extended(M.extended(None, pool, ["in_view"], 12, 3, 30.0, 8, by_interval=True), pool, ["in_view", "out_of_view", "geometrically_occluded"], 12, 3, 30.0, 8, by_interval=True)
    return grown.select("status", "item_id", F.size("frames").cast("long").alias("n_frames"), F.round(F.aggregate("frames", F.lit(0.0), lambda a, x: a + x["time_sec"]), 4).alias("times"))


def bool_spans(spark, d):
    from ..operators.islands import collapse_runs

    s = A.samples(spark, d).withColumn("visible", is_visible(c("status"))).withColumn("stable", is_stable(c("status")))
    return s, collapse_runs(s, OBJ, ["time_sec", "event_id"], "time_sec", "visible")


BOOL_RUNS = f"""b AS (SELECT *, {VISIBLE_SQL} AS visible, {STABLE_SQL} AS stable FROM samples), bruns AS (
  SELECT video_id, assoc_id, run, visible, min(time_sec) AS start_sec, max(time_sec) AS end_sec FROM (SELECT *, sum(ch) OVER (PARTITION BY video_id, assoc_id ORDER BY time_sec, event_id) AS run FROM (
    SELECT *, CASE WHEN visible IS DISTINCT FROM lag(visible, 1, visible) OVER (PARTITION BY video_id, assoc_id ORDER BY time_sec, event_id) THEN 1 ELSE 0 END AS ch FROM b)) GROUP BY 1, 2, 3, 4)"""


HIDDEN_SQL = """
SELECT video_id, assoc_id, query_sec, usable_sec, last_stable_sec FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, assoc_id, round(query_sec, 3) ORDER BY query_sec, start_sec) AS rn, (SELECT max(x.time_sec) FROM b x WHERE x.assoc_id = q.assoc_id AND x.stable AND x.time_sec < q.query_sec) AS last_stable_sec FROM (
    SELECT u.video_id, u.assoc_id, u.start_sec, u.end_sec, u.usable_sec, arg_min(s.time_sec, (abs(s.time_sec - (u.usable_sec + 20)), s.time_sec)) AS query_sec FROM (
      SELECT r.*, greatest(r.start_sec, coalesce((SELECT max(t.end_sec) FROM tracks t WHERE t.assoc_id = r.assoc_id AND t.end_sec <= r.start_sec), -1)) AS usable_sec FROM bruns r WHERE NOT visible AND end_sec - start_sec >= 20) u
    JOIN b s ON s.assoc_id = u.assoc_id AND NOT s.visible AND s.time_sec BETWEEN u.usable_sec AND u.end_sec WHERE u.end_sec - u.usable_sec >= 20 GROUP BY 1, 2, 3, 4, 5) q
  WHERE start_sec <= greatest(0.0, query_sec - 20) + 0.5 AND end_sec >= least(2400.0, query_sec + 20) - 0.5)
WHERE rn = 1 AND last_stable_sec IS NOT NULL"""


@query("qst11_flt18_hidden_candidates", f"SELECT assoc_id, query_sec, usable_sec, last_stable_sec FROM ({HIDDEN_SQL})", A.SAMPLES, BOOL_RUNS, A.TRACKS)
def hidden(spark, d):
    s, spans = bool_spans(spark, d)
    tracks = A.tracks(spark, d).join(s.select(*OBJ).distinct(), "assoc_id").select("video_id", "assoc_id", "end_sec")
    videos = s.select("video_id").distinct().withColumn("video_end", F.lit(2400.0))
    return Q.hidden_candidates(spans, s, tracks, videos, 20.0, 1.0).select("assoc_id", "query_sec", "usable_sec", "last_stable_sec")


@query("qst12_visible_candidates", """
SELECT video_id, assoc_id, time_sec, turn FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rnd, assoc_id) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY video_id, assoc_id ORDER BY place_order) AS rnd FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, assoc_id ORDER BY again, time_sec) AS place_order FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY video_id, assoc_id, fixture ORDER BY time_sec) > 1 THEN 1 ELSE 0 END AS again FROM (
    SELECT r.video_id, r.assoc_id, r.start_sec, r.end_sec, arg_min(s.time_sec, (abs(s.time_sec - (r.start_sec + r.end_sec) / 2), s.time_sec)) AS time_sec, arg_min(coalesce(s.fixture, ''), (abs(s.time_sec - (r.start_sec + r.end_sec) / 2), s.time_sec)) AS fixture
    FROM bruns r JOIN b s ON s.assoc_id = r.assoc_id AND s.stable AND s.time_sec BETWEEN r.start_sec AND r.end_sec WHERE r.visible GROUP BY 1, 2, 3, 4))))) WHERE turn <= 50""", A.SAMPLES, BOOL_RUNS)
def seen(spark, d):
    s, spans = bool_spans(spark, d)
    return Q.visible_candidates(spans, s, 50).select("video_id", "assoc_id", "time_sec", c("turn").cast("long"))


def trajectory_records(spark, d, cap):
    """Hidden candidates as records of steps: visible or not, last seen, stopped, nearest fixture, direction, relation and distance."""
    s, spans = bool_spans(spark, d)
    tracks = A.tracks(spark, d).join(s.select(*OBJ).distinct(), "assoc_id").select("video_id", "assoc_id", "end_sec")
    videos = s.select("video_id").distinct().withColumn("video_end", F.lit(2400.0))
    cand = Q.hidden_candidates(spans, s, tracks, videos, 20.0, 1.0)
    places = A.points(spark, d).select(c("vec_id").alias("assoc_id"), c("a").alias("world"), "pose")
    anchors = places.select(c("assoc_id").alias("anchor_id"), c("world").alias("anchor_world"))
    label = F.element_at(F.array(F.lit("counter"), F.lit("drawer"), F.lit("mid-air")), (c("assoc_id") % 3 + 1).cast("int"))
    objects = s.where("stable").select("video_id", c("assoc_id").alias("anchor_id"))
    named = Q.first_with_anchor(cand.join(places, "assoc_id").where(N.valid_fixture(label)), objects, anchors, 11, ["query_sec", "assoc_id"], cap)
    from ..functions.geometry import anchored, distance

    name, other, key = F.concat(F.lit("object "), c("assoc_id").cast("string")), F.concat(F.lit("object "), c("anchor_id").cast("string")), F.concat_ws(":", "video_id", "assoc_id", "query_sec")
    rel = anchored(c("pose"), c("world"), c("anchor_world"))
    vocabulary = F.array(*(F.lit(x) for x in ("counter", "drawer", "cupboard", "fridge", "oven", "bin")))
    rows = named.select(
        "*", Q.visibility_step(name, c("query_sec"), F.lit(False), key, 1).alias("s1"), Q.last_seen_step(name, c("query_sec"), c("last_stable_sec"), c("world.x"), c("world.y")).alias("s2"),
        Q.stopped_step(name, c("query_sec"), c("usable_sec")).alias("s3"), Q.fixture_step(name, label, vocabulary, key, 2).alias("s4"), Q.quadrant_step(name, c("world")).alias("b1"),
        Q.relation_step(name, other, rel).alias("b2"), Q.distance_step(name, other, distance(c("world"), c("anchor_world"))).alias("b3"), Q.area_step(name, label, vocabulary, key, 3).alias("b4"),
        Q.drop_reason(F.lit(True), F.lit(False), c("last_stable_sec"), F.lit(False), N.valid_fixture(label), c("usable_sec"), F.lit("x"), c("anchor_id"), F.lit(True)).alias("reason"),
    )
    kept = rows.where("reason in ('kept', 'seen_before_placement')")
    return Q.trajectories(kept, ["query_sec", "assoc_id"], ["s1", "s2", "s3", "s4"], ["b1", "b2", "b3", "b4"], cap)


@query("qst1_qst10_qst16_trajectories")
def trajectories(spark, d):
    return trajectory_records(spark, d, 2).select(
        "video_id", "trajectory_id", "assoc_id", "query_sec", F.size("incremental_steps").alias("n_steps"), F.to_json("incremental_steps").alias("steps"), F.to_json("branch_groups").alias("branches")
    )


@query("qst17_exploded_steps", "SELECT trajectory_id, position, step, question, answer FROM steps", A.STEPS)
def flat_steps(spark, d):
    s = A.steps(spark, d).withColumn("choices", F.array().cast("array<string>"))
    rows = s.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("position", "step", "question", "answer"))).alias("incremental_steps"))
    return Q.exploded_steps(rows, ["trajectory_id"])


@query("udf1_udf2_udf6_qst13_qst14_detector_path", """
SELECT label, vec_id, round(b / 255.0, 6) AS score, 'visible' AS verdict, CAST(x1 + greatest(1, x2 - x1) // 4 AS INTEGER) AS x1, CAST(y1 + greatest(1, y2 - y1) // 4 AS INTEGER) AS y1 FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM (
    SELECT *, CAST('0x' || substring(md5('cup|' || x1 || '|' || y1 || '|' || x2 || '|' || y2), 1, 2) AS INTEGER) AS b FROM (
      SELECT *, greatest(0, least(1408, cu - h)) AS x1, greatest(0, least(1408, cu + h)) AS x2, greatest(0, least(1408, cv - h)) AS y1, greatest(0, least(1408, cv + h)) AS y2 FROM (
        SELECT *, CAST(round_even(u, 0) AS INTEGER) AS cu, CAST(round_even(v, 0) AS INTEGER) AS cv, CAST(trunc(0.5 * 1.5 * (label * 10.0) + 40) AS INTEGER) AS h FROM points))) WHERE b / 255.0 >= 0.5) WHERE rn <= 2""", A.POINTS)
def detector_path(spark, d):
    """Regions around pixels, a detector on each, labels, and the first two per label that pass."""
    p = A.points(spark, d).select("label", "vec_id", "pixel", F.lit(None).cast("double").alias("last_size"), (c("label") * 10.0).alias("expected_size"), F.lit(40).alias("slack"), F.lit("cup").alias("phrase"))
    regions = D.searched(p, 1408, 1408).drop("pixel")
    found = D.detections(regions, "stub", ["vec_id"]).withColumn("verdict", D.label_of(c("score")))
    return Q.detector_gate(found, ["label"], ["vec_id"], c("verdict") == "visible", 2).select("label", "vec_id", F.round("score", 6).alias("score"), "verdict", "x1", "y1")


@query("qst13_qst14_escalating_pool", f"""
SELECT video_id, count(*) AS n_calls, count(*) FILTER (ok) AS n_accepted, max(multiplier) AS multiplier, string_agg(CASE WHEN ok THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY multiplier, time_sec, event_id) AS accepted FROM (
  SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY multiplier, time_sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT video_id, event_id, time_sec, CASE WHEN place <= 6 THEN 2 WHEN place <= 12 THEN 4 WHEN place <= 24 THEN 8 WHEN place <= 48 THEN 16 ELSE 32 END AS multiplier,
      CAST('0x' || substring(md5('object ' || assoc_id || '|' || x1 || '|' || y1 || '|' || x2 || '|' || y2), 1, 2) AS INTEGER) / 255.0 >= 0.93 AS ok FROM (
      SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round, assoc_id) AS place, greatest(0, least(1408, cu - 34)) AS x1, greatest(0, least(1408, cu + 34)) AS x2, greatest(0, least(1408, cv - 34)) AS y1, greatest(0, least(1408, cv + 34)) AS y2 FROM (
        SELECT *, row_number() OVER (PARTITION BY video_id, assoc_id ORDER BY time_sec, event_id) AS round, CAST(round_even(time_sec % 1408, 0) AS INTEGER) AS cu, CAST(round_even(k * 10.0, 0) AS INTEGER) AS cv FROM samples WHERE {STABLE_SQL})) WHERE place <= 96))
WHERE before < 3 GROUP BY video_id""", A.SAMPLES)
def escalating_pool(spark, d):
    """Three samples that the detector accepts from each video, objects in turns, from pools of 6, 12, 24, 48 and 96 samples; n_calls counts what the detector has seen.
    """
    s = A.samples(spark, d).where(is_stable(c("status"))).select("video_id", "assoc_id", "event_id", "time_sec", F.struct((c("time_sec") % 1408).alias("u"), (c("k") * 10.0).alias("v")).alias("pixel"))
    s = s.withColumn("round", F.row_number().over(Window.partitionBy("video_id", "assoc_id").orderBy("time_sec", "event_id")))
    s = s.select("*", F.lit(None).cast("double").alias("last_size"), F.lit(45.0).alias("expected_size"), F.lit(0.25).alias("slack"), F.concat(F.lit("object "), c("assoc_id").cast("string")).alias("phrase"))
    regions = D.searched(s, 1408, 1408).drop("pixel", "last_size", "expected_size", "slack")
    shown = D.escalated(regions, "stub", ["video_id"], ["round", "assoc_id"], ["time_sec", "event_id"], 3, 2, 32, visible=0.93)
    ids = F.transform(F.array_sort(F.collect_list(F.when(c("accepted"), F.struct("call", "event_id")))), lambda x: x["event_id"].cast("string"))
    return shown.groupBy("video_id").agg(
        F.count("*").alias("n_calls"), F.count_if("accepted").alias("n_accepted"), F.max("multiplier").alias("multiplier"), F.array_join(F.when(F.count_if("accepted") > 0, ids), ",").alias("accepted")
    )


@query("udf7_audit_loop", """
SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'skipped' WHEN hit THEN 'detected' ELSE 'not_detected' END AS verdict, CASE WHEN label % 3 <> 0 AND hit THEN round(b / 255.0, 6) END AS match_score FROM (
  SELECT *, u BETWEEN 352 - 20 AND 704 + 20 AND v BETWEEN 352 - 20 AND 704 + 20 AS hit, CAST('0x' || substring(md5('object ' || label || '|0|0|1408|1408'), 1, 2) AS INTEGER) AS b FROM points)""", A.POINTS)
def audit(spark, d):
    """The stub looks at the whole image for each sample that has a pixel."""
    p = A.points(spark, d).select("vec_id", F.when(c("label") % 3 != 0, c("pixel")).alias("pixel"), F.concat(F.lit("object "), c("label").cast("string")).alias("phrase"))
    return D.audited(p, "stub", ["vec_id"], 1408, 1408).select("vec_id", "verdict", F.round("match_score", 6).alias("match_score"))


@query("flt19_still_hidden", "SELECT s.event_id FROM samples s WHERE NOT EXISTS (SELECT 1 FROM samples x WHERE x.assoc_id = s.assoc_id AND x.time_sec = s.time_sec AND x.raw_status = 'ok' AND x.in_view)", A.SAMPLES)
def still_hidden(spark, d):
    s = A.samples(spark, d).withColumn("query_sec", c("time_sec"))
    return Q.still_hidden(s.select(*OBJ, "query_sec", "event_id"), s.select(*OBJ, "query_sec", "raw_status", "in_view")).select("event_id")


@query("qst22_visible_records", f"""
SELECT video_id, assoc_id, key, CAST(row_number() OVER (ORDER BY video_id, rn) AS BIGINT) AS trajectory_id, 'Yes' AS answer, CASE WHEN md5('4|' || key || '|Yes') < md5('4|' || key || '|No') THEN 'Yes,No' ELSE 'No,Yes' END AS choices FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY time_sec, event_id) AS rn FROM (
    SELECT *, printf('%s:%d:%.6f', video_id, assoc_id, time_sec) AS key, row_number() OVER (PARTITION BY video_id, assoc_id, round(time_sec, 6) ORDER BY time_sec, event_id) AS once FROM samples WHERE {STABLE_SQL}) WHERE once = 1) WHERE rn <= 20""", A.SAMPLES)
def visible_records(spark, d):
    s = A.samples(spark, d).where(is_stable(c("status"))).select(*OBJ, "time_sec", "event_id")
    r = Q.visible_records(s, F.concat(F.lit("object "), c("assoc_id").cast("string")), "time_sec", ["time_sec", "event_id"], 20, 4)
    step = c("incremental_steps")[0]
    return r.select("video_id", "assoc_id", "key", "trajectory_id", step["answer"].alias("answer"), F.array_join(step["choices"], ",").alias("choices"))


CHOSEN = """labels_ AS (SELECT *, CASE WHEN fixture = 'mid-air' THEN 'mid-air' ELSE lower(regexp_replace(split_part(fixture, '.', 1), '^[^_]*_', '')) END AS label FROM samples WHERE fixture IS NOT NULL),
words AS (SELECT list_sort(list(DISTINCT label)) AS w FROM labels_ WHERE label NOT IN ('', 'mid-air')),
others AS (SELECT event_id, label, list_slice(list_transform(list_sort(list_transform(list_filter(w, lambda x: x <> label), lambda x: {'h': md5('6|' || CAST(event_id AS VARCHAR) || '|' || x), 'c': x})), lambda s: s.c), 1, 2) AS o FROM labels_, words WHERE label NOT IN ('', 'mid-air')),
chosen AS (SELECT event_id, label, list_transform(list_sort(list_transform(list_concat([label], o), lambda x: {'h': md5('6:order|' || CAST(event_id AS VARCHAR) || '|' || x), 'c': x})), lambda s: s.c) AS choices FROM others WHERE len(o) = 2)"""


@query("qst21_rnd2_absolute_answers", "SELECT event_id, label AS answer, array_to_string(choices, ',') AS choices, CAST(list_position(choices, label) - 1 AS INTEGER) AS correct_idx FROM chosen", A.SAMPLES, CHOSEN)
def absolute_answers(spark, d):
    s = A.samples(spark, d)
    vocabulary = s.select(N.fixture_label(c("fixture")).alias("label")).distinct()
    out = Q.absolute_answers(s.select("event_id", "fixture"), "fixture", vocabulary, "label", c("event_id"), 3, 6)
    return out.select("event_id", "answer", F.array_join("choices", ",").alias("choices"), "correct_idx")


@query("qst18_video_windows", "SELECT video_id, min(time_sec) AS start_sec, max(time_sec) AS end_sec, count(*) AS n_samples FROM samples s WHERE assoc_id = (SELECT min(assoc_id) FROM samples x WHERE x.video_id = s.video_id) GROUP BY video_id", A.SAMPLES)
def video_windows(spark, d):
    return Q.video_windows(A.samples(spark, d))


@query("qst18_precomputed_tracks", f"""
SELECT r.video_id, r.assoc_id, sum(r.n)::BIGINT AS n_samples, coalesce(sum(r.n) FILTER (r.visible), 0)::BIGINT AS n_visible, count(*) FILTER (r.visible) AS n_spans, round(coalesce(sum(r.end_sec - r.start_sec) FILTER (r.visible), 0), 4) AS visible_sec, max(l.last) AS last_index, max(w.start_sec) AS window_start, max(w.n_samples) AS window_samples
FROM (SELECT video_id, assoc_id, run, visible, min(time_sec) AS start_sec, max(time_sec) AS end_sec, count(*) AS n FROM (
  SELECT *, sum(ch) OVER (PARTITION BY video_id, assoc_id ORDER BY time_sec, event_id) AS run FROM (SELECT *, CASE WHEN visible IS DISTINCT FROM lag(visible, 1, visible) OVER (PARTITION BY video_id, assoc_id ORDER BY time_sec, event_id) THEN 1 ELSE 0 END AS ch FROM over_)) GROUP BY ALL) r
JOIN (SELECT video_id, assoc_id, max(CASE WHEN visible THEN i END) AS last FROM over_ GROUP BY ALL) l USING (video_id, assoc_id)
JOIN (SELECT video_id, min(time_sec) AS start_sec, count(*) AS n_samples FROM samples s WHERE assoc_id = (SELECT min(assoc_id) FROM samples x WHERE x.video_id = s.video_id) GROUP BY video_id) w USING (video_id) GROUP BY r.video_id, r.assoc_id""", A.SAMPLES, A.SPANS, f"""strongest AS (
  SELECT s.event_id, coalesce(arg_max(p.status, ({PRIORITY_SQL.format(s='p.status')}, -(p.end_sec - p.start_sec), p.start_sec)), 'out_of_view') AS status FROM samples s
  LEFT JOIN (SELECT * FROM spans WHERE end_sec IS NOT NULL) p ON s.assoc_id = p.assoc_id AND s.time_sec BETWEEN p.start_sec - 1e-9 AND p.end_sec + 1e-9 GROUP BY s.event_id),
over_ AS (SELECT s.video_id, s.assoc_id, s.event_id, s.time_sec, s.i, t.status IN ('in_view', 'observed_visible_in_open_fixture', 'in_motion') AS visible FROM samples s JOIN strongest t USING (event_id))""")
def precomputed_tracks(spark, d):
    """Samples overlaid with external spans, their visible runs and the video's window."""
    spans = A.spans(spark, d).where("end_sec is not null").select("assoc_id", "start_sec", "end_sec", "status")
    t = Q.precomputed_tracks(A.samples(spark, d).select(*OBJ, "time_sec", "event_id"), spans, ["event_id"])
    seen = F.filter("samples", lambda x: x["visible"])
    return t.select(
        *OBJ, F.size("samples").cast("long").alias("n_samples"), F.size(seen).cast("long").alias("n_visible"), F.size("visible_spans").cast("long").alias("n_spans"),
        F.round(F.aggregate("visible_spans", F.lit(0.0), lambda a, x: a + (x["end_sec"] - x["start_sec"])), 4).alias("visible_sec"), F.element_at("samples", -1)["last_visible_index"].cast("long").alias("last_index"),
        c("window.start_sec").alias("window_start"), c("window.n_samples").alias("window_samples"),
    )


FAMILIES = """starts AS (SELECT video_id, min(time_sec) AS first_sec FROM samples GROUP BY 1),
cand AS (SELECT s.*, time_sec - 30 - 5 AS clip_start, (k - 50) / 2.0 AS deg, CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 3 = 0 THEN 'left' ELSE 'right' END END AS rel,
  CASE WHEN fixture IS NOT NULL AND fixture <> 'mid-air' THEN lower(regexp_replace(split_part(fixture, '.', 1), '^[^_]*_', '')) END AS label FROM samples s JOIN starts USING (video_id) WHERE time_sec - 30 - 5 >= first_sec - 1e-9),
rot AS (SELECT *, CASE WHEN abs(deg) <= 20 AND abs(abs(deg) - 8) >= 2 AND abs(abs(deg) - 15) >= 2 AND abs(abs(deg) - 25) >= 2 THEN CASE WHEN abs(deg) < 8 THEN 'no significant rotation' WHEN deg > 0 THEN 'left' ELSE 'right' END END AS turn FROM cand),
asked AS (SELECT event_id, video_id, time_sec, clip_start, 'oos_abs_fixture_location' AS question_class, label AS answer FROM rot WHERE label IS NOT NULL
  UNION ALL SELECT event_id, video_id, time_sec, clip_start, 'oos_rel_anchor_location', rel FROM rot WHERE rel IS NOT NULL UNION ALL SELECT event_id, video_id, time_sec, clip_start, 'camera_rotation', turn FROM rot WHERE rel IS NOT NULL AND turn IS NOT NULL)"""


@query("qst15_flat_questions", """
SELECT question_class || '_h5p0_' || CAST(row_number() OVER (PARTITION BY question_class ORDER BY video_id, time_sec, event_id) - 1 AS VARCHAR) AS question_id, event_id, answer, round(time_sec - clip_start, 6) AS query_in_clip_sec FROM asked""", A.SAMPLES, FAMILIES)
def flat_questions(spark, d):
    """Absolute, relative and rotation questions of all candidates; a candidate without a relative answer has no rotation question either."""
    from ..functions import geometry as M

    s = A.samples(spark, d)
    starts = s.groupBy("video_id").agg(F.min("time_sec").alias("start_sec"))
    cand = Q.clip_window(s.select("video_id", "assoc_id", "event_id", "k", "fixture", c("time_sec").alias("query_sec"), (c("time_sec") - 30).alias("clip_start_sec")), starts, 5.0)
    label, deg = N.fixture_label(c("fixture")), (c("k") - 50) / F.lit(2.0)
    relative = F.when(c("k") % 4 != 0, F.when(c("k") % 3 == 0, "left").otherwise("right"))
    turn = F.when((F.abs(deg) <= 20) & M.off_boundaries(deg), M.side_label(deg))
    families = {"oos_abs_fixture_location": (F.lit(True), F.when(N.valid_fixture(label), label)), "oos_rel_anchor_location": (F.lit(True), relative), "camera_rotation": (F.lit(True), turn)}
    return Q.flat_questions(cand, 5.0, families, ["query_sec", "event_id"]).select("question_id", "event_id", "answer", F.round("query_in_clip_sec", 6).alias("query_in_clip_sec"))


@query("flt1_jn24_states_at_times", """
SELECT t.video_id, t.time_sec, o.assoc_id, arg_min(s.event_id, (abs(s.time_sec - t.time_sec), s.time_sec)) AS event_id FROM (SELECT DISTINCT video_id, floor(time_sec / 60) * 60 AS time_sec FROM samples) t
JOIN (SELECT DISTINCT video_id, assoc_id FROM samples WHERE assoc_id % 7 <> 0) o ON o.video_id = t.video_id LEFT JOIN samples s ON s.assoc_id = o.assoc_id AND abs(s.time_sec - t.time_sec) <= 20 GROUP BY 1, 2, 3""", A.SAMPLES)
def states_at_times(spark, d):
    """Objects that are named as skipped have no states."""
    s = A.samples(spark, d)
    times = s.select("video_id", (F.floor(c("time_sec") / 60) * 60).cast("double").alias("time_sec")).distinct()
    objects = s.select("video_id", "assoc_id", F.concat(F.lit("object"), F.when(c("assoc_id") % 7 == 0, " (skipped)").otherwise("")).alias("name")).distinct()
    seen = s.groupBy("video_id", "assoc_id", c("time_sec").alias("sample_sec")).agg(F.min("event_id").alias("event_id"))
    return V.states_at(times, objects, seen, 20.0).select("video_id", "time_sec", "assoc_id", c("state.event_id").alias("event_id"))


TOKEN = "'<TIME ' || printf('%02d:%02d:%02d.%d', t // 36000, t // 600 % 60, t // 10 % 60, t % 10) || ' video 1>'"
NUMBER = "rtrim(rtrim(format('{{:.4f}}', round_even({x}, 4)), '0'), '.')"
TIMED = "timed AS (SELECT *, CAST(round_even(time_sec * 10, 0) AS BIGINT) AS t, 'object ' || CAST(assoc_id AS VARCHAR) AS name FROM samples)"


def step_columns(rows, step, *keys):
    s = step.alias("s")
    return rows.select(*keys, s).where("s is not null").select(*keys, c("s.question").alias("question"), c("s.answer").alias("answer"), F.array_join("s.choices", ",").alias("choices"), c("s.correct_idx").alias("correct_idx"))


@query("qst1_visibility_step", f"""
SELECT event_id, 'Is ' || name || ' visible at ' || {TOKEN} || '?' AS question, answer, choices, CAST(CASE WHEN starts_with(choices, answer) THEN 0 ELSE 1 END AS INTEGER) AS correct_idx FROM (
  SELECT *, CASE WHEN {VISIBLE_SQL} THEN 'Yes' ELSE 'No' END AS answer, CASE WHEN md5('1|' || event_id || '|Yes') < md5('1|' || event_id || '|No') THEN 'Yes,No' ELSE 'No,Yes' END AS choices FROM timed)""", A.SAMPLES, TIMED)
def visibility_steps(spark, d):
    name = F.concat(F.lit("object "), c("assoc_id").cast("string"))
    return step_columns(A.samples(spark, d), Q.visibility_step(name, c("time_sec"), is_visible(c("status")), c("event_id"), 1), "event_id")


@query("qst2_last_seen_step", f"""
SELECT event_id, 'When was ' || name || ' last visible before ' || {TOKEN} || '?' AS question, {TOKEN.replace('t ', 's ').replace(' t %', ' s %')} || ' (' || {NUMBER.format(x='(k + 1) / 64.0')} || ', ' || {NUMBER.format(x='k / 128.0')} || ')' AS answer, '' AS choices, CAST(NULL AS INTEGER) AS correct_idx FROM (
  SELECT *, CAST(round_even(greatest(0.0, time_sec - 7.5) * 10, 0) AS BIGINT) AS s FROM timed)""", A.SAMPLES, TIMED)
def last_seen_steps(spark, d):
    name = F.concat(F.lit("object "), c("assoc_id").cast("string"))
    return step_columns(A.samples(spark, d), Q.last_seen_step(name, c("time_sec"), c("time_sec") - 7.5, (c("k") + 1) / F.lit(64.0), c("k") / F.lit(128.0)), "event_id")


@query("qst3_stopped_step", f"""
SELECT event_id, 'When did ' || name || ' stop moving before ' || {TOKEN} || '?' AS question, {TOKEN.replace('t ', 's ').replace(' t %', ' s %')} AS answer, '' AS choices, CAST(NULL AS INTEGER) AS correct_idx FROM (
  SELECT *, CAST(round_even(greatest(0.0, time_sec - 3) * 10, 0) AS BIGINT) AS s FROM timed)""", A.SAMPLES, TIMED)
def stopped_steps(spark, d):
    name = F.concat(F.lit("object "), c("assoc_id").cast("string"))
    return step_columns(A.samples(spark, d), Q.stopped_step(name, c("time_sec"), c("time_sec") - 3), "event_id")


@query("qst7_distance_step", """
SELECT vec_id, 'How far is it from the anchor?' AS question, answer, 'close,medium,far' AS choices, CAST(CASE answer WHEN 'close' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS INTEGER) AS correct_idx FROM (
  SELECT *, CASE WHEN dist < 1.0 THEN 'close' WHEN dist < 1.5 THEN 'medium' ELSE 'far' END AS answer FROM (SELECT vec_id, sqrt((ax - qx) * (ax - qx) + (ay - qy) * (ay - qy) + (az - qz) * (az - qz)) AS dist FROM points))""", A.POINTS)
def distance_steps(spark, d):
    from ..functions.geometry import distance

    return step_columns(A.points(spark, d), Q.distance_step(F.lit("it"), F.lit("the anchor"), distance(c("a"), c("b"))), "vec_id")


AREAS = """areas AS (SELECT p_partkey, p_brand AS area, list_sort([p_brand, 'left', 'right', 'middle', 'corner']) AS w FROM part),
picked AS (SELECT p_partkey, area, list_slice(list_transform(list_sort(list_transform(list_filter(w, lambda x: x <> area), lambda x: {'h': md5('3|' || p_partkey || '|' || x), 'c': x})), lambda s: s.c), 1, 3) AS o FROM areas),
areas_chosen AS (SELECT p_partkey, area, list_transform(list_sort(list_transform(list_concat([area], o), lambda x: {'h': md5('3:order|' || p_partkey || '|' || x), 'c': x})), lambda s: s.c) AS choices FROM picked)"""


@query("qst8_area_step", "SELECT p_partkey, 'Which part of the counter is it on?' AS question, area AS answer, array_to_string(choices, ',') AS choices, CAST(list_position(choices, area) - 1 AS INTEGER) AS correct_idx FROM areas_chosen", AREAS)
def area_steps(spark, d):
    words = F.array(c("p_brand"), *(F.lit(x) for x in ("left", "right", "middle", "corner")))
    return step_columns(A.read(spark, d, "part"), Q.area_step(F.lit("it"), c("p_brand"), words, c("p_partkey"), 3), "p_partkey")


@query("qst9_qst16_trajectory_records", """
SELECT video_id, event_id, row_number() OVER (ORDER BY video_id, rn) AS trajectory_id, 1 + CAST(in_view AS INTEGER) + CAST(NOT occluded AS INTEGER) AS n_steps, CAST(k % 2 = 0 AS INTEGER) AS n_branches FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY time_sec, event_id) AS rn FROM samples) WHERE rn <= 30""", A.SAMPLES)
def trajectory_sizes(spark, d):
    """Steps that are null are left out of a record; branches stand in their own group."""
    s = A.samples(spark, d).select("video_id", "event_id", "time_sec", F.lit("1").alias("s1"), F.when(c("in_view"), "2").alias("s2"), F.when(~c("occluded"), "3").alias("s3"), F.when(c("k") % 2 == 0, "5a").alias("b1"))
    r = Q.trajectories(s, ["time_sec", "event_id"], ["s1", "s2", "s3"], ["b1"], 30)
    return r.select("video_id", "event_id", "trajectory_id", F.size("incremental_steps").alias("n_steps"), F.size(c("branch_groups")["post_step4"]).alias("n_branches"))


def tok(t):
    return TOKEN.replace("t ", f"CAST(round_even({t} * 10, 0) AS BIGINT) ")


def drawn(words, seed):
    """A list of words in the order of a seed."""
    return f"list_transform(list_sort(list_transform({words}, lambda w: {{'h': md5('{seed}|' || key || '|' || w), 'word': w}})), lambda e: e.word)"


QUADRANT = "CASE WHEN abs({z}) >= 0.05 AND abs({x}) >= 0.05 AND abs(abs(degrees(atan2({x}, {z}))) - 90) >= 5 THEN (CASE WHEN {z} > 0 THEN 'Front' ELSE 'Back' END) || (CASE WHEN {x} > 0 THEN '-right' ELSE '-left' END) END"
VOCABULARY = "['counter', 'drawer', 'cupboard', 'fridge', 'oven', 'bin']"
TRAJECTORIES = f"""cand AS (SELECT video_id, assoc_id, query_sec, usable_sec, last_stable_sec FROM ({HIDDEN_SQL})),
named AS (SELECT n.*, arg_min(o.assoc_id, (md5('11|' || n.assoc_id || '|' || o.assoc_id), o.assoc_id)) AS anchor_id FROM cand n JOIN (SELECT DISTINCT video_id, assoc_id FROM b WHERE stable) o ON o.video_id = n.video_id AND o.assoc_id <> n.assoc_id GROUP BY ALL),
placed AS (SELECT n.*, 'object ' || assoc_id AS name, 'object ' || anchor_id AS other, video_id || ':' || assoc_id || ':' || query_sec AS key, ['counter', 'drawer', 'mid-air'][assoc_id % 3 + 1] AS label, p.ax AS x, p.ay AS y, p.az AS z, p.ax - q.ax AS dx, p.ay - q.ay AS dy, p.az - q.az AS dz, p.c, p.s
  FROM named n JOIN points p ON p.vec_id = assoc_id JOIN points q ON q.vec_id = anchor_id),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY query_sec, assoc_id) AS rn FROM placed WHERE label <> 'mid-air') WHERE rn <= 30),
rec AS (SELECT *, row_number() OVER (ORDER BY video_id, rn) AS trajectory_id, {QUADRANT.format(x='x', z='z')} AS own, {QUADRANT.format(x='(c * dx + s * dz)', z='(c * dz - s * dx)')} AS rel, CASE WHEN sqrt(dx * dx + dy * dy + dz * dz) < 1.0 THEN 'close' WHEN sqrt(dx * dx + dy * dy + dz * dz) < 1.5 THEN 'medium' ELSE 'far' END AS far,
  {drawn(f"list_concat([label], list_slice({drawn(f'list_filter({VOCABULARY}, lambda w: w <> label)', '2')}, 1, 4))", '2:order')} AS c4, {drawn(f"list_concat([label], list_slice({drawn(f'list_filter({VOCABULARY}, lambda w: w <> label)', '3')}, 1, 3))", '3:order')} AS c5 FROM kept),
each_step AS (
  SELECT trajectory_id, '1' AS step, 'visibility' AS question_class, 'Is ' || name || ' visible at ' || {tok('query_sec')} || '?' AS question, 'No' AS answer, {drawn("['Yes', 'No']", '1')} AS choices FROM rec
  UNION ALL SELECT trajectory_id, '2', 'last_visible', 'When was ' || name || ' last visible before ' || {tok('query_sec')} || '?', {tok('last_stable_sec')} || ' (' || {NUMBER.format(x='x')} || ', ' || {NUMBER.format(x='y')} || ')', [] FROM rec
  UNION ALL SELECT trajectory_id, '3', 'stopped_moving', 'When did ' || name || ' stop moving before ' || {tok('query_sec')} || '?', {tok('usable_sec')}, [] FROM rec
  UNION ALL SELECT trajectory_id, '4', 'nearest_fixture', 'What is ' || name || ' closest to?', label, c4 FROM rec
  UNION ALL SELECT trajectory_id, '5a', 'quadrant', 'In which direction is ' || name || '?', own, ['Front-left', 'Front-right', 'Back-left', 'Back-right'] FROM rec WHERE own IS NOT NULL
  UNION ALL SELECT trajectory_id, '5b', 'relation', 'Where is ' || name || ' from ' || other || '?', rel, ['Front-left', 'Front-right', 'Back-left', 'Back-right'] FROM rec WHERE rel IS NOT NULL
  UNION ALL SELECT trajectory_id, '5c', 'distance', 'How far is ' || name || ' from ' || other || '?', far, ['close', 'medium', 'far'] FROM rec
  UNION ALL SELECT trajectory_id, '5d', 'counter_area', 'Which part of the counter is ' || name || ' on?', label, c5 FROM rec)"""


@query("qst1_qst10_qst16_trajectory_steps", """
SELECT trajectory_id, step, question_class, question, answer, array_to_string(choices, ',') AS choices, CAST(CASE WHEN len(choices) > 0 THEN list_position(choices, answer) - 1 END AS INTEGER) AS correct_idx FROM each_step""", A.SAMPLES, BOOL_RUNS, A.TRACKS, A.POINTS, TRAJECTORIES)
def trajectory_steps(spark, d):
    """All that stands in the records of hidden objects, a row for each step and branch."""
    r = trajectory_records(spark, d, 30)
    every = F.concat("incremental_steps", c("branch_groups")["post_step4"])
    out = r.select("trajectory_id", F.explode(every).alias("s")).select("trajectory_id", "s.*")
    return out.select("trajectory_id", "step", "question_class", "question", "answer", F.array_join("choices", ",").alias("choices"), "correct_idx")


@query("qst10_drop_reasons", f"""
SELECT event_id, CASE WHEN raw_status = 'no_valid_mask' THEN 'no_state' WHEN {VISIBLE_SQL} THEN 'one_step' WHEN k % 5 = 0 THEN 'never_visible' WHEN k % 7 = 0 THEN 'in_motion' WHEN fixture IS NULL OR fixture = 'mid-air' THEN 'invalid_fixture' WHEN k % 11 = 0 THEN 'no_placement'
  WHEN k % 13 = 0 THEN 'seen_before_placement' WHEN k % 17 = 0 THEN 'ambiguous_direction' WHEN k % 19 = 0 THEN 'no_anchor' WHEN occluded THEN 'branch_failed' ELSE 'kept' END AS reason FROM samples""", A.SAMPLES)
def drop_reasons(spark, d):
    none = lambda n, x: F.when(c("k") % n != 0, x)
    placed = none(11, F.when(c("k") % 13 == 0, c("time_sec") + 5).otherwise(c("time_sec") - 5))
    reason = Q.drop_reason(c("raw_status") != "no_valid_mask", is_visible(c("status")), none(5, c("time_sec")), c("k") % 7 == 0, N.valid_fixture(N.fixture_label(c("fixture"))), placed, none(17, F.lit("Front-left")), none(19, F.lit("a")), ~c("occluded"))
    return A.samples(spark, d).select("event_id", reason.alias("reason"))


@query("rnd3_seeded_anchor", f"""
SELECT s.event_id, arg_min(o.assoc_id, (md5('11|' || s.assoc_id || '|' || o.assoc_id), o.assoc_id)) AS anchor_id FROM samples s JOIN (SELECT DISTINCT video_id, floor(time_sec / 10) AS t, assoc_id FROM samples WHERE {STABLE_SQL}) o
ON o.video_id = s.video_id AND o.t = floor(s.time_sec / 10) AND o.assoc_id <> s.assoc_id GROUP BY s.event_id""", A.SAMPLES)
def seeded_anchor(spark, d):
    s = A.samples(spark, d).withColumn("query_sec", F.floor(c("time_sec") / 10))
    eligible = s.where(is_stable(c("status"))).select("video_id", "query_sec", c("assoc_id").alias("anchor_id")).distinct()
    return Q.with_anchor(s.select("video_id", "assoc_id", "query_sec").distinct(), eligible, 11).join(s.select("video_id", "assoc_id", "query_sec", "event_id"), ["video_id", "assoc_id", "query_sec"]).select("event_id", "anchor_id")
