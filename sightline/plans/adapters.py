"""Views of the supplied tables in the roles of the engine's own: samples, spans, tracks, masks, points. Each has the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import vec


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of objects; a unit of time is 1,000 seconds, so that they share an axis with the spans."""
    e = read(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    base = e.select(
        F.concat(F.lit("P0"), (F.col("user_id") % 4 + 1).cast("string"), F.lit("-v")).alias("video_id"), F.col("user_id").alias("assoc_id"), "event_id",
        (micros / F.lit(1000000000.0)).alias("time_sec"), "event_type", F.col("value").alias("score"), k.alias("k"),
    )
    status = (
        F.when(F.col("event_type") == "view", "in_view").when(F.col("event_type") == "click", "in_motion").when(F.col("event_type") == "purchase", "observed_visible_in_open_fixture")
        .when(F.col("event_type") == "signup", "out_of_view").otherwise("unobservable_no_data")
    )
    raw = F.when(F.col("event_type") == "click", "in_motion").when(F.col("event_type") == "error", "no_valid_mask").otherwise("ok")
    m = F.col("k") % 6
    fixture = F.when(m == 1, "P01_counter.001").when(m == 2, "P01_cupboard.002").when(m == 3, "mid-air").when(m == 4, "P01_drawer.001").when(m == 5, "P01_fridge.003")
    tier = F.element_at(F.array(*(F.lit(x) for x in ("very_low", "low", "medium", "high", "very_high"))), F.col("k") % 5 + 1)
    out = base.select(
        "*", status.alias("status"), raw.alias("raw_status"), F.col("event_type").isin("view", "purchase").alias("in_view"), (F.col("k") % 7 == 0).alias("occluded"),
        fixture.alias("fixture"), tier.alias("tier"), (F.col("event_type") != "error").alias("has_data"),
    )
    return out.withColumn("i", F.row_number().over(Window.partitionBy("assoc_id").orderBy("time_sec", "event_id")) - 1)


SAMPLES = """
samples AS (
  SELECT *, row_number() OVER (PARTITION BY assoc_id ORDER BY time_sec, event_id) - 1 AS i FROM (
    SELECT 'P0' || CAST(user_id % 4 + 1 AS VARCHAR) || '-v' AS video_id, user_id AS assoc_id, event_id,
      (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000000.0 AS time_sec, event_type, value AS score, k,
      CASE event_type WHEN 'view' THEN 'in_view' WHEN 'click' THEN 'in_motion' WHEN 'purchase' THEN 'observed_visible_in_open_fixture' WHEN 'signup' THEN 'out_of_view' ELSE 'unobservable_no_data' END AS status,
      CASE event_type WHEN 'click' THEN 'in_motion' WHEN 'error' THEN 'no_valid_mask' ELSE 'ok' END AS raw_status,
      event_type IN ('view', 'purchase') AS in_view, k % 7 = 0 AS occluded,
      CASE k % 6 WHEN 1 THEN 'P01_counter.001' WHEN 2 THEN 'P01_cupboard.002' WHEN 3 THEN 'mid-air' WHEN 4 THEN 'P01_drawer.001' WHEN 5 THEN 'P01_fridge.003' END AS fixture,
      ['very_low', 'low', 'medium', 'high', 'very_high'][k % 5 + 1] AS tier, event_type <> 'error' AS has_data
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
  )
)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as status spans of objects: days since 1995, some without an end."""
    o = read(spark, sf_dir, "orders")
    start = F.expr("cast(datediff(o_orderdate, date'1995-01-01') as double)")
    end = F.when(F.col("o_orderkey") % 17 != 0, start + 1 + F.col("o_orderkey") % 30)
    status = F.when(F.col("o_orderstatus") == "O", "in_view").when(F.col("o_orderstatus") == "F", "out_of_view").otherwise("geometrically_occluded")
    return o.select((F.col("o_custkey") % 150).alias("assoc_id"), F.col("o_orderkey").alias("span_id"), start.alias("start_sec"), end.cast("double").alias("end_sec"), status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "open").otherwise("closed").alias("state"), (F.col("o_orderkey") % 7).cast("int").alias("rank"))


SPANS = """
spans AS (
  SELECT o_custkey % 150 AS assoc_id, o_orderkey AS span_id, day AS start_sec, CASE WHEN o_orderkey % 17 <> 0 THEN day + 1 + o_orderkey % 30 END AS end_sec,
    CASE o_orderstatus WHEN 'O' THEN 'in_view' WHEN 'F' THEN 'out_of_view' ELSE 'geometrically_occluded' END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN 'open' ELSE 'closed' END AS state, CAST(o_orderkey % 7 AS INTEGER) AS rank
  FROM (SELECT *, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day FROM orders)
)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with an end as tracks, in the order of their start."""
    s = spans(spark, sf_dir).where("end_sec is not null")
    return s.select("assoc_id", F.col("span_id").alias("track_id"), "start_sec", "end_sec", (F.row_number().over(Window.partitionBy("assoc_id").orderBy("start_sec", "span_id")) - 1).alias("track_pos"))


TRACKS = f"""{SPANS}, tracks AS (
  SELECT assoc_id, span_id AS track_id, start_sec, end_sec, row_number() OVER (PARTITION BY assoc_id ORDER BY start_sec, span_id) - 1 AS track_pos
  FROM spans WHERE end_sec IS NOT NULL
)"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as masks of tracks: one for each frame, with a place made of its part and some without."""
    frame = (F.col("l_linenumber") * 30 + F.col("l_quantity").cast("int")).alias("frame_number")
    one = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track_id"), frame).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    placed = lambda c: F.when(F.col("part") % 11 != 0, c)
    return one.select(
        "track_id", "frame_number", F.col("part").alias("mask_pos"), F.concat(F.lit("P0"), (F.col("supp") % 3 + 1).cast("string")).alias("participant"),
        F.element_at(F.array(F.lit("counter"), F.lit("drawer"), F.lit("cupboard"), F.lit("fridge")), (F.col("supp") % 4 + 1).cast("int")).alias("fixture_type"),
        F.concat(F.lit("f"), (F.col("supp") % 13).cast("string")).alias("fixture"),
        placed(F.col("part") % 100 / 25.0 - 2.0).alias("x"), placed(F.col("part") % 37 / 18.5 - 1.0).alias("y"), placed(F.col("part") % 53 / 10.6 + 0.1).alias("z"),
    )


MASKS = """
masks AS (
  SELECT track_id, frame_number, part AS mask_pos, 'P0' || CAST(supp % 3 + 1 AS VARCHAR) AS participant, ['counter', 'drawer', 'cupboard', 'fridge'][supp % 4 + 1] AS fixture_type,
    'f' || CAST(supp % 13 AS VARCHAR) AS fixture, CASE WHEN part % 11 <> 0 THEN CAST(part % 100 AS DOUBLE) / 25.0 - 2.0 END AS x,
    CASE WHEN part % 11 <> 0 THEN CAST(part % 37 AS DOUBLE) / 18.5 - 1.0 END AS y, CASE WHEN part % 11 <> 0 THEN CAST(part % 53 AS DOUBLE) / 10.6 + 0.1 END AS z
  FROM (SELECT l_orderkey AS track_id, l_linenumber * 30 + CAST(l_quantity AS INTEGER) AS frame_number, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY ALL)
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as places, gazes and poses; the rotation turns about the vertical axis by an angle of 3-4-5 triangles."""
    e = lambda i: F.col("embedding")[i].cast("double")
    turn = F.when(F.col("vec_id") % 2 == 0, F.lit(0.6)).otherwise(F.lit(0.8))
    other = F.when(F.col("vec_id") % 2 == 0, F.lit(0.8)).otherwise(F.lit(-0.6))
    zero, one = F.lit(0.0), F.lit(1.0)
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id"), F.col("label"), vec(e(0), e(1), e(2)).alias("a"), vec(e(3), e(4), e(5)).alias("b"), vec(e(6), e(7), e(8)).alias("gaze"),
        vec(e(9), e(10), F.abs(e(11)) + 0.5).alias("camera"), F.array(turn, zero, other, e(12), zero, one, zero, e(13), -other, zero, turn, e(14)).alias("pose"),
        F.struct((e(15) * 500 + 704).alias("u"), (e(16) * 500 + 704).alias("v")).alias("pixel"),
    )


POINTS = """
points AS (
  SELECT vec_id, label, e[1] AS ax, e[2] AS ay, e[3] AS az, e[4] AS qx, e[5] AS qy, e[6] AS qz, e[7] AS gx, e[8] AS gy, e[9] AS gz, e[10] AS cx, e[11] AS cy, abs(e[12]) + 0.5 AS cz,
    c, s, e[13] AS tx, e[14] AS ty, e[15] AS tz, e[16] * 500 + 704 AS u, e[17] * 500 + 704 AS v
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN vec_id % 2 = 0 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS c,
    CASE WHEN vec_id % 2 = 0 THEN CAST(0.8 AS DOUBLE) ELSE CAST(-0.6 AS DOUBLE) END AS s FROM embeddings)
)"""

#: A published lens: f, cu, cv, k0..k5, p0, p1, s0..s3.
LENS = (600.0, 704.0, 704.0, 0.1, -0.05, 0.01, 0.0, 0.0, 0.0, 0.001, -0.002, 0.0005, 0.0001, -0.0003, 0.0002)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as steps of trajectories."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("trajectory_id"), F.col("turn").alias("position"), (F.col("turn") + 1).cast("string").alias("step"), F.col("role").alias("question_class"),
        F.col("text").alias("question"), F.concat(F.lit("A: "), F.col("text")).alias("answer"), (F.col("turn") >= 5).alias("is_branch"),
        (F.length("text") % 11 == 0).alias("skipped"), (F.length("text") % 2 == 0).alias("is_mcq"), (F.length("text") % 4).cast("int").alias("correct_idx"),
    )


STEPS = """
steps AS (
  SELECT conv_id AS trajectory_id, turn AS position, CAST(turn + 1 AS VARCHAR) AS step, role AS question_class, text AS question, 'A: ' || text AS answer,
    turn >= 5 AS is_branch, length(text) % 11 = 0 AS skipped, length(text) % 2 = 0 AS is_mcq, CAST(length(text) % 4 AS INTEGER) AS correct_idx
  FROM conversations
)"""
