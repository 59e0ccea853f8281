"""The visibility pipeline: classified samples, coarse intervals, refinement, merged tracks and references between objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import anchored, project_fisheye, transform
from ..functions.statuses import fallback_status, is_stable, is_visible, status_ladder
from .aggregates import refined_verdicts
from .islands import collapse_runs, last_true_index
from .temporal import last_started, nearest_join, stab_first


def classified_samples(samples: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("video_id", "fixture"), bucket: float = 32.0) -> DataFrame:
    """samples with status, reason and confidence. Of the fixture intervals that hold a sample's time the earliest counts.

    samples: video_id, assoc_id, i, time_sec, raw_status, in_view, occluded, fixture; intervals: keys, state, confidence, start_sec, end_sec.
    """
    held = stab_first(samples, intervals.select(*keys, "start_sec", "end_sec", "state", "confidence"), keys, "time_sec", "start_sec", "end_sec", [F.coalesce("end_sec", F.lit(float("inf"))), "state"], bucket)
    rung = status_ladder(
        F.col("raw_status") == "in_motion", ~F.col("raw_status").isin("no_track_available", "no_valid_mask"), F.col("in_view"), F.col("s_state"), F.col("s_confidence"), F.col("occluded")
    )
    return held.withColumn("_r", rung).select(*(x for x in samples.columns if x not in ("status", "reason", "confidence")), "_r.status", "_r.reason", "_r.confidence")


def coarse_intervals(classified: DataFrame) -> DataFrame:
    """Runs of equal status per object; reason, fixture and confidence are those of a run's first sample."""
    return collapse_runs(classified, ["video_id", "assoc_id"], ["time_sec", "i"], "time_sec", "status", ["reason", "fixture", "confidence"])


def refined_intervals(coarse: DataFrame, detections: DataFrame, target: str = "potentially_visible_inside_open_fixture", least: int = 1) -> DataFrame:
    """coarse with the intervals of the target status given the verdict of their detections; all others pass by, before any detection is looked at."""
    keys = ["video_id", "assoc_id", "run"]
    verdict = refined_verdicts(detections, keys, least).withColumnRenamed("status", "_verdict")
    out = coarse.where(F.col("status") == target).join(verdict, keys, "left")
    out = out.withColumn("status", F.coalesce("_verdict", F.lit("assumed_not_visible_in_open_fixture"))).drop("_verdict").fillna(0, ["n_visible", "n_partial", "n_tested"])
    rest = coarse.where(F.col("status") != target)
    return rest.unionByName(out, allowMissingColumns=True).fillna(0, ["n_visible", "n_partial", "n_tested"])


def merged_tracks(samples: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """samples with the status of the span that started last, their visible and stable flags, and the index of the last visible sample up to each."""
    held = last_started(samples, spans, keys, "time_sec")
    out = held.withColumn("status", fallback_status(F.col("match")["status"], F.col("raw_status"), F.col("in_view"))).drop("match")
    out = out.withColumn("visible", is_visible(F.col("status"))).withColumn("stable", is_stable(F.col("status")))
    return last_true_index(out, keys, ["time_sec", "i"], "i", F.col("visible"), "last_visible_index")


def states_at(times: DataFrame, objects: DataFrame, samples: DataFrame, tolerance: float) -> DataFrame:
    """The state of every object of a video at each of its sample times: times and objects meet by video, and the nearest sample within the tolerance counts."""
    grid = times.join(objects.where(~F.col("name").contains("(skipped)")), "video_id")
    return nearest_join(grid, samples, ["video_id", "assoc_id"], "time_sec", "sample_sec", tie="earlier", tolerance=tolerance, name="state")


def projected(points: DataFrame, poses: DataFrame, params: Sequence[float], keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """points(world, frame_index) with camera and pixel by the pose of the nearest frame; of two the later. No pose: both null; an invalid pixel: only that."""
    out = nearest_join(points, poses, keys, "frame_index", "pose_frame", tie="later", name="_p")
    out = out.withColumn("camera", transform(F.col("_p")["camera_from_world"], F.col("world")))
    return out.withColumn("pixel", project_fisheye(F.col("camera"), params)).drop("_p")


def relative_to_anchor(states: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every object at its anchor's time with the way from the anchor along the camera's axes; null where one of both has no place."""
    a = anchors.select(*keys, F.col("assoc_id").alias("anchor_id"), F.col("world").alias("anchor_world"))
    out = states.join(a, list(keys)).where("assoc_id <> anchor_id")
    return out.withColumn("relative", F.when(F.col("world").isNotNull() & F.col("anchor_world").isNotNull(), anchored(F.col("camera_from_world"), F.col("world"), F.col("anchor_world")))).drop("anchor_world")


def central_object(states: DataFrame, keys: Sequence[str], visible: Column, width: float, height: float) -> DataFrame:
    """Of each time the visible object whose pixel is closest to the image's centre; of equals the smaller id."""
    du, dv = F.col("pixel")["u"] - width / 2, F.col("pixel")["v"] - height / 2
    return states.where(visible & F.col("pixel").isNotNull()).groupBy(*keys).agg(F.min_by("assoc_id", F.struct((du * du + dv * dv).alias("d"), F.col("assoc_id").alias("a"))).alias("anchor_id"))


def matched_boxes(pixels: DataFrame, boxes: DataFrame, keys: Sequence[str], slack: float = 20.0, cell: float = 128.0) -> DataFrame:
    """pixels with how many boxes hold them, grown by the slack, and the box whose centre is closest, of equals the smaller id. Repeated pixels come each.

    Both meet in cells of the image: a box is listed in those that it reaches, and a pixel looks through the list of its own cell.
    """
    u, v = F.col("pixel")["u"], F.col("pixel")["v"]
    reach = lambda a, b: F.sequence(F.floor((F.col(a) - slack) / cell), F.greatest(F.floor((F.col(a) - slack) / cell), F.floor((F.col(b) + slack) / cell)))
    listed = boxes.withColumn("_cu", F.explode(reach("x1", "x2"))).withColumn("_cv", F.explode(reach("y1", "y2")))
    listed = listed.groupBy(*keys, "_cu", "_cv").agg(F.collect_list(F.struct("box_id", "x1", "y1", "x2", "y2")).alias("_boxes"))
    near = pixels.withColumn("_cu", F.floor(u / cell)).withColumn("_cv", F.floor(v / cell)).join(listed, [*keys, "_cu", "_cv"], "left")
    held = F.filter("_boxes", lambda b: (u >= b["x1"] - slack) & (u <= b["x2"] + slack) & (v >= b["y1"] - slack) & (v <= b["y2"] + slack))

    def rank(b: Column) -> Column:
        du, dv = u - (b["x1"] + b["x2"]) / 2.0, v - (b["y1"] + b["y2"]) / 2.0
        return F.struct((du * du + dv * dv).alias("d"), b["box_id"].alias("box_id"))

    near = near.withColumn("_held", F.transform(F.coalesce(held, F.array().cast(listed.schema["_boxes"].dataType)), rank))
    return near.select(*pixels.columns, F.size("_held").cast("long").alias("n_boxes"), F.array_min("_held")["box_id"].alias("box_id"))


def run_stages(samples: DataFrame, intervals: DataFrame, keys: Sequence[str], occlusion: DataFrame | None = None, detections: DataFrame | None = None) -> DataFrame:
    """Intervals of all objects from samples to the end: occlusion flags by line of sight if there are any, fixture intervals, runs, and detections' verdicts if there are any.

    occlusion(video_id, assoc_id, i, geometrically_occluded) replaces the samples' flag where it isn't null.
    """
    if occlusion is not None:
        flags = occlusion.select("video_id", "assoc_id", "i", F.col("geometrically_occluded").alias("_flag"))
        samples = samples.join(flags, ["video_id", "assoc_id", "i"], "left").withColumn("occluded", F.coalesce("_flag", "occluded")).drop("_flag")
    coarse = coarse_intervals(classified_samples(samples, intervals, keys))
    return coarse if detections is None else refined_intervals(coarse, detections)
