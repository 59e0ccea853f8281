"""Aggregations over samples, intervals and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import disagreement
from .islands import changes


def fixture_catalog(masks: DataFrame, keys: Sequence[str] = ("participant", "fixture_type")) -> DataFrame:
    """Per fixture its mean place over masks that have one (else null), and how many fixtures its type has."""
    places = masks.groupBy(*keys, "fixture").agg(*(F.round(F.avg(c), 6).alias(c) for c in "xyz"))
    return places.withColumn("n_instances", F.count("*").over(Window.partitionBy(*keys)))


def time_extent(frames: DataFrame, keys: Sequence[str], frame: str, fps: float) -> DataFrame:
    return frames.groupBy(*keys).agg((F.min(frame) / F.lit(fps)).alias("first_sec"), (F.max(frame) / F.lit(fps)).alias("last_sec"))


def refined_verdicts(samples: DataFrame, keys: Sequence[str], least: int = 1, partial_counts: bool = True) -> DataFrame:
    """Per interval the counts of labels, the best score and the status that they give."""
    label = F.col("label")
    out = samples.groupBy(*keys).agg(
        F.count_if(label == "visible").cast("long").alias("n_visible"), F.count_if(label == "partially_visible").cast("long").alias("n_partial"),
        F.count_if(label != "skipped").cast("long").alias("n_tested"), F.max(F.when(label != "skipped", F.col("score"))).alias("max_score"),
    )
    positive = F.col("n_visible") + (F.col("n_partial") if partial_counts else F.lit(0))
    status = (
        F.when(F.col("n_tested") == 0, "assumed_not_visible_in_open_fixture")
        .when(positive >= max(1, least), "observed_visible_in_open_fixture").otherwise("observed_not_visible_in_open_fixture")
    )
    return out.withColumn("status", status)


def duration_by_status(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds of each object in each status; an interval that ends before it starts counts nothing."""
    return intervals.groupBy(*keys, "status").agg(F.round(F.sum(F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))), 3).alias("duration_sec"))


def duration_map(durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    return durations.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "duration_sec")))).alias("duration_by_status"))


def centroids(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean place of the masks that have all three coordinates."""
    return masks.where("x is not null and y is not null and z is not null").groupBy(*keys).agg(*(F.round(F.avg(c), 6).alias(c) for c in "xyz"))


def relocations(tracks: DataFrame, keys: Sequence[str], order: Sequence[str], shift: float = 0.15) -> DataFrame:
    """Per object how often consecutive tracks differ in fixture, and how often their centroids are at least `shift` apart; tracks without either are left out first."""
    known = tracks.where("fixture is not null and x is not null and y is not null and z is not null")
    apart = F.sqrt(sum(((F.col(c) - F.col(f"prev_{c}")) * (F.col(c) - F.col(f"prev_{c}")) for c in "xyz"), F.lit(0.0)))
    return changes(known, keys, order, {"n_transitions": F.col("fixture") != F.col("prev_fixture"), "n_shifts": apart >= shift}).withColumn("total", F.col("n_transitions") + F.col("n_shifts"))


def ambiguous(objects: DataFrame, keys: Sequence[str], name: Column, item: str) -> DataFrame:
    """Objects that share their normalised name with another one of their key; an empty name is shared with none."""
    named = objects.withColumn("_name", name)
    shared = named.where("_name <> ''").groupBy(*keys, "_name").agg(F.count_distinct(item).alias("_n")).where("_n > 1")
    return named.join(shared, [*keys, "_name"], "left_semi").drop("_name")


def decision_counts(decisions: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row: decisions in all and of each kind."""
    return decisions.agg(F.count("*").alias("n_total"), *(F.count_if(F.col("decision") == k).cast("long").alias(f"n_{k}") for k in kinds))


def first_reasons(decisions: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per name that was dropped the first reason."""
    return decisions.where("decision <> 'kept'").groupBy("name").agg(F.min_by("decision", F.struct(*order)).alias("reason"))


def audit_report(samples: DataFrame, statuses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per status of a fixed list: frames checked and detected, intervals and those detected, their rates (null without any) and how far these are from the status's claim.

    samples: status, verdict (detected, not_detected, skipped) per frame; verdicts: the same per interval; statuses: status, claim.
    """
    def rates(rows: DataFrame, what: str) -> DataFrame:
        out = rows.groupBy("status").agg(F.count_if(F.col("verdict") != "skipped").cast("long").alias(f"n_{what}"), F.count_if(F.col("verdict") == "detected").cast("long").alias(f"n_{what}_detected"))
        return out.withColumn(f"{what}_rate", F.round(F.try_divide(f"n_{what}_detected", f"n_{what}"), 6))

    out = statuses.join(rates(samples, "frames"), "status", "left").join(rates(verdicts, "intervals"), "status", "left")
    out = out.fillna(0, ["n_frames", "n_frames_detected", "n_intervals", "n_intervals_detected"])
    return out.withColumn("frame_disagreement", F.round(disagreement(F.col("claim"), F.col("frames_rate")), 6)).withColumn("interval_disagreement", F.round(disagreement(F.col("claim"), F.col("intervals_rate")), 6))


def interval_verdicts(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A majority of an interval's scored frames; a tie is detected, and without scored frames it is skipped."""
    hit, miss = F.count_if(F.col("verdict") == "detected"), F.count_if(F.col("verdict") == "not_detected")
    return samples.groupBy(*keys).agg(F.when(hit + miss == 0, "skipped").when(hit >= miss, "detected").otherwise("not_detected").alias("verdict"))


def value_counts(rows: DataFrame, keys: Sequence[str], value: str, most: int = 10) -> DataFrame:
    """The most frequent values of each class with their counts; of equal counts the smaller value."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col(value)))).where(F.col("rn") <= most)


def majority_baseline(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per class the most frequent value and the share of rows that it would get right."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(
        F.max_by(value, F.struct("n", F.col(value))).alias("majority"), F.max("n").alias("n_majority"), F.sum("n").alias("n_total"), F.round(F.max("n") / F.sum("n"), 6).alias("accuracy")
    )


def visible_seconds(intervals: DataFrame, keys: Sequence[str], visible: Column, step: float) -> DataFrame:
    """Seconds in visible statuses, each interval being a step longer than its samples are apart; most visible first, then by name descending."""
    out = intervals.groupBy(*keys).agg(F.round(F.sum(F.when(visible, F.col("end_sec") - F.col("start_sec") + step).otherwise(0.0)), 6).alias("visible_sec"))
    return out.orderBy(F.col("visible_sec").desc(), *(F.col(k).desc() for k in keys))


def coverage(intervals: DataFrame, visible: Column, length: float, objects: int, buckets: int = 600) -> DataFrame:
    """Of each time bucket that has any the share of objects that are visible in it.

    A difference array: each interval adds one at its first bucket and takes it off after its last, and a running sum over the buckets, a fixed number of rows, gives their
    counts. Two rows an interval, combined before the shuffle, whatever its length.
    """
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor(F.col(c) / F.lit(length / buckets)))).cast("int")
    ends = F.array(F.struct(at("start_sec").alias("bucket"), F.lit(1).alias("step")), F.struct((F.greatest(at("start_sec"), at("end_sec")) + 1).alias("bucket"), F.lit(-1).alias("step")))
    steps = intervals.where(visible).select(F.explode(ends).alias("e")).groupBy("e.bucket").agg(F.sum("e.step").alias("_step"))
    every = intervals.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(steps, "bucket", "left")
    count = F.sum(F.coalesce("_step", F.lit(0))).over(Window.orderBy("bucket"))  # a row for each bucket
    return every.select("bucket", count.alias("_n")).where("_n > 0").select("bucket", F.round(F.col("_n") / F.lit(objects), 6).alias("density"))


def balanced_objects(samples: DataFrame, keys: Sequence[str], flag: Column, least: int = 10) -> DataFrame:
    """Per object min(samples with the flag, samples without it), if both are at least `least`."""
    yes, no = F.count_if(flag), F.count_if(~flag)
    return samples.groupBy(*keys).agg(F.least(yes, no).cast("long").alias("balance"), yes.cast("long").alias("n_true"), no.cast("long").alias("n_false")).where(F.col("balance") >= least)


def time_shares(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The share of each object's time in each status."""
    sums = intervals.groupBy(*keys, "status").agg(F.sum(F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec"))).alias("_s"))
    return sums.withColumn("share", F.round(F.try_divide(F.col("_s"), F.sum("_s").over(Window.partitionBy(*keys))), 6)).drop("_s")


def sight_lists(samples: DataFrame, keys: Sequence[str], visible: Column, name: str) -> DataFrame:
    """Per rendered time the names in sight and out of sight, in the order of lower-cased names."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(F.lower(name).alias("l"), F.col(name).alias("n"))))), lambda s: s["n"])
    return samples.groupBy(*keys).agg(listed(visible).alias("in_sight"), listed(~visible).alias("out_of_sight"))


def video_ends(frames: DataFrame, events: DataFrame, videos: DataFrame, fps: float) -> DataFrame:
    """Per video its end: the last frame's time, else the last event's end, else 0."""
    last = frames.groupBy("video_id").agg((F.max("frame_index") / F.lit(fps)).alias("_f"))
    heard = events.groupBy("video_id").agg(F.max("end_sec").alias("_e"))
    return videos.join(last, "video_id", "left").join(heard, "video_id", "left").select("video_id", F.coalesce("_f", "_e", F.lit(0.0)).alias("video_end"))
