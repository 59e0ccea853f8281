"""Audit manifests that grow: signatures, stable item ids, and samples of the statuses that a manifest lacks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import file_name, item_id
from ..sources.scratch import checkpointed
from .rank import sampled_frames, sampled_per_group

INTERVAL = ["video_id", "assoc_id", "start_sec", "end_sec"]
ITEMS = "signature string, status string, item_id string, video_id string, assoc_id string, object_name string, start_sec double, end_sec double, frames array<struct<time_sec:double,image_path:string>>, pool_size long, n_intervals_sampled long"


def content_signature(rows: DataFrame, columns: Sequence[str]) -> str:
    """What tells one set of rows from another, in any order: their number, and the sum of 32 bits of each row's MD5."""
    bits = F.conv(F.substring(F.md5(F.to_json(F.struct(*columns))), 1, 8), 16, 10).cast("long")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(bits), F.lit(0))).first()
    return f"{n}:{total}"


def signature(config: dict, content: str) -> str:
    """The SHA-1 of the settings that decide a sample, keys in order, and of what it is drawn from."""
    return hashlib.sha1(json.dumps({**config, "content": content}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def frame_id(time: Column) -> Column:
    return item_id(F.col("video_id"), F.col("assoc_id"), F.col("start_sec"), F.col("end_sec"), time)


def interval_id() -> Column:
    """An interval's id, which its frames share."""
    times = [F.format_string("%.6f", t) for t in ("start_sec", "end_sec")]
    return F.substring(F.sha1(F.concat_ws("|", "video_id", "assoc_id", *times, F.lit("interval"))), 1, 12)


def sampled_items(pool: DataFrame, intervals: int, frames: int, fps: float, seed: int, by_interval: bool) -> DataFrame:
    """Items of each status of pool(status, video_id, assoc_id, object_name, start_sec, end_sec): first `intervals` intervals, then `frames` frames of each, in seeded orders.

    Each status and each interval has a seed of its own, so what one gives doesn't hang on the others. An item is an interval with its frames, or a frame.
    """
    sizes = pool.groupBy("status").agg(F.count("*").alias("pool_size"))
    chosen = sampled_per_group(pool, ["status"], INTERVAL, intervals, seed, salt=True)
    shots = sampled_frames(chosen, ["status", *INTERVAL], "start_sec", "end_sec", fps, frames, seed)
    path = F.concat(F.lit("frames/"), file_name(F.col("status")), F.lit("/"), frame_id(F.col("time_sec")), F.lit(".jpg"))
    shot = F.struct("time_sec", path.alias("image_path"))
    if by_interval:
        items = shots.groupBy("status", *INTERVAL).agg(F.first("object_name").alias("object_name"), F.sort_array(F.collect_list(shot)).alias("frames")).withColumn("item_id", interval_id())
    else:
        items = shots.select("status", *INTERVAL, "object_name", F.array(shot).alias("frames"), frame_id(F.col("time_sec")).alias("item_id"))
    return items.join(sizes, "status").withColumn("n_intervals_sampled", F.least(F.col("pool_size"), F.lit(intervals)))


def extended(existing: DataFrame | None, pool: DataFrame, statuses: Sequence[str], intervals: int, frames: int, fps: float, seed: int, by_interval: bool = False, config: dict | None = None) -> DataFrame:
    """A manifest with items of all the statuses asked for: those that the existing one has are left as they are, the others are sampled and added.

    An existing manifest must have been made from the same pool with the same settings (config adds the caller's own), which its signature tells; another one raises. A status without intervals gets no item,
    and is looked at again next time. pool: one row for each interval; ids are strings.
    """
    mark = signature({"intervals": intervals, "frames": frames, "fps": fps, "seed": seed, "grain": "interval" if by_interval else "frame", **(config or {})}, content_signature(pool, ["status", *INTERVAL, "object_name"]))
    have = []
    if existing is not None:
        marks = {r[0] for r in existing.select("signature").distinct().limit(2).collect()}
        if marks - {mark}:
            raise ValueError("the manifest was made from another pool or with other settings")
        have = [r[0] for r in existing.select("status").distinct().where(F.col("status").isin(*statuses)).collect()]  # some of those asked for
    missing = [s for s in statuses if s not in have]
    names = [x.split()[0] for x in ITEMS.split(", ")]
    new = sampled_items(pool.where(F.col("status").isin(*missing)), intervals, frames, fps, seed, by_interval).withColumn("signature", F.lit(mark)).select(names)
    return checkpointed(new if existing is None else existing.select(names).unionByName(new))
