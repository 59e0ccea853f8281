"""Runs, running values and state machines over ordered samples: one window per object, split by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .temporal import asof_join


def microseconds(time: str) -> Column:
    """Seconds as a whole number of microseconds, which range frames need."""
    return F.round(F.col(time) * 1e6).cast("long")


def with_runs(samples: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """samples with `run`: how often the value has changed so far in its key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce((~value.eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(0))
    first = F.row_number().over(w) == 1
    return samples.withColumn("_c", F.when(first, 0).otherwise(changed)).withColumn("run", F.sum("_c").over(w)).drop("_c")


def collapse_runs(samples: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, value: str, carry: Sequence[str] = ()) -> DataFrame:
    """Spans of samples in order with an equal value: from the first sample's time to the last's. `carry` columns come from the first sample."""
    runs = with_runs(samples, keys, order, F.col(value))
    firsts = [F.min_by(c, F.struct(*order)).alias(c) for c in carry]
    return runs.groupBy(*keys, "run", value).agg(F.min(time).alias("start_sec"), F.max(time).alias("end_sec"), F.count("*").alias("n_samples"), *firsts)


def last_true_index(samples: DataFrame, keys: Sequence[str], order: Sequence[str], index: str, flag: Column, name: str, inclusive: bool = True) -> DataFrame:
    """samples with the index of the last sample so far (inclusive), or before (not), whose flag holds; null if none."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return samples.withColumn(name, F.last(F.when(flag, F.col(index)), ignorenulls=True).over(w))


def last_true_time(samples: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, flag: Column, name: str, block: float | None = None) -> DataFrame:
    """samples with the time of the last sample strictly before in time whose flag holds. block: a width in time by which a long key is split over tasks."""
    if block:
        seen = samples.where(flag).select(*keys, F.col(time).alias("_seen"))
        return asof_join(samples, seen, keys, time, "_seen", strict=True, name="_hit", block=block).withColumn(name, F.col("_hit")["_seen"]).drop("_hit")
    w = Window.partitionBy(*keys).orderBy(microseconds(time)).rangeBetween(Window.unboundedPreceding, -1)
    return samples.withColumn(name, F.max(F.when(flag, F.col(time))).over(w))


def within_seconds(samples: DataFrame, keys: Sequence[str], time: str, flag: Column, reach: float, name: str) -> DataFrame:
    """samples with the times, in order, of the flagged samples at most `reach` seconds away."""
    w = Window.partitionBy(*keys).orderBy(microseconds(time)).rangeBetween(-round(reach * 1e6), round(reach * 1e6))
    return samples.withColumn(name, F.array_sort(F.collect_list(F.when(flag, F.col(time))).over(w)))


def changes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], differs: dict[str, Column]) -> DataFrame:
    """(keys, n, a count for each name): how often a condition over a row and the one before it (columns prev_*) holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    names = [c for c in rows.columns if c not in keys]
    before = rows.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in names), F.row_number().over(w).alias("_n"))
    return before.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(c & (F.col("_n") > 1)).cast("long").alias(k) for k, c in differs.items()))


def open_close_intervals(events: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State intervals of fixtures from events(state, start_sec, end_sec): each lasts to the next change.

    Events are ordered by their start; the state changes at an event's END. Repeated states are folded into the first. From 0 to the first event
    its opposite is filled in (backfilled); the last interval lasts to the end, of ends(keys or some of them, video_end).
    """
    w = Window.partitionBy(*keys).orderBy("start_sec", "end_sec", "state")
    kept = events.withColumn("_before", F.lag("state").over(w)).where("_before is null or _before <> state").drop("_before")
    steps = kept.withColumn("_next", F.lead("end_sec").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    known = steps.join(ends, [k for k in keys if k in ends.columns], "left")
    last = F.coalesce("_next", "video_end")
    forward = known.select(*keys, "state", F.col("end_sec").alias("start_time"), last.alias("end_time"), F.lit(False).alias("backfilled"))
    opposite = F.when(F.col("state") == "open", "closed").otherwise("open")
    back = known.where("_first").select(*keys, opposite.alias("state"), F.lit(0.0).alias("start_time"), F.col("end_sec").alias("end_time"), F.lit(True).alias("backfilled"))
    return forward.unionByName(back)


def interval_violations(intervals: DataFrame, keys: Sequence[str], statuses: Sequence[str], counts: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Rows that break a rule, with the rule: unknown_status, negative_length, overlap with the interval before, negative_count.

    Intervals are ordered by start, end and `order`, whose last column should tell all of a key apart: else it is open which of two equal ones comes first.
    """
    w = Window.partitionBy(*keys).orderBy("start_sec", "end_sec", *order)
    before = F.lag("end_sec").over(w)
    rules = [
        F.when(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), "unknown_status"),
        F.when(F.col("end_sec") < F.col("start_sec"), "negative_length"),
        F.when(before > F.col("start_sec"), "overlap"),
        *(F.when(F.col(c) < 0, "negative_count") for c in counts),
    ]
    return intervals.withColumn("_rules", F.array_compact(F.array(*rules))).withColumn("rule", F.explode("_rules")).drop("_rules")
