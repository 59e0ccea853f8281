"""Ranking, limits, diversity and seeded sampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.digests import first_numbers
from ..functions.names import hash_order, hash_unit


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """rows with their number from 1 in their group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], count: int) -> DataFrame:
    """The first rows of each group; Spark limits each group before it shuffles."""
    return numbered(rows, keys, order, "_rn").where(F.col("_rn") <= count).drop("_rn")


def confidence_of(best: Column, runner_up: Column) -> Column:
    """high from 0.55 with a lead of 0.12; medium from 0.30; low from 0.10; else very_low."""
    return F.when((best >= 0.55) & (best - runner_up >= 0.12), "high").when(best >= 0.30, "medium").when(best >= 0.10, "low").otherwise("very_low")


def best_and_runner_up(rows: DataFrame, keys: Sequence[str], score: str, item: str) -> DataFrame:
    """(keys, best, best_score, runner_up_score, confidence): of equal scores the smaller item; a single item has a runner-up of -1."""
    two = numbered(rows, keys, [F.col(score).desc(), F.col(item)]).where("rn <= 2")
    out = two.groupBy(*keys).agg(
        F.max(F.when(F.col("rn") == 1, F.col(item))).alias("best"), F.max(F.when(F.col("rn") == 1, F.col(score))).alias("best_score"),
        F.coalesce(F.max(F.when(F.col("rn") == 2, F.col(score))), F.lit(-1.0)).alias("runner_up_score"),
    )
    return out.withColumn("confidence", confidence_of(F.col("best_score"), F.col("runner_up_score")))


def location_first(rows: DataFrame, keys: Sequence[str], place: str, order: str, name: str = "place_order") -> DataFrame:
    """rows numbered so that the first of each place (null is one) comes before all others, each part by `order`."""
    first = F.row_number().over(Window.partitionBy(*keys, place).orderBy(order)) > 1
    return numbered(rows.withColumn("_again", first.cast("int")), keys, ["_again", order], name).drop("_again")


def round_robin(rows: DataFrame, keys: Sequence[str], group: str, order: Sequence[str], limit: int) -> DataFrame:
    """rows in turns over the groups of a key: all firsts, then all seconds, up to the limit; `turn` numbers them."""
    dealt = numbered(rows, [*keys, group], order, "_round")
    return numbered(dealt, keys, ["_round", group], "turn").where(F.col("turn") <= limit).drop("_round")


def keep_first(rows: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def capped_with_ids(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int, name: str = "record_id") -> DataFrame:
    """At most cap rows of each key, with a running id over what is left, in the keys' order.

    The ids of a key follow those of the keys before it: running sums of the keys' counts, of which there is one row a key.
    """
    kept = numbered(rows, keys, order, "_n").where(F.col("_n") <= cap)
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("_c"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("_first", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return kept.join(first, list(keys)).withColumn(name, F.col("_first") + F.col("_n")).drop("_first", "_n")


def evenly_spaced(rows: DataFrame, keys: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """count rows of each key, evenly spread over their order with both ends: indexes rint(i * (N - 1) / (count - 1)), halves to even, each once."""
    w = Window.partitionBy(*keys)
    indexed = numbered(rows, keys, order, "_n").withColumn("_total", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i * (F.col("_total") - 1) / F.lit(max(1, count - 1))))
    return indexed.where(F.array_contains(wanted, (F.col("_n") - 1).cast("double"))).drop("_n", "_total")


def closest_sample(rows: DataFrame, by: Sequence[str], time: str, target: Column, values: Sequence[str]) -> DataFrame:
    """Of each group the values of the sample closest to the target; of equals the earlier."""
    found = rows.groupBy(*by).agg(F.min_by(F.struct(*values), F.struct(F.abs(F.col(time) - target).alias("d"), F.col(time).alias("t"))).alias("_v"))
    return found.select(*by, *(F.col("_v")[v].alias(v) for v in values))


def sampled_per_group(rows: DataFrame, group: Sequence[str], key: Sequence[str], count: int, seed: int | str, salt: bool = False) -> DataFrame:
    """At most count rows of each group, without replacement, in a seeded order; with salt each group has a seed of its own."""
    parts = [F.col(k) for k in (*group, *key)] if salt else [F.col(k) for k in key]
    return top_per_group(rows, group, [hash_order(seed, *parts), *key], count)


def sampled_frames(spans: DataFrame, key: Sequence[str], start: str, end: str, fps: float, count: int, seed: int | str) -> DataFrame:
    """count different frames of each span, seeded; frame_index and its time.

    Spans are shuffled, not their frames: all rows of a key come together, and each key draws from all its frames, which are hashed many at a time (`digests`).
    """
    first, last = F.rint(F.col(start) * fps).cast("long"), F.greatest(F.rint(F.col(start) * fps), F.rint(F.col(end) * fps)).cast("long")
    rest = [c for c in spans.columns if c not in key]
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much to hash: tasks must not be merged
    grouped = spans.repartition(parts, *key).select(*key, F.struct(*rest, first.alias("_low"), last.alias("_high")).alias("_s")).where("_s._low is not null and _s._high is not null").groupBy(*key).agg(F.collect_list("_s").alias("_spans"))

    @F.arrow_udf("array<struct<frame_index:long,_i:long>>")
    def drawn(begins: pa.Array, lows: pa.Array, highs: pa.Array) -> pa.Array:
        offsets = lows.offsets.to_numpy() - lows.offsets[0].as_py()
        owner = np.repeat(np.arange(len(begins)), np.diff(offsets))
        key, span, frame = first_numbers([b.encode() for b in begins.to_pylist()], owner, lows.flatten().to_numpy(), highs.flatten().to_numpy(), count)
        places = pa.StructArray.from_arrays([pa.array(frame, pa.int64()), pa.array(span - offsets[key], pa.int64())], names=["frame_index", "_i"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(key, np.arange(len(begins) + 1)), pa.int32()), places)

    begin = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key), F.lit(""))
    frames = drawn(begin, F.transform("_spans", lambda s: s["_low"]), F.transform("_spans", lambda s: s["_high"]))
    taken = grouped.select(*key, "_spans", frames.alias("_drawn")).select(*key, "_spans", F.explode("_drawn").alias("_f"))
    one = F.get("_spans", F.col("_f._i"))
    out = taken.select(*key, *(one[c].alias(c) for c in rest), F.col("_f.frame_index").alias("frame_index"))
    return out.select(*spans.columns, "frame_index", F.round(F.col("frame_index") / F.lit(fps), 6).alias("time_sec"))


def uniform_times(rows: DataFrame, key: Sequence[str], low: Column, high: Column, seed: int | str, name: str) -> DataFrame:
    """rows with a seeded time between low and high; null where there is no room."""
    return rows.withColumn(name, F.when(high > low, F.round(low + hash_unit(seed, *(F.col(k) for k in key)) * (high - low), 6)))


def ends_and_middle(start: Column, end: Column, count: int) -> Column:
    """First, last and evenly spread middle times, each once to a thousandth."""
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(start + (end - start) * i / F.lit(max(1, count - 1)), 3))))


def chosen_or_sampled(rows: DataFrame, column: str, chosen: Sequence | None, count: int, seed: int | str) -> DataFrame:
    """The rows with the given ids, or count ids in a seeded order (a report of that size)."""
    if chosen:
        return rows.where(F.col(column).isin(*chosen))
    ids = rows.select(column).distinct().orderBy(hash_order(seed, F.col(column)), column).limit(count)
    return rows.join(F.broadcast(ids), column, "left_semi")  # at most `count` rows


def selected_videos(rows: DataFrame, column: str, explicit: Sequence[str] | None, participants: Sequence[str]) -> DataFrame:
    """The videos of an explicit list, else all that occur, of the participants if any are given."""
    found = rows.select(column).where(F.col(column).isNotNull()).distinct()
    if explicit:
        return found.where(F.col(column).isin(*explicit))
    return found.where(F.split(column, "-")[0].isin(*participants)) if participants else found
