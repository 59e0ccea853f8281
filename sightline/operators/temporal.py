"""Joins and lookups over time: as-of in both directions, stabbing, overlaps, and time grids.

All joins carry an equality key. Unbounded sides are merged in one sort per key (as-of) or meet in time buckets (intervals), so
neither side is broadcast or collected.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FPS = 30.0
EPS = 1e-9


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, order: Sequence[str] = (), direction: str = "backward", strict: bool = False, name: str = "match", block: float | None = None) -> DataFrame:
    """left with a struct column `name` of the right row next to its time on the given side; null if there is none.

    backward: the last right row at or before the time (strict: before); forward: the first at or after (strict: after).
    Of rows with equal times the last in `order` wins backward and the first forward; with an order only that one of each time is left before the sort. Both sides are
    sorted together once by key and time, and a running last or first value carries the match. A null time matches nothing.

    block: a width in time by which a key is split over tasks, for keys that are too long for one. Each block is sorted by itself; the value that it starts from is
    carried by a scan over the blocks' last (or first) rows.
    """
    return _merged(left, [(right, right_time, order, direction, strict, name)], keys, time, block)


def asof_both(left: DataFrame, before: tuple, after: tuple, keys: Sequence[str], time: str, block: float | None = None) -> DataFrame:
    """left with the rows next to its time on both sides, from one sort. before and after: (rows, time column, order, strict, name)."""
    sides = [(*x[:3], direction, *x[3:]) for x, direction in ((before, "backward"), (after, "forward"))]
    return _merged(left, sides, keys, time, block)


def _merged(left: DataFrame, sides: list[tuple], keys: Sequence[str], time: str, block: float | None) -> DataFrame:
    lefts, split = [c for c in left.columns if c not in keys], ["_block"] if block else []
    cut = lambda rows: rows.withColumn("_block", F.floor(F.col("_t") / block)) if block else rows
    l = cut(left.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*lefts).alias("_l")))
    timeless = l.where("_t is null") if block else None
    both = asked = l.where("_t is not null") if block else l
    for n, (right, right_time, order, direction, strict, _) in enumerate(sides):
        back = direction == "backward"
        fields = F.struct(*(F.col(c) for c in right.columns if c not in keys)).alias(f"_r{n}")
        r = right.select(*keys, F.col(right_time).cast("double").alias("_t"), fields, *([F.struct(*order).alias("_o")] if order else [])).where("_t is not null")
        if order:
            r = r.groupBy(*keys, "_t").agg((F.max_by if back else F.min_by)(f"_r{n}", "_o").alias(f"_r{n}"))
        r = cut(r.withColumn("_side", F.lit(0 if back != strict else 2)))
        both = both.unionByName(r, allowMissingColumns=True)
        if block:
            last = (F.max_by if back else F.min_by)(f"_r{n}", "_t")
            steps = r.groupBy(*keys, "_block").agg(last.alias("_v")).unionByName(asked.select(*keys, "_block").distinct().withColumn("_asked", F.lit(True)), allowMissingColumns=True)
            steps = steps.groupBy(*keys, "_block").agg(F.first("_v", ignorenulls=True).alias("_v"), F.max("_asked").alias("_asked"))
            over = Window.partitionBy(*keys).orderBy("_block" if back else F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
            carried = F.last("_v", ignorenulls=True).over(over)
            steps = steps.withColumn(f"_r{n}", carried).where(F.col("_asked") & F.col(f"_r{n}").isNotNull())
            both = both.unionByName(steps.select(*keys, "_block", F.lit(float("-inf" if back else "inf")).alias("_t"), F.lit(0 if back else 2).alias("_side"), f"_r{n}"), allowMissingColumns=True)
    by = ["_t", "_side"]
    for n, side in enumerate(sides):
        # Forward the rows are run through from the end: a frame up to the end would be gone through anew for each row.
        w = Window.partitionBy(*keys, *split).orderBy(*(by if side[3] == "backward" else [F.desc(c) for c in by])).rowsBetween(Window.unboundedPreceding, 0)
        found = F.last(f"_r{n}", ignorenulls=True).over(w)
        both = both.withColumn(f"_found{n}", F.when(F.col("_t").isNotNull(), found))
    names = [side[5] for side in sides]
    out = both.where("_side = 1").select(*keys, "_l", *(F.col(f"_found{n}").alias(name) for n, name in enumerate(names)))
    if timeless is not None:
        out = out.unionByName(timeless.select(*keys, "_l"), allowMissingColumns=True)
    return out.select(*keys, *(F.col("_l")[c].alias(c) for c in lefts), *names)


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, order: Sequence[str] = (), tie: str = "later", tolerance: float | None = None, name: str = "match", block: float | None = None) -> DataFrame:
    """left with the right row nearest in time: of two at the same distance the later, or the earlier.

    The nearest row is the last at or before or the first after; with a tolerance, none farther away counts. block: as in asof_join.
    """
    out = asof_both(left, (right, right_time, order, False, "_before"), (right, right_time, order, True, "_after"), keys, time, block)
    before, after = F.col(time) - F.col("_before")[right_time], F.col("_after")[right_time] - F.col(time)
    later = after <= before if tie == "later" else after < before
    found = F.when(F.col("_before").isNull() | F.coalesce(later, F.lit(False)), F.col("_after")).otherwise(F.col("_before"))
    out = out.withColumn(name, found).drop("_before", "_after")
    if tolerance is not None:
        out = out.withColumn(name, F.when(F.abs(F.col(name)[right_time] - F.col(time)) <= tolerance, F.col(name)))
    return out


def exact_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, order: Sequence[str] = (), eps: float = 1e-6, name: str = "match") -> DataFrame:
    """left with the right row whose time is the same to within eps: of several the earliest, of equal times the first in `order`; null if there is none.

    Times meet in buckets of eps: a right row, the first of its time, is listed in its own and both adjacent ones, so each left row looks into one, which holds few rows.
    """
    fields = F.struct(*(F.col(c) for c in right.columns if c not in keys))
    t = F.col(right_time).cast("double")
    once = right.where(t.isNotNull()).groupBy(*keys, t.alias("_t")).agg(F.min_by(fields, F.struct(*(order or [right_time]))).alias("_v"))
    own = F.floor(F.col("_t") / eps)
    listed = once.withColumn("_b", F.explode(F.array(own - 1, own, own + 1))).groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("_t", "_v"))).alias("_near"))
    met = left.withColumn("_b", F.floor(F.col(time).cast("double") / eps)).join(listed, [*keys, "_b"], "left")
    hit = F.get(F.filter("_near", lambda x: F.abs(x["_t"] - F.col(time)) <= eps), 0)["_v"]
    return met.select(*left.columns, hit.alias(name))


def rejoin(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "left") -> DataFrame:
    """left with what right has for the same values of the columns, null being a value like others."""
    names = {c: f"_same_{c}" for c in columns}
    on = F.lit(True)
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def ended(spans: DataFrame, points: DataFrame, keys: Sequence[str], time: str, start: str, end: str) -> DataFrame:
    """spans in which an open one ends with its key's last point, so that it can be listed in buckets; one of a key without points is dropped if open."""
    last = points.groupBy(*keys).agg(F.max(F.col(time).cast("double")).alias("_last"))
    shut = spans.where(F.col(end).isNotNull())
    open_ = spans.where(F.col(end).isNull()).join(last, list(keys)).withColumn(end, F.greatest(F.col(start), F.col("_last")).cast(spans.schema[end].dataType)).drop("_last")
    return shut.unionByName(open_.select(*spans.columns))


def stab_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, start: str, end: str, eps: float = 0.0, bucket: float | None = None, how: str = "inner") -> DataFrame:
    """Each point with every span of its key that holds its time: start <= t <= end, a null end being open. Repeated points are joined each.

    bucket: a width in time by which both sides meet: a span is listed in the buckets that it reaches, so a key with many spans costs
    what really overlaps. Spans without end reach to their key's last point. how: inner, or left, which keeps points that no span holds.
    """
    names = [c for c in spans.columns if c not in keys]
    s = spans.select(*keys, *(F.col(c).alias(f"s_{c}") for c in names))
    low, high, t = F.col(f"s_{start}") - eps, F.col(f"s_{end}") + eps, F.col(time)
    if bucket is None:
        on = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in keys]
        on += [t >= low, F.col(f"s_{end}").isNull() | (t <= high)]
        return points.alias("p").join(s.alias("s"), on, how).drop(*(F.col(f"s.{k}") for k in keys))
    point = points.withColumn("_b", F.floor(t / bucket))
    s = s.withColumn("_open", F.col(f"s_{end}").isNull())
    listed = ended(s, points, keys, time, f"s_{start}", f"s_{end}").withColumn("_b", F.explode(F.sequence(F.floor(low / bucket), F.greatest(F.floor(low / bucket), F.floor(high / bucket)))))
    found = point.join(listed, [*keys, "_b"]).where((t >= low) & (t <= high)).drop("_b")
    found = found.withColumn(f"s_{end}", F.when(~F.col("_open"), F.col(f"s_{end}"))).drop("_open")
    if how == "inner":
        return found
    missed = rejoin(points, found.select(*points.columns).distinct(), points.columns, "left_anti")
    return found.unionByName(missed, allowMissingColumns=True)


def first_spans(spans: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[Column | str] = (), block: float | None = None) -> DataFrame:
    """spans, cut to the times at which each is the first (by its start, then by order) of its key's that hold them: `_after`, which must be passed, to the end.

    In that order a span is first where all before it have ended, so what is left is disjoint, at most one piece of a span, and comes from a running
    maximum of ends. A span that others cover is dropped. null start, or a null key: dropped.

    block: a width in time by which a key's starts are split over tasks; a block starts from the latest end of all blocks before it, of which there is one row each.
    """
    far, split = F.coalesce(F.col(end).cast("double"), F.lit(float("inf"))), ["_block"] if block else []
    rest = [c for c in spans.columns if c not in (*keys, start, end)]
    rows, so_far = spans.where(F.col(start).isNotNull()), F.lit(None).cast("double")
    if rest and order:
        # Of spans with equal starts and ends the others are covered by the first.
        rows = rows.groupBy(*keys, start, end).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*keys, start, end, "_v.*")
    if block:
        rows = rows.withColumn("_block", F.floor(F.col(start) / block))
        blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        tops = rows.groupBy(*keys, "_block").agg(F.max(far).alias("_top")).withColumn("_top", F.max("_top").over(blocks))
        rows, so_far = rows.join(tops, [*keys, "_block"]), F.col("_top")
    before = Window.partitionBy(*keys, *split).orderBy(start, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_after", F.greatest(F.max(far).over(before), so_far)).where(F.col("_after").isNull() | (F.col("_after") < far))
    return rows.select(*spans.columns, "_after")


def stab_first(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, start: str, end: str, order: Sequence[Column | str] = (), bucket: float = 32.0) -> DataFrame:
    """points with the columns of the first span (s_*) that holds their time, by start and then order; null without one. Each point comes once.

    Only the disjoint pieces of first_spans are joined, in time buckets, so a point meets at most the few pieces of its bucket however many spans overlap.
    """
    names = [c for c in spans.columns if c not in keys]
    pieces = ended(first_spans(spans, keys, start, end, order, bucket).withColumn("_open", F.col(end).isNull()), points, keys, time, start, end)
    t = F.col(time).cast("double")
    low = F.greatest(F.col(start).cast("double"), F.coalesce("_after", F.lit(float("-inf"))))
    pieces = pieces.withColumn("_b", F.explode(F.sequence(F.floor(low / bucket), F.greatest(F.floor(low / bucket), F.floor(F.col(end) / bucket)))))
    # A bucket's pieces are disjoint; the one that holds a time is found among them without multiplying points.
    value = F.struct(F.col(start).alias("_s"), F.col(end).alias("_e"), "_after", F.struct(*(F.when(~F.col("_open"), F.col(c)).alias(c) if c == end else F.col(c) for c in names)).alias("_v"))
    listed = pieces.groupBy(*keys, "_b").agg(F.collect_list(value).alias("_pieces"))
    out = points.withColumn("_b", F.floor(t / bucket)).join(listed, [*keys, "_b"], "left")
    held = F.filter("_pieces", lambda x: (t >= x["_s"]) & (t <= x["_e"]) & (x["_after"].isNull() | (t > x["_after"])))
    out = out.withColumn("_hit", F.get(held, 0)["_v"])
    return out.select(*points.columns, *(F.col("_hit")[c].alias(f"s_{c}") for c in names))


def first_match(joined: DataFrame, by: Sequence[str], pick: Column, values: Sequence[str], largest: bool = False) -> DataFrame:
    """One row of each group: the one whose `pick` is the smallest (or largest); an aggregation, without a sort."""
    chosen = (F.max_by if largest else F.min_by)(F.struct(*values), pick)
    return joined.groupBy(*by).agg(chosen.alias("_v")).select(*by, *(F.col("_v")[v].alias(v) for v in values))


def skyline(spans: DataFrame, points: DataFrame, keys: Sequence[str], time: str, start: str, end: str, rank: Sequence[Column], eps: float = 0.0, bucket: float = 256.0) -> DataFrame:
    """Disjoint pieces (keys, _b, _from, s_*): from `_from` to the next piece of its bucket `_b` the span with the least rank holds; s_* are null where none does.

    rank: expressions over a span's columns, called s_*. Spans hold from their start to their end, both included, a null end being open as far as the key's points reach. They are listed in
    the time buckets that they reach, which are sorted and swept with a heap: n spans give at most 2 n pieces, however they overlap, and a task holds no more than the spans that overlap at one time.
    A span with a null start or key holds nothing.
    """
    names = [c for c in spans.columns if c not in keys]
    rows = ended(spans.where(F.col(start).isNotNull()).dropna(subset=list(keys)).withColumn("_open", F.col(end).isNull()), points, keys, time, start, end)
    rows = rows.select(*keys, *(F.when(~F.col("_open"), F.col(end)).alias(f"s_{c}") if c == end else F.col(c).alias(f"s_{c}") for c in names), (F.col(start).cast("double") - eps).alias("_low"), (F.col(end).cast("double") + eps).alias("_high"))
    rows = rows.where("_low <= _high").select("*", *(r.cast("double").alias(f"_rank{i}") for i, r in enumerate(rank)))
    group, values, ranks = [*keys, "_b"], [f"s_{c}" for c in names], [f"_rank{i}" for i in range(len(rank))]
    # Of spans that hold the same times only the least can ever hold one.
    rows = rows.groupBy(*keys, "_low", "_high").agg(F.min_by(F.struct(*values, *ranks), F.struct(*ranks)).alias("_v")).select(*keys, "_low", "_high", "_v.*")
    rows = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_low") / bucket), F.floor(F.col("_high") / bucket)))).withColumn("_low", F.greatest("_low", F.col("_b") * F.lit(float(bucket))))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group, *values).schema.fields] + ["_from double"])

    def swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, heap, out, number, none = None, [], [], 0, (None,) * len(values)

        def piece(t: float) -> None:
            """From t on the top of the heap holds; what was to hold from the same time on never does."""
            if out and out[-1][0] == now and out[-1][2] == t:
                out.pop()
            out.append((now, heap[0][3] if heap else none, t))

        def expire(t: float) -> None:
            while heap and heap[0][2] <= t:
                gone = heap[0][2]
                while heap and heap[0][2] <= gone:
                    heapq.heappop(heap)
                if gone < (now[-1] + 1) * bucket:
                    piece(gone)

        for b in batches:
            # A span that holds at its end too ends before the next number.
            gone = np.nextafter(b["_high"].to_numpy(), np.inf)
            columns = [b[c].astype(object).where(b[c].notna(), None) for c in (*group, *values)]
            for low, end_, order, *row in zip(b["_low"], gone, zip(*(b[r] for r in ranks), strict=True), *columns, strict=True):
                key = tuple(row[: len(group)])
                if key != now:
                    expire(np.inf)
                    now = key
                expire(low)
                heapq.heappush(heap, (order, number, end_, tuple(row[len(group) :])))
                number += 1
                if heap[0][1] == number - 1:
                    piece(low)
            # The last piece may be replaced yet.
            yield pd.DataFrame([(*k, *v, t) for k, v, t in out[:-1]], columns=[*group, *values, "_from"], dtype=object)
            out = out[-1:]
        expire(np.inf)
        yield pd.DataFrame([(*k, *v, t) for k, v, t in out], columns=[*group, *values, "_from"], dtype=object)

    return rows.repartition(*group).sortWithinPartitions(*group, "_low", *ranks).mapInPandas(swept, schema)


def stab_strongest(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, start: str, end: str, rank: Sequence[Column], eps: float = 0.0, bucket: float = 256.0) -> DataFrame:
    """points, repeated ones too, with the columns (s_*) of the span of the least rank that holds their time; null without one. Each point meets one piece of the skyline."""
    pieces = skyline(spans, points, keys, time, start, end, rank, eps, bucket)
    held = asof_join(points.withColumn("_b", F.floor(F.col(time).cast("double") / bucket)), pieces, [*keys, "_b"], time, "_from", name="_piece")
    return held.select(*points.columns, *(F.col("_piece")[f"s_{c}"].alias(f"s_{c}") for c in spans.columns if c not in keys))


def choose_track(points: DataFrame, tracks: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """points with `track` and `relation`: the first track (by track_pos) that holds the time is in_motion; else the past one that ends last; else
    the future one that starts first; ties go to the first listed. The track that holds a time comes from the skyline of tracks, past and future from one as-of sort.
    """
    names = ["track_pos", "track_id", "start_sec", "end_sec"]
    t = tracks.select(*keys, *names)
    inside = stab_strongest(points, t, keys, time, "start_sec", "end_sec", [F.col("s_track_pos")])
    past = t.withColumn("_first_listed", -F.col("track_pos"))
    out = asof_both(inside, (past, "end_sec", ["_first_listed"], True, "_past"), (t, "start_sec", ["track_pos"], True, "_future"), keys, time)
    held = F.col("s_track_pos").isNotNull()
    pick = lambda n: F.when(held, F.col(f"s_{n}")).otherwise(F.coalesce(F.col("_past")[n], F.col("_future")[n]))
    relation = F.when(held, "in_motion").when(F.col("_past").isNotNull(), "past").when(F.col("_future").isNotNull(), "future").otherwise("no_track_available")
    return out.select(*points.columns, *(pick(n).alias(n) for n in names), relation.alias("relation"))


def pick_mask(tracks: DataFrame, masks: DataFrame, last: bool = True) -> DataFrame:
    """(track_id, mask fields): the mask of the track's highest (or lowest) frame; of masks with equal frames the first listed. Masks that aren't in the table are dropped."""
    fields = [c for c in masks.columns if c not in ("track_id",)]
    key = F.struct("frame_number", (-F.col("mask_pos")).alias("m")) if last else F.struct("frame_number", F.col("mask_pos").alias("m"))
    found = tracks.select("track_id").distinct().join(masks, "track_id")
    return first_match(found, ["track_id"], key, fields, largest=last)


def strongest_span(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, priority: Column, eps: float = EPS, bucket: float = 256.0) -> DataFrame:
    """points, repeated ones too, with the status of the span that holds the time and has the highest priority; of equal ones the shorter, then the later. Without a span out_of_view.

    priority: an expression over a span's columns, called s_*. Spans become their skyline first, so a point meets one piece.
    """
    rank = [-priority, F.col("s_end_sec") - F.col("s_start_sec"), -F.col("s_start_sec")]
    held = stab_strongest(points, spans.select(*keys, "start_sec", "end_sec", "status"), keys, time, "start_sec", "end_sec", rank, eps, bucket)
    return held.select(*points.columns, F.coalesce("s_status", F.lit("out_of_view")).alias("status"))


def last_started(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """points with the span that started last at or before the time (`match`), null if it has ended by then."""
    rest = [c for c in spans.columns if c not in (*keys, "start_sec", "end_sec")]
    out = asof_join(points, spans, keys, time, "start_sec", order=["start_sec", "end_sec", *rest])
    ended = F.col("match")["end_sec"] < F.col(time)
    return out.withColumn("match", F.when(~F.coalesce(ended, F.lit(False)), F.col("match")))


def snap_to_sound(events: DataFrame, sounds: DataFrame, keys: Sequence[str], tolerance: float = 1.5, block: float = 64.0) -> DataFrame:
    """events(start_sec, end_sec) with the times of the sound whose middle is nearest to theirs, if that is within the tolerance; of equals the earliest.

    Sounds are looked up once for each different middle of a key's events, in blocks of time.
    """
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    heard = sounds.select(*keys, middle("start_sec", "stop_sec").alias("mid"), F.col("start_sec").alias("s"), F.col("stop_sec").alias("e"))
    heard = heard.groupBy(*keys, "mid").agg(F.min(F.struct("s", "e")).alias("_v")).select(*keys, "mid", "_v.s", "_v.e")
    events = events.withColumn("mid_sec", middle("start_sec", "end_sec"))
    asked = events.select(*keys, "mid_sec").distinct()
    met = nearest_join(asked, heard.join(asked.select(*keys).distinct(), list(keys), "left_semi"), keys, "mid_sec", "mid", tie="earlier", tolerance=tolerance, block=block).where("match is not null")
    out = events.join(met, [*keys, "mid_sec"], "left")
    near = F.col("match").isNotNull()
    return out.withColumn("start_sec", F.when(near, F.col("match")["s"]).otherwise(F.col("start_sec"))).withColumn("end_sec", F.when(near, F.col("match")["e"]).otherwise(F.col("end_sec"))).withColumn("snapped", near).drop("match", "mid_sec")


def overlapping(points: DataFrame, spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """points(start, end) with `overlaps`: whether any span of the key overlaps it, a null end being open; true for a key without spans. Repeated points come each.

    Of the spans that start by a point's end only the latest end so far matters: a running maximum, and an as-of join.
    """
    names = points.columns
    so_far = Window.partitionBy(*keys).orderBy("_s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    s = spans.select(*keys, F.col("start_sec").cast("double").alias("_s"), F.coalesce(F.col("end_sec").cast("double"), F.lit(float("inf"))).alias("_e"))
    s = s.groupBy(*keys, "_s").agg(F.max("_e").alias("_e")).withColumn("_e", F.max("_e").over(so_far))
    known = s.select(*keys).distinct().withColumn("_known", F.lit(True))
    out = asof_join(points, s, keys, end, "_s", name="_hit").join(known, list(keys), "left")
    return out.select(*names, (F.col("_known").isNull() | F.coalesce(F.col("_hit")["_e"] >= F.col(start), F.lit(False))).alias("overlaps"))


def placement_before(points: DataFrame, tracks: DataFrame, mask_times: DataFrame, keys: Sequence[str], start: str) -> DataFrame:
    """points with placement_sec: of the last track that ended by the start, the later of its end and its latest mask's time; null without such a track."""
    latest = mask_times.groupBy("track_id").agg((F.max("frame_number") / FPS).alias("mask_sec"))
    t = tracks.join(latest, "track_id", "left").select(*keys, "track_id", "end_sec", "mask_sec")
    out = asof_join(points, t, keys, start, "end_sec", order=["end_sec", "track_id"])
    return out.withColumn("placement_sec", F.greatest(F.col("match")["end_sec"], F.col("match")["mask_sec"])).withColumn("track_id", F.col("match")["track_id"]).drop("match")


def time_grid(spans: DataFrame, start: str, end: str, fps: float, name: str = "time_sec") -> DataFrame:
    """A row for each start + i / fps up to the end (1e-9 beyond counts), rounded to six places; an invalid span or rate raises."""
    if fps <= 0:
        raise ValueError("the sampling rate must be positive")
    good = F.when(F.col(end) >= F.col(start), F.floor((F.col(end) - F.col(start)) * fps + EPS)).otherwise(F.raise_error(F.lit("a span ends before it starts")).cast("long"))
    return spans.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), good))).withColumn(name, F.round(F.col(start) + F.col("_i") / fps, 6)).drop("_i")


def adaptive_times(start: Column, end: Column, fps: float) -> Column:
    """Times at which to look into a span: its middle if it is no longer than a step; start, middle and end up to four steps; else its quarters as well."""
    step, length = 1.0 / fps, end - start
    at = lambda q: F.round(start + q * length, 6)
    middle = F.round((start + end) / 2.0, 6)
    few = F.array_sort(F.array_distinct(F.array(F.round(start, 6), middle, F.round(end, 6))))
    many = F.array_sort(F.array_distinct(F.array(F.round(start, 6), at(0.25), middle, at(0.75), F.round(end, 6))))
    return F.when(length < 0, F.array().cast("array<double>")).when(length <= step, F.array(middle)).when(length <= 4 * step, few).otherwise(many)


def next_seconds(placement: Column, query: Column, clip_end: Column, count: int = 3) -> Column:
    """The next whole seconds after a placement, as far as they aren't after the query or the clip's end."""
    first = F.floor(placement) + 1
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (first + i).cast("double")), lambda t: (t <= query) & (t <= clip_end))


def frame_of(t: Column, fps: float = FPS) -> Column:
    """The frame at a time, halves to even."""
    return F.rint(t * fps).cast("long")


def time_of(frame: Column, fps: float = FPS) -> Column:
    return frame / F.lit(fps)


def thinned(frames: DataFrame, keys: Sequence[str], time: str, fps: float, order: Sequence[str] = ()) -> DataFrame:
    """The first frame of each 1 / fps seconds of its key; of frames of one time the first in `order`."""
    w = Window.partitionBy(*keys, "_slot").orderBy(time, *order)
    return frames.withColumn("_slot", F.floor(F.col(time) * fps + EPS)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_slot", "_n")
