"""Question records: candidates, steps and trajectories over merged samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import names as N
from ..functions.digests import least_others
from ..functions.statuses import covers_hidden_window, is_visible, priority
from ..sources.scratch import checkpointed
from .islands import collapse_runs, last_true_index
from .rank import capped_with_ids, closest_sample, keep_first, location_first, numbered, round_robin
from .temporal import EPS, asof_join, stab_join, strongest_span

OBJECT = ("video_id", "assoc_id")
#: Objects that meet in one row, about: those that ask for an anchor, those that it is chosen from; and times of either that a row holds.
ASKED, ANCHORS, TIMES = 4096, 32768, 2**20
#: Pairs of objects that a task hashes, about, where there are more rows than shuffle partitions.
PAIRS = 2**24


def held_samples(samples: DataFrame, spans: DataFrame, start: str) -> DataFrame:
    """Each span of an object with its samples from the start to end_sec; they meet in time buckets."""
    held = stab_join(samples, spans, OBJECT, "time_sec", start, "end_sec", bucket=32.0)
    return held.withColumnsRenamed({f"s_{c}": c for c in spans.columns if c not in OBJECT})


def hidden_candidates(spans: DataFrame, samples: DataFrame, tracks: DataFrame, videos: DataFrame, h: float, step: float) -> DataFrame:
    """Times at which an object has been out of sight for h seconds and stays so for h more.

    spans(visible, start_sec, end_sec) of an object; a hidden span of at least h counts from its start or from the end of the last track before it,
    whichever is later; the query is the hidden sample closest to h after that. The original span must cover the window around the query, a
    stable sighting must come before it, and a time is kept once to a thousandth of a second.
    """
    hidden = spans.where(~F.col("visible") & (F.col("end_sec") - F.col("start_sec") >= h)).select(*OBJECT, "start_sec", "end_sec")
    placed = asof_join(hidden, tracks.select(*OBJECT, F.col("end_sec").alias("track_end")), OBJECT, "start_sec", "track_end", name="_t")
    usable = placed.withColumn("usable_sec", F.greatest("start_sec", F.col("_t")["track_end"])).drop("_t").where(F.col("end_sec") - F.col("usable_sec") >= h)
    hit = held_samples(samples.where(~F.col("visible")).select(*OBJECT, "time_sec", "i"), usable, "usable_sec")
    ids = [*OBJECT, "start_sec", "end_sec", "usable_sec"]
    query = closest_sample(hit, ids, "time_sec", F.col("usable_sec") + h, ["time_sec", "i"]).withColumnRenamed("time_sec", "query_sec")
    ok = query.join(videos, "video_id").where(covers_hidden_window(F.col("start_sec"), F.col("end_sec"), F.col("query_sec"), h, F.col("video_end"), step))
    seen = asof_join(ok, samples.where("stable").select(*OBJECT, F.col("time_sec").alias("seen_sec")), OBJECT, "query_sec", "seen_sec", strict=True, name="_s")
    seen = seen.withColumn("last_stable_sec", F.col("_s")["seen_sec"]).drop("_s", "video_end").where("last_stable_sec is not null")
    return keep_first(seen, [*(F.col(k) for k in OBJECT), F.round("query_sec", 3)], ["query_sec", "start_sec"])


def visible_candidates(spans: DataFrame, samples: DataFrame, limit: int) -> DataFrame:
    """Of each visible span the stable sample closest to its middle; new places of an object first, objects in turns, up to the limit of a video."""
    seen = spans.where("visible").select(*OBJECT, "start_sec", "end_sec")
    hit = held_samples(samples.where("stable").select(*OBJECT, "time_sec", "i", "fixture"), seen, "start_sec")
    middle = (F.col("start_sec") + F.col("end_sec")) / 2
    picked = closest_sample(hit, [*OBJECT, "start_sec", "end_sec"], "time_sec", middle, ["time_sec", "i", "fixture"])
    ordered = location_first(picked, OBJECT, "fixture", "time_sec")
    return round_robin(ordered, ["video_id"], "assoc_id", ["place_order"], limit)


def with_anchor(candidates: DataFrame, states: DataFrame, seed: int | str) -> DataFrame:
    """candidates with a seeded choice among the other objects that are visible, placed and at rest at the query time; those without one are dropped.

    states(video_id, query_sec, anchor_id, ...) has the eligible objects. Blocks of a video's objects meet blocks of its eligible ones in one row, each object with all its times, so a pair has one hash at
    however many times it meets, and hashes are made many at a time (`digests`). Their number remains objects x eligible ones of a video, or the pairs of its times where those are fewer.
    """
    who, spark = ["video_id", "assoc_id", "query_sec"], candidates.sparkSession
    timed = lambda rows, key: checkpointed(rows.where(F.col(key).isNotNull()).groupBy("video_id", F.col(key).alias("id")).agg(F.collect_set("query_sec").alias("times")))
    asked, offered = timed(candidates, "assoc_id"), timed(states, "anchor_id")
    sized = lambda rows, n, most, name: rows.groupBy("video_id").agg(F.count("*").alias(n), F.ceil(F.greatest(F.count("*") / F.lit(most), F.sum(F.size("times")) / F.lit(TIMES), F.lit(1.0))).alias(name))
    sizes = sized(asked, "_n", ASKED, "_rows").join(sized(offered, "_m", ANCHORS, "_columns"), "video_id")
    before = Window.orderBy("video_id").rowsBetween(Window.unboundedPreceding, -1)  # a row for each video
    sizes = checkpointed(sizes.withColumn("_first", F.coalesce(F.sum(F.col("_rows") * F.col("_columns")).over(before), F.lit(0))))
    units, pairs = sizes.agg(F.sum(F.col("_rows") * F.col("_columns")), F.sum(F.col("_n").cast("double") * F.col("_m"))).first()
    parts = max(1, min(units or 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((pairs or 0) // PAIRS))))

    def blocks(rows: DataFrame, own: str, other: str, place: Column, name: str) -> DataFrame:
        """Rows (_unit, objects), each block as often as it meets one of the other side; by id, so that of equal hashes the first object counts."""
        listed = rows.join(sizes, "video_id").groupBy("video_id", "_first", "_rows", "_columns", F.pmod(F.xxhash64("id"), F.col(own)).alias("_own")).agg(F.sort_array(F.collect_list(F.struct("id", F.col("id").cast("string").alias("text"), "times"))).alias(name))
        return listed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select((F.col("_first") + place).alias("_unit"), "video_id", name)

    met = blocks(asked, "_rows", "_columns", F.col("_own") * F.col("_columns") + F.col("_other"), "_asked")
    met = met.join(blocks(offered, "_columns", "_rows", F.col("_other") * F.col("_columns") + F.col("_own"), "_offered").drop("video_id"), "_unit")
    fields = [candidates.schema[c] for c in who] + [states.schema["anchor_id"]]
    schema = StructType([*(StructField(f.name, f.dataType) for f in fields), StructField("_h", LongType()), StructField("_l", LongType())])
    chosen = met.repartitionById(parts, F.pmod("_unit", F.lit(parts)).cast("int")).mapInArrow(chosen_anchors(seed), schema)
    best = chosen.groupBy(*who).agg(F.min(F.struct("_h", "_l", "anchor_id")).alias("_a"))
    return candidates.join(best.select(*who, F.col("_a.anchor_id").alias("anchor_id")), who)


def chosen_anchors(seed: int | str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of blocks that meet, to (video_id, assoc_id, query_sec, anchor_id) with the hash in two numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch.column(c)[row].values for c in ("_asked", "_offered")]
                texts = [[t.encode() for t in s.field("text").to_pylist()] for s in sides]
                times = [s.field("times") for s in sides]
                asked, offered = ((x, t.offsets.to_numpy() - t.offsets[0].as_py(), t.flatten().to_numpy(zero_copy_only=False)) for x, t in zip(texts, times))
                place = {x: i for i, x in enumerate(texts[1])}
                own = np.array([place.get(x, -1) for x in texts[0]])
                who, time, other, high, low = least_others(([f"{seed}|".encode() + x + b"|" for x in texts[0]], *asked[1:]), offered, own)
                signed = lambda x: pa.array((x ^ np.uint64(2**63)).view(np.int64))
                video = batch.column("video_id").take(pa.array(np.full(len(who), row)))
                ids = [s.field("id").take(pa.array(x)) for s, x in zip(sides, (who, other))]
                yield pa.RecordBatch.from_arrays([video, ids[0], pa.array(time), ids[1], signed(high), signed(low)], names=["video_id", "assoc_id", "query_sec", "anchor_id", "_h", "_l"])

    return run


def first_with_anchor(candidates: DataFrame, objects: DataFrame, places: DataFrame, seed: int | str, order: Sequence[str], cap: int) -> DataFrame:
    """The first cap candidates of each video, in order, whose anchor has a place, with that; at least those, and some that come later.

    objects(video_id, anchor_id) are eligible at all times, places(anchor_id, ...). A video's pool is its first 2 * cap candidates and grows fourfold while it has found fewer than cap; so anchors are
    chosen for few candidates, however many there are.
    """
    candidates, objects = checkpointed(candidates), checkpointed(objects.distinct())
    most = candidates.groupBy("video_id").count().agg(F.max("count")).first()[0] or 0
    out, open_, low, high = None, None, 0, 2 * cap
    while True:
        pool = numbered(candidates, ["video_id"], order, "_place").where(F.col("_place") <= high).where(F.col("_place") > low).drop("_place")
        pool = checkpointed(pool if open_ is None else pool.join(open_, "video_id", "left_semi"))
        found = checkpointed(with_anchor(pool, pool.select("video_id", "query_sec").distinct().join(objects, "video_id"), seed).join(places, "anchor_id"))
        out = found if out is None else out.unionByName(found)
        if high >= most:
            return out
        filled = out.groupBy("video_id").count().where(F.col("count") >= cap)
        open_ = checkpointed(candidates.select("video_id").distinct().join(filled, "video_id", "left_anti"))
        if open_.isEmpty():
            return out
        low, high = high, 4 * high


def step_struct(step: Column | str, kind: str, question: Column, answer: Column, choices: Column | None = None, index: Column | None = None) -> Column:
    """A step of a trajectory; step numbers are text."""
    s = F.lit(step) if isinstance(step, str) else step
    return F.struct(
        s.alias("step"), F.lit(kind).alias("question_class"), question.alias("question"), answer.alias("answer"),
        (choices if choices is not None else F.array().cast("array<string>")).alias("choices"), (index if index is not None else F.lit(None)).cast("int").alias("correct_idx"),
    )


def visibility_step(name: Column, t: Column, visible: Column, key: Column, seed: int | str) -> Column:
    """Is the object visible at the time: Yes or No in a seeded order."""
    choices = N.shuffled(F.array(F.lit("Yes"), F.lit("No")), seed, key)
    answer = F.when(visible, "Yes").otherwise("No")
    return step_struct("1", "visibility", F.concat(F.lit("Is "), name, F.lit(" visible at "), N.time_token(t), F.lit("?")), answer, choices, N.answer_index(choices, answer))


def last_seen_step(name: Column, t: Column, seen: Column, u: Column, v: Column) -> Column:
    """When and where, as a point of the image, the object was last seen."""
    answer = F.concat(N.time_token(seen), F.lit(" ("), N.short_number(u), F.lit(", "), N.short_number(v), F.lit(")"))
    return step_struct("2", "last_visible", F.concat(F.lit("When was "), name, F.lit(" last visible before "), N.time_token(t), F.lit("?")), answer)


def stopped_step(name: Column, t: Column, placement: Column) -> Column:
    return step_struct("3", "stopped_moving", F.concat(F.lit("When did "), name, F.lit(" stop moving before "), N.time_token(t), F.lit("?")), N.time_token(placement))


def fixture_step(name: Column, label: Column, vocabulary: Column, key: Column, seed: int | str, count: int = 5) -> Column:
    """Which fixture the object is nearest to, with count choices; null without a valid label or enough of them."""
    choices = N.with_distractors(label, vocabulary, count, seed, key)
    step = step_struct("4", "nearest_fixture", F.concat(F.lit("What is "), name, F.lit(" closest to?")), label, choices, N.answer_index(choices, label))
    return F.when(N.valid_fixture(label) & choices.isNotNull(), step)


def quadrant_step(name: Column, place: Column) -> Column:
    label = G.quadrant(place)
    choices = F.array(*(F.lit(x) for x in ("Front-left", "Front-right", "Back-left", "Back-right")))
    return F.when(label.isNotNull(), step_struct("5a", "quadrant", F.concat(F.lit("In which direction is "), name, F.lit("?")), label, choices, N.answer_index(choices, label)))


def relation_step(name: Column, anchor: Column, relative: Column) -> Column:
    label = G.quadrant(relative)
    choices = F.array(*(F.lit(x) for x in ("Front-left", "Front-right", "Back-left", "Back-right")))
    return F.when(label.isNotNull(), step_struct("5b", "relation", F.concat(F.lit("Where is "), name, F.lit(" from "), anchor, F.lit("?")), label, choices, N.answer_index(choices, label)))


def distance_step(name: Column, anchor: Column, d: Column) -> Column:
    label = G.distance_bucket(d)
    choices = F.array(F.lit("close"), F.lit("medium"), F.lit("far"))
    return F.when(label.isNotNull(), step_struct("5c", "distance", F.concat(F.lit("How far is "), name, F.lit(" from "), anchor, F.lit("?")), label, choices, N.answer_index(choices, label)))


def area_step(name: Column, area: Column, vocabulary: Column, key: Column, seed: int | str, count: int = 4) -> Column:
    choices = N.with_distractors(area, vocabulary, count, seed, key)
    return F.when(area.isNotNull() & choices.isNotNull(), step_struct("5d", "counter_area", F.concat(F.lit("Which part of the counter is "), name, F.lit(" on?")), area, choices, N.answer_index(choices, area)))


def drop_reason(has_state: Column, visible: Column, last_visible: Column, in_motion: Column, fixture_ok: Column, placement: Column, quadrant: Column, anchor: Column, branches_ok: Column) -> Column:
    """Why a candidate gives no trajectory, by the first check that fails; a visible object gives a record of one step."""
    return (
        F.when(~has_state, "no_state").when(visible, "one_step").when(last_visible.isNull(), "never_visible").when(in_motion, "in_motion").when(~fixture_ok, "invalid_fixture")
        .when(placement.isNull(), "no_placement").when(last_visible < placement - EPS, "seen_before_placement").when(quadrant.isNull(), "ambiguous_direction")
        .when(anchor.isNull(), "no_anchor").when(~branches_ok, "branch_failed").otherwise("kept")
    )


def trajectories(rows: DataFrame, order: Sequence[str], steps: Sequence[str], branches: Sequence[str], cap: int) -> DataFrame:
    """At most cap records of a video with a running id: incremental_steps in order, and branch_groups with the branches that exist."""
    kept = capped_with_ids(rows, ["video_id"], order, cap, "trajectory_id")
    return kept.withColumn("incremental_steps", F.array_compact(F.array(*steps))).withColumn("branch_groups", F.create_map(F.lit("post_step4"), F.array_compact(F.array(*branches)))).drop(*steps, *branches)


def detector_gate(rows: DataFrame, keys: Sequence[str], order: Sequence[str], passed: Column, count: int) -> DataFrame:
    """The first count rows of each key, in order, whose verdict passes; verdicts are a column, so all rows have been looked at. detect.escalated stops early instead."""
    return rows.where(passed).withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= count).drop("_rn")


def exploded_steps(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each step."""
    return records.select(*keys, F.explode("incremental_steps").alias("s")).select(*keys, "s.*")


def still_hidden(candidates: DataFrame, states: DataFrame) -> DataFrame:
    """Candidates whose object, looked at again at the query time, isn't ok and in view; one without a state then is dropped.

    states(video_id, assoc_id, query_sec, raw_status, in_view).
    """
    seen = (F.col("raw_status") == "ok") & F.coalesce("in_view", F.lit(False))
    each = states.groupBy(*OBJECT, "query_sec").agg(F.max(F.coalesce(seen, F.lit(False))).alias("_seen")).where("not _seen").drop("_seen")
    return candidates.join(each, [*OBJECT, "query_sec"], "left_semi")


def candidate_key(video: Column, obj: Column, t: Column) -> Column:
    """What a candidate is told by: its video, object, and time to a millionth of a second."""
    return F.format_string("%s:%s:%.6f", video, obj.cast("string"), t)


def visible_records(candidates: DataFrame, name: Column, time: str, order: Sequence[str], cap: int, seed: int | str) -> DataFrame:
    """Records of one step each for objects that are visible at their time: the answer is Yes, choices stand in a seeded order. At most cap a video, with a running id; candidates with one key count once."""
    keyed = candidates.withColumn("key", candidate_key(F.col("video_id"), F.col("assoc_id"), F.col(time)))
    once = keep_first(keyed, [F.col("key")], order)
    numbered = capped_with_ids(once, ["video_id"], order, cap, "trajectory_id")
    step = visibility_step(name, F.col(time), F.lit(True), F.col("key"), seed)
    return numbered.withColumn("incremental_steps", F.array(step)).withColumn("stop_reason", F.lit("object_visible_at_query_time"))


def absolute_answers(rows: DataFrame, raw_fixture: str, vocabulary: DataFrame, label: str, key: Column, count: int, seed: int | str) -> DataFrame:
    """rows with the label of their fixture, count choices from the vocabulary's labels, and the answer's index; a row without a valid label, or a vocabulary too small, is dropped.

    vocabulary(label): distinct labels, a configuration's few.
    """
    words = vocabulary.where(N.valid_fixture(F.col(label))).agg(F.sort_array(F.collect_set(label)).alias("_words"))
    out = rows.withColumn("answer", N.fixture_label(F.col(raw_fixture))).where(N.valid_fixture(F.col("answer"))).crossJoin(F.broadcast(words))
    out = out.withColumn("choices", N.with_distractors(F.col("answer"), F.col("_words"), count, seed, key)).drop("_words").where("choices is not null")
    return out.withColumn("correct_idx", N.answer_index(F.col("choices"), F.col("answer")))


def flat_questions(candidates: DataFrame, horizon: float, families: dict[str, tuple[Column, Column]], order: Sequence[str]) -> DataFrame:
    """A row for each question of each candidate, with an id that counts through a family: families by name, each with whether the candidate has it and its answer.

    Families come in turn; one that is wanted but can't be answered (has it, answer null, after the first) ends the candidate's later ones. Ids run over videos in order and the candidates' order.
    """
    entries, blocked = [], F.lit(False)
    for n, (name, (wanted, answer)) in enumerate(families.items()):
        entries.append(F.when(wanted & ~blocked & answer.isNotNull(), F.struct(F.lit(name).alias("question_class"), answer.cast("string").alias("answer"))))
        if n:
            blocked = blocked | (wanted & answer.isNull())
    each = candidates.withColumn("_q", F.explode(F.array_compact(F.array(*entries)))).select(*candidates.columns, "_q.*")
    counted = capped_with_ids(each, ["question_class", "video_id"], order, 2**31 - 1, "_number")
    first = counted.groupBy("question_class").agg(F.min("_number").alias("_least"))
    token = N.horizon_token(F.lit(float(horizon)))
    return counted.join(first, "question_class").withColumn("question_id", F.concat_ws("_", "question_class", token, (F.col("_number") - F.col("_least")).cast("string"))).drop("_number", "_least")


def clip_window(candidates: DataFrame, video_starts: DataFrame, earlier: float, from_video_start: bool = False) -> DataFrame:
    """candidates(clip_start_sec, query_sec) with an earlier clip start and the query's time in the clip; one whose clip would start before its video is dropped."""
    out = candidates.join(video_starts.select("video_id", F.col("start_sec").alias("_first")), "video_id")
    start = F.col("_first") if from_video_start else F.col("clip_start_sec") - earlier
    return out.withColumn("clip_start_sec", start).where(F.col("clip_start_sec") >= F.col("_first") - EPS).drop("_first").withColumn("query_in_clip_sec", F.col("query_sec") - F.col("clip_start_sec"))


def video_windows(samples: DataFrame) -> DataFrame:
    """(video_id, start_sec, end_sec, n_samples) from the samples of each video's first object; all objects of a video are sampled at the same times."""
    each = samples.groupBy(*OBJECT).agg(F.min("time_sec").alias("start_sec"), F.max("time_sec").alias("end_sec"), F.count("*").alias("n_samples"))
    return each.groupBy("video_id").agg(F.min_by(F.struct("start_sec", "end_sec", "n_samples"), "assoc_id").alias("_w")).select("video_id", "_w.*")


def precomputed_tracks(samples: DataFrame, spans: DataFrame, order: Sequence[str], keys: Sequence[str] = OBJECT) -> DataFrame:
    """(keys, samples, visible_spans, window) for each object: what question generation needs of a video, made once.

    samples(keys, time_sec, ...) are overlaid with spans(keys or some of them, start_sec, end_sec, status): of the spans that hold a sample the strongest gives its status, none means out of view. samples: its times with
    status, visible and the index of the last visible one so far, in the order of time and `order`; visible_spans: the runs of visible samples; window: the first and last time and the number of samples of the video,
    by its first object, as all objects of a video are sampled at the same times.
    """
    by = [k for k in keys if k in spans.columns]
    held = strongest_span(samples.select(*keys, "time_sec", *order), spans, by, "time_sec", priority(F.col("s_status")))
    flagged = held.withColumn("visible", is_visible(F.col("status"))).withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy("time_sec", *order)) - 1)
    flagged = last_true_index(flagged, keys, ["time_sec", *order], "index", F.col("visible"), "last_visible_index")
    runs = collapse_runs(flagged, keys, ["time_sec", *order], "time_sec", "visible").where("visible")
    runs = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_sec", "end_sec", "n_samples"))).alias("visible_spans"))
    each = flagged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("index", "time_sec", "status", "visible", "last_visible_index"))).alias("samples"))
    windows = video_windows(samples).select("video_id", F.struct("start_sec", "end_sec", "n_samples").alias("window"))
    none = F.array().cast(runs.schema["visible_spans"].dataType)
    return each.join(runs, list(keys), "left").join(windows, "video_id").select(*keys, "samples", F.coalesce("visible_spans", none).alias("visible_spans"), "window")
