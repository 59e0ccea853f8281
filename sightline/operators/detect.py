"""Detectors as plug-ins: a registry of vectorised functions, and the logic around them as columns.

No model weights come with the library. A detector is a function from a pandas frame of regions to one of detections; the stub derives its answer from
a hash of the region and serves tests and dry runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions.names import class_prompt
from ..sources.scratch import checkpointed

Detector = Callable[[pd.DataFrame], pd.DataFrame]
BACKENDS: dict[str, Callable[[], Detector]] = {}
DETECTION = "score double, x1 int, y1 int, x2 int, y2 int"


def register(name: str):
    """Registers a factory; it runs once in each Python worker, where a model is then loaded once."""

    def add(factory: Callable[[], Detector]):
        BACKENDS[name] = factory
        return factory

    return add


def backend(name: str) -> Callable[[], Detector]:
    if name not in BACKENDS:
        raise ValueError(f"unknown detector {name!r}; there are: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]


@register("stub")
def stub() -> Detector:
    def detect(regions: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in regions.itertuples(index=False):
            h = hashlib.md5(f"{r.phrase}|{r.rx1}|{r.ry1}|{r.rx2}|{r.ry2}".encode()).digest()
            w, t = max(1, r.rx2 - r.rx1), max(1, r.ry2 - r.ry1)
            rows.append((h[0] / 255, w // 4, t // 4, w // 2, t // 2))
        return pd.DataFrame(rows, columns=["score", "x1", "y1", "x2", "y2"])

    return detect


def detections(regions: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """regions(keys, phrase, rx1..ry2) with the best detection in each, its box moved from the region to the image."""
    factory = backend(name)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in regions.schema.fields), DETECTION])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = factory()
        for batch in batches:
            yield pd.concat([batch.reset_index(drop=True), _looked_at(detect(batch), batch)], axis=1)

    return regions.mapInPandas(run, schema)


def label_of(score: Column, visible: float = 0.5, partial: float = 0.3) -> Column:
    return F.when(score.isNull(), "skipped").when(score >= visible, "visible").when(score >= partial, "partially_visible").otherwise("not_visible")


def searched(pixels: DataFrame, width: int, height: int, scale: float = 1.5) -> DataFrame:
    """pixels(pixel, last_size, expected_size, slack) with the region to search; without a pixel there is none."""
    size = G.expected_size(F.col("last_size"), F.col("expected_size"))
    r = G.region_around(F.col("pixel"), size, scale, F.col("slack"), width, height)
    return pixels.where("pixel is not null").withColumn("_r", r).select("*", *(F.col("_r")[c].alias(f"r{c}") for c in ("x1", "y1", "x2", "y2"))).drop("_r")


def confident(rows: DataFrame, least: float, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Detections of at least a threshold with their place in their key, best first."""
    return rows.where(F.col("score") >= least).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), *order)))


def prompt_of(classes: Column) -> Column:
    return class_prompt(classes)


def audited(samples: DataFrame, name: str, keys: Sequence[str], width: int, height: int, slack: float = 20.0, least: float = 0.0) -> DataFrame:
    """samples(keys, pixel, phrase) with the detector's verdict on the whole image: skipped without a pixel, detected if the box found, grown by the slack, holds the pixel, else not_detected; and the box's score if it does.

    Only samples with a pixel reach the detector.
    """
    asked = samples.where("pixel is not null").select(*keys, "pixel", "phrase", *(F.lit(v).alias(n) for n, v in (("rx1", 0), ("ry1", 0), ("rx2", width), ("ry2", height))))
    found = detections(asked, name, keys)
    u, v = F.col("pixel")["u"], F.col("pixel")["v"]
    hit = (F.col("score") >= least) & (u >= F.col("x1") - slack) & (u <= F.col("x2") + slack) & (v >= F.col("y1") - slack) & (v <= F.col("y2") + slack)
    verdicts = found.select(*keys, F.when(hit, "detected").otherwise("not_detected").alias("_verdict"), F.when(hit, F.col("score")).alias("match_score"))
    return samples.join(verdicts, list(keys), "left").withColumn("verdict", F.coalesce("_verdict", F.lit("skipped"))).drop("_verdict")


def _looked_at(found: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
    """Detections with their boxes moved from the regions to the image."""
    found = found.reset_index(drop=True)
    for c, o in (("x1", "rx1"), ("x2", "rx1"), ("y1", "ry1"), ("y2", "ry1")):
        found[c] = found[c].to_numpy() + regions[o].to_numpy()
    return found


def escalated(candidates: DataFrame, name: str, keys: Sequence[str], pool: Sequence[str], order: Sequence[str], quota: int, start: int, most: int, accept: Sequence[str] = ("visible",), visible: float = 0.5, partial: float = 0.3) -> DataFrame:
    """The candidates(keys, pool, order, phrase, rx1..ry2) that the detector was shown, each with its detection, verdict, accepted, multiplier and call (its number within the key, from 1).

    A key wants `quota` accepted candidates. Its pool is its first quota * start candidates by `pool`; while the quota isn't filled the pool doubles, up to quota * most. Of a pool the candidates that
    are new are shown in `order`, and none after the one that fills the quota.

    Each round is a job over the keys that still lack some, and what a round passes on is a row for each key: how many it lacks, and how many calls were made. Within a round a key's new candidates, at most
    quota * most / 2, are one group; the detector gets as many at once as are lacking, which it needs to see in any case.
    """
    if not 0 < start <= most:
        raise ValueError("a pool starts with a multiplier of at least 1, and at most the largest")
    factory = backend(name)
    placed = candidates.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*pool))).where(F.col("_place") <= quota * most)
    placed = checkpointed(placed)
    fields = [f for f in placed.schema.fields if f.name != "_place"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), DETECTION, "verdict string, accepted boolean, multiplier int, call long"])
    names = [f.name for f in fields]

    def shown(multiplier: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            detect = factory()
            rows = rows.sort_values(list(order), ignore_index=True)
            lacking, calls, at, out = int(rows["_lacking"].iloc[0]), int(rows["_calls"].iloc[0]), 0, []
            while lacking > 0 and at < len(rows):
                part = rows[names].iloc[at : at + lacking].reset_index(drop=True)
                found = _looked_at(detect(part), part)
                score = found["score"]
                verdict = pd.Series("not_visible", index=score.index).mask(score >= partial, "partially_visible").mask(score >= visible, "visible").mask(score.isna(), "skipped")
                accepted = verdict.isin(list(accept))
                at += len(part)
                out.append(pd.concat([part, found], axis=1).assign(verdict=verdict, accepted=accepted, multiplier=multiplier, call=range(calls + 1, calls + 1 + len(part))))
                calls += len(part)
                lacking -= int(accepted.sum())
            return pd.concat(out) if out else rows[names].iloc[:0].assign(**dict.fromkeys(["score", "x1", "y1", "x2", "y2", "verdict", "accepted", "multiplier", "call"]))

        return run

    lacking = placed.select(*keys).distinct().select(*keys, F.lit(quota).cast("long").alias("_lacking"), F.lit(0).cast("long").alias("_calls"))
    done, low, multiplier = [], 0, start
    while True:
        new = placed.where((F.col("_place") > quota * low) & (F.col("_place") <= quota * multiplier)).join(lacking.where("_lacking > 0"), list(keys))
        round_ = checkpointed(new.groupBy(*keys).applyInPandas(shown(multiplier), schema))
        done.append(round_)
        low, multiplier = multiplier, multiplier * 2
        if multiplier > most:
            break
        spent = round_.groupBy(*keys).agg(F.count_if("accepted").alias("_a"), F.count("*").alias("_n"))
        lacking = lacking.join(spent, list(keys), "left").select(*keys, (F.col("_lacking") - F.coalesce("_a", F.lit(0))).alias("_lacking"), (F.col("_calls") + F.coalesce("_n", F.lit(0))).alias("_calls"))
        lacking = checkpointed(lacking)
        if lacking.where("_lacking > 0").isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
