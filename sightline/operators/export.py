"""Trajectories as rows for evaluation: flattened steps, histories, dependencies, exclusions and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import answer_text


def all_steps(incremental: Column, branches: Column) -> Column:
    """The incremental steps, then the branches by their step's text."""
    return F.concat(incremental, F.array_sort(branches, lambda a, b: F.when(a["step"] < b["step"], -1).when(a["step"] > b["step"], 1).otherwise(0)))


def single_turns(records: DataFrame, id_column: str, steps: str) -> DataFrame:
    """A row for each step with the id trajectory__step_x and its place."""
    out = records.select(id_column, F.posexplode(steps).alias("position", "s"))
    return out.select(F.concat(F.col(id_column).cast("string"), F.lit("__step_"), F.col("s.step")).alias("question_id"), id_column, "position", "s.*")


def step_dependencies(steps: DataFrame, key: str, order: str) -> DataFrame:
    """steps with depends_on: the ids of all incremental steps before it; a branch depends on all incremental ones."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.collect_list(F.when(~F.col("is_branch"), F.col("step"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    every = F.collect_list(F.when(~F.col("is_branch"), F.struct(F.col(order).alias("o"), F.col("step").alias("s")))).over(Window.partitionBy(key))
    return steps.withColumn("depends_on", F.when(F.col("is_branch"), F.transform(F.array_sort(every), lambda x: x["s"])).otherwise(before))


def gold_history(steps: Column) -> Column:
    """All but the last of an array of steps as messages of user and assistant."""
    head = F.slice(steps, 1, F.greatest(F.lit(0), F.size(steps) - 1))
    text = lambda s: answer_text(s["choices"], s["correct_idx"], s["answer"])
    return F.flatten(F.transform(head, lambda s: F.array(F.struct(F.lit("user").alias("role"), s["question"].alias("content")), F.struct(F.lit("assistant").alias("role"), text(s).alias("content")))))


def multi_turns(records: DataFrame, id_column: str, steps: str) -> DataFrame:
    return records.select(id_column, F.col(steps).alias("steps"), gold_history(F.col(steps)).alias("gold_history_messages"))


def without_failed(steps: DataFrame, key: str, failed: Column, ignored: Column) -> DataFrame:
    """The steps of trajectories none of whose steps, but the ignored ones, is skipped or has failed."""
    return steps.join(steps.where(failed & ~ignored).select(key).distinct(), key, "left_anti")


def export_counts(steps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return steps.groupBy(*keys).agg(
        F.count("*").alias("n_total"), F.count_if(F.col("is_mcq")).cast("long").alias("n_mcq"), F.count_if(~F.col("is_mcq")).cast("long").alias("n_open"), F.count_if(F.col("skipped")).cast("long").alias("n_skipped")
    )


def with_field_if_absent(steps: Column, field: str, value) -> Column:
    """An array of structs with a field set where it is null."""
    return F.transform(steps, lambda s: s.withField(field, F.coalesce(s[field], value(s))))


def upgraded(item: Column, defaults: dict[str, Column]) -> Column:
    """A struct of an older version with the fields that it lacks."""
    for name, value in defaults.items():
        item = item.withField(name, value)
    return item


def merged_scores(items: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """items with the latest score of each; untouched where there is none. scores(key, score, scored_at)."""
    latest = scores.groupBy(key).agg(F.max_by("score", F.struct("scored_at", "score")).alias("_new"))
    return items.join(latest, key, "left").withColumn("score", F.coalesce("_new", "score")).drop("_new")


def missing_statuses(pool: DataFrame, manifest: DataFrame, status: str) -> DataFrame:
    """The pool's rows of statuses that the manifest has none of."""
    return pool.join(manifest.select(status).distinct(), status, "left_anti")


def first_unscored(items: DataFrame, scores: DataFrame, key: str, index: str) -> DataFrame:
    return items.join(scores.select(key).distinct(), key, "left_anti").agg(F.min(index).alias(index))
