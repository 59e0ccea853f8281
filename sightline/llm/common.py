"""Helpers shared by the training-data operators: checkpoints, checked broadcasts, components, distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import shared_root

#: A join side of at most this many narrow rows (an id, a few numbers) may be broadcast.
BROADCAST_ROWS = 1_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder in spark.checkpoint.dir and read from there.

    A folder of our own is set only where the session names none, in local mode; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of an Arrow batch that carries texts.
TEXT_BATCH = 1000


def in_text_batches(df: DataFrame) -> DataFrame:
    """df, whose texts Python workers are about to read: the session's Arrow batches get TEXT_BATCH rows at most from now on.

    With Spark's 10,000, a batch of long texts takes hundreds of MB in a worker, where it stays as long as the worker lives, and as much beside the JVM's heap.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= TEXT_BATCH:
        df.sparkSession.conf.set(key, str(TEXT_BATCH))
    return df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; beyond that Spark shuffles both sides of its join.

    For narrow rows that are already materialised, as the rows are counted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Where the rest of a user's row lies while an operator works: among columns that the operator names itself no name of the user's can clash.
REST = "_rest_of_row"


def called(names: list[str]) -> list[Column]:
    """The columns of these names, which may hold dots and quotes."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def aside(names: list[str]) -> list[Column]:
    """The columns of these names as one struct, or none."""
    return [F.struct(*called(names)).alias(REST)] if names else []


def again(names: list[str]) -> list[Column]:
    """The columns that `aside` has put together."""
    return [F.col(REST)[c].alias(c) for c in names]


def text_of(column: str | Column = "text") -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(src, dst), component being the smallest node reachable.

    Alternating large-star and small-star rounds: each is one aggregation to the smallest neighbour
    and a join back, so a hub is never gathered in one place, and the number of rounds grows with the
    logarithm of the diameter. Loops and repeated edges do no harm; an edge with a null end is ignored.
    """
    ends = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).dropna()
    nodes = ends.select(F.col("u").alias("node")).union(ends.select(F.col("v").alias("node"))).distinct()
    now = checkpointed(ends.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = checkpointed(
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def distributed_rank(df: DataFrame, group: list[str], key: str, order: list[str], rank: str, parts: int, total: str | None = None) -> DataFrame:
    """df with its rows ranked from 0 within each group by (key, order), without bringing a group into one task.

    key: a column of [0, 1) with values spread evenly, as a hash or a fractional rank has. Each
    group is cut into as many as parts ranges of the key; the ranges' counts give every range its first
    rank, and only the rows of one range are sorted together. total: a column for the group's rows.
    """
    cell = F.least(F.lit(parts - 1), F.floor(F.col(key) * parts)).cast("long")
    df = df.withColumn("_cell", cell)
    counts = df.groupBy(*group, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        cells = cells.withColumn(total, F.sum("_n").over(Window.partitionBy(*group)))
    cells = cells.drop("_n")
    on = F.col("_cell") == F.col("_cell_r")
    for g in group:
        cells = cells.withColumnRenamed(g, f"_{g}_r")
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}_r"))
    joined = df.join(cells.withColumnRenamed("_cell", "_cell_r"), on).drop("_cell_r", *(f"_{g}_r" for g in group))
    within = Window.partitionBy(*group, "_cell").orderBy(key, *order)
    return joined.withColumn(rank, F.col("_first") + F.row_number().over(within) - 1).drop("_cell", "_first")


def unit_hash(*columns: str | Column, seed: int = 0) -> Column:
    """A seeded hash of the columns in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) * F.lit(2.0**-53)


def parts_for(rows: int, per_part: int = 4096) -> int:
    return max(1, -(-rows // per_part))


def id_columns(name: str = "doc_id") -> list[Column]:
    """The id with 0 for null, and whether it is null: pandas would turn a batch of ids with a null into floats, which large ids don't survive."""
    return [F.coalesce(F.col(name).cast("long"), F.lit(0)).alias("doc_id"), F.col(name).isNull().alias("_no_id")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

