"""Running values over keys of any length: rows are sorted in ranges over many tasks, and ranges pass on a few rows each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import checkpointed
from .temporal import rejoin

#: Rows of a chunk at most, and the share of an average below which what came before doesn't count in double precision.
CHUNK, NEGLIGIBLE = 256, 1e-20


def positions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with their number from 0 in their key; of rows that are equal in the order any may come first.

    All rows are sorted in ranges of keys and order, so a key with most of the rows lies in many tasks. A key's first place and count in each range give where
    it goes on in the next one.
    """
    by = [*keys, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = checkpointed(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    pieces = ranged.groupBy(*keys, "_range").agg(F.min("_at").alias("_low"), F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(*keys, "_range", (F.col("_low") - F.coalesce(before, F.lit(0))).alias("_zero"))
    return rejoin(ranged, pieces, [*keys, "_range"], "inner").withColumn(name, F.col("_at") - F.col("_zero")).drop("_range", "_at", "_zero")


def exponential_average(samples: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float, name: str) -> DataFrame:
    """samples with the average alpha * x + (1 - alpha) * previous, the first value being itself; a null value gives null and counts for nothing.

    Each sample is an affine map of the average before it, and maps compose: a chunk of samples is summed up by one number, its average from zero, since all
    chunks but a key's last are equally long. A chunk's start is folded from the chunks before it, as far back as doubles can tell; there are few, however
    long the key is. Within a chunk the values come from one running sum.
    """
    rest = 1.0 - alpha
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be over 0 and at most 1")
    x = F.col(value).cast("double")
    if rest == 0:
        return samples.withColumn(name, x)
    decay = -math.log(rest)
    length = max(1, min(CHUNK, int(230 / decay)))  # powers of 1 / rest within a chunk stay below 1e100
    reach = max(1, math.ceil(-math.log(NEGLIGIBLE) / (decay * length)))
    place = positions(samples.where(x.isNotNull()), keys, order, "_pos")
    place = place.withColumn("_chunk", F.expr(f"_pos div {length}")).withColumn("_j", (F.col("_pos") % length).cast("int"))
    share = F.when(F.col("_pos") == 0, x).otherwise(alpha * x)
    sums = place.groupBy(*keys, "_chunk").agg(F.sum(share * F.pow(F.lit(rest), F.lit(length - 1) - F.col("_j"))).alias("_sum"))
    earlier = F.collect_list("_sum").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-reach, -1))
    start = sums.select(*keys, "_chunk", F.aggregate(earlier, F.lit(0.0), lambda a, s: a * rest**length + s).alias("_start"))
    so_far = F.sum(share * F.pow(F.lit(rest), -F.col("_j"))).over(Window.partitionBy(*keys, "_chunk").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0))
    local = rejoin(place.withColumn("_local", so_far * F.pow(F.lit(rest), F.col("_j"))), start, [*keys, "_chunk"], "inner")
    out = local.withColumn(name, F.col("_local") + F.col("_start") * F.pow(F.lit(rest), F.col("_j") + 1)).select(*samples.columns, name)
    return out.unionByName(samples.where(x.isNull()).withColumn(name, F.lit(None).cast("double")))
