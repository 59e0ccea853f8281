"""A table of one row a key in Parquet files by bucket: changes replace only the buckets that they touch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import checkpointed

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Where the table lies, its key column, and into how many buckets keys are dealt; the last must stay as it was when the table was written."""

    path: str
    key: str
    buckets: int = 64

    def latest(self, rows: DataFrame, order: Sequence[str]) -> DataFrame:
        """One row a key, with its bucket: of several the last in `order`. A row without a key raises."""
        key = F.when(F.col(self.key).isNotNull(), F.col(self.key)).otherwise(F.raise_error(F.lit(f"a row without {self.key}")).cast(rows.schema[self.key].dataType))
        rest = [c for c in rows.columns if c != self.key]
        one = rows.groupBy(key.alias(self.key)).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
        return one.select(self.key, *(F.col("_v")[c].alias(c) for c in rest), F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias(BUCKET))

    def write(self, rows: DataFrame, order: Sequence[str]) -> None:
        """The whole table anew: a file for each bucket."""
        self.latest(rows, order).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(BUCKET)

    def upsert(self, changes: DataFrame, order: Sequence[str]) -> int:
        """Puts the changes' rows in the place of those with their keys, or adds them; the number of buckets that were rewritten.

        Only buckets that hold a changed key are read and written. Spark writes them beside the table and moves them into place when all are there, so a job that fails changes nothing, and a reader finds a
        bucket as it was or as it is. Columns that only the table, or only the changes have, are null in the others' rows. Two writers at once must be kept apart by the caller.
        """
        spark = changes.sparkSession
        new = checkpointed(self.latest(changes, order))
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # numbers of buckets
        if not touched:
            return 0
        old = spark.read.parquet(self.path).where(F.col(BUCKET).isin(touched))
        merged = old.join(new.select(self.key), self.key, "left_anti").unionByName(new, allowMissingColumns=True)
        merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return len(touched)
