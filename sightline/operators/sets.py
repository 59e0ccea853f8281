"""Sets: unions of ids, ordered unions of lists, and differences between the values that rows have and those that they may have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_of(parts: Sequence[tuple[DataFrame, str]], name: str) -> DataFrame:
    """The distinct values of a column of each part, null left out; each part is made distinct first, so that no more than that is shuffled twice."""
    out = None
    for rows, column in parts:
        own = rows.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()
        out = own if out is None else out.union(own)
    return out.distinct()


def ordered_union(*lists: Column) -> Column:
    """The values of the lists, each once, where they come first; a null list counts as empty, null values are left out."""
    return F.array_distinct(F.array_compact(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))))


def domains(rows: DataFrame, keys: Sequence[str], value: str, known: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """(keys, missing, domain): of each key the known values that it lacks, and those that it has together with those that it always may have, both sorted."""
    lit = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    seen = rows.groupBy(*keys).agg(F.collect_set(value).alias("_seen"))
    return seen.select(*keys, F.sort_array(F.array_except(lit(known), F.col("_seen"))).alias("missing"), F.sort_array(F.array_union(F.col("_seen"), lit(always))).alias("domain"))
