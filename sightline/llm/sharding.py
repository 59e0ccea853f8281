"""Sharding by proportional stratified interleaving, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import again, aside, distributed_rank, parts_for, table, text_of, unit_hash


def interleave_shards(rows: DataFrame, shards: int, stratum: str = "source", key: tuple[str, ...] = ("doc_id",), seed: int = 0) -> DataFrame:
    """rows with shard and slot, so that every shard has the mixture of strata that all rows have.

    Rows are shuffled by a seeded hash and ranked within their stratum; (rank + 1/2) / rows of the
    stratum is a row's fractional rank, all rows are ordered by it, and the order is cut into shards
    whose counts differ by one at most. slot counts from 0 within a shard, without gaps.

    Both rankings go over ranges of the hash and of the fractional rank, so a stratum that holds a
    third of all rows is split over many tasks. A null stratum is a stratum of its own; repeated
    rows each get a place; of rows with equal hashes those with the smaller key come first, of rows with equal keys any. Texts are
    moved with their rows, whatever their length, so leave out those that aren't needed. Columns named shard and slot are replaced, others stay, whatever their names; with no
    rows the result is empty.
    """
    parts = parts_for(rows.count())
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    names = [f"key{i}" for i, _ in enumerate(dict.fromkeys(key))]
    rows = rows.select(F.col(stratum).alias("stratum"), *(F.col(k).alias(n) for k, n in zip(dict.fromkeys(key), names, strict=True)), *aside(kept))
    stratum = "stratum"
    shuffled = rows.withColumn("_u", unit_hash(*names, seed=seed))
    ranked = distributed_rank(shuffled, [stratum], "_u", names, "_rank", parts, total="_rows")
    spread = ranked.withColumn("_f", (F.col("_rank") + 0.5) / F.col("_rows")).drop("_rank", "_rows").withColumn("_all", F.lit(0))
    placed = distributed_rank(spread, ["_all"], "_f", [stratum, *names], "_place", parts, total="_total")
    # Shard s holds the places from ceil(s * total / shards).
    return (
        placed.withColumn("shard", F.expr(f"cast(_place * {shards} div _total as int)"))
        .withColumn("slot", F.expr(f"_place - (cast(shard as bigint) * _total + {shards} - 1) div {shards}"))
        .select(*again(kept), "shard", "slot")
    )


SHARDS = 24


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law `rows`: counts at most one apart.

    A null text has no bytes and the checksum of an empty one. Texts are measured in the scan and
    never shuffled. Equal texts are rows like any others here: kept together, a group of copies
    could not keep the counts within one.
    """
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", "source",
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"),
    )
    return interleave_shards(sized, SHARDS, key=("doc_id", "text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
