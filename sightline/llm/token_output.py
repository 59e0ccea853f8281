"""Token ids in raw files, and a minimal perfect hash index from document keys to places in them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import shared_folder
from .common import checkpointed, id_columns, in_text_batches, small, table, text_of
from .ngram_join import mixed
from .packing import byte_encoder

#: Bytes of text of a shard, to each of which a row adds ROW_BYTES; keys of a part of the index.
SHARD_BYTES, ROW_BYTES, PART_KEYS = 1 << 24, 64, 8192
#: Keys that share a displacement, on average; displacements that are tried at once.
BUCKET, TRIED = 3, 64
#: A row of a shard's key file: id, number of ids, whether there is an id; the line's end follows.
RECORD = np.dtype([("doc_id", "<i8"), ("n", "<i8"), ("known", "u1"), ("end", "u1")])
ENTRY = "part int, n long, shift binary, print binary, shard binary, at binary, length binary"
KEY = ["known", "doc_id", "copy"]


def shard_starts(docs: DataFrame, shard_bytes: int, text: str) -> list[tuple[bool, int]]:
    """The key (whether there is an id, and the id) at which each shard but the first starts; shards hold as many bytes of text, near enough.

    Ids and lengths alone are sorted, in ranges, and summed up: first within a range, then over ranges. One tuple for each shard comes to the driver; an id whose rows fill several shards comes several times.
    """
    rows = docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), (F.octet_length(text_of(text)).cast("long") + ROW_BYTES).alias("size"))
    ranged = rows.repartitionByRange("known", "doc_id").sortWithinPartitions("known", "doc_id")
    ranged = checkpointed(ranged.select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("at")))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = ranged.groupBy("block").agg(F.sum("size").alias("all")).select("block", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    so_far = F.sum("size").over(Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("to", so_far).join(F.broadcast(blocks), "block").withColumn("shard", F.expr(f"(before + to - size) div {shard_bytes}"))
    starts = placed.groupBy("shard").agg(F.min(F.struct("known", "doc_id")).alias("key")).orderBy("shard").collect()
    return [(r["key"]["known"], r["key"]["doc_id"]) for r in starts[1:]]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, width: int = 2, shard_bytes: int = SHARD_BYTES, text: str = "text") -> None:
    """Writes the ids of docs(doc_id, text) to files in the folder, and their index.

    kind=0/shard=s: one file of ids, unsigned and little-endian, `width` bytes each, nothing between them: the documents in ascending order of doc_id, null first, each followed by
    end_id. kind=1/shard=s: their keys and numbers of ids. manifest: the number of ids before each shard. index: a minimal perfect hash of the keys.

    Each text is encoded once, where it is read; shards' first keys are known by then, so ids go straight to their shard's task, which sorts and writes them. Spark's
    writer puts a line's end after each row, which here is the highest byte of the end id; nothing else is added. A null text is empty, rows that share a doc_id stand
    together in a fixed order of no meaning, and no shard grows by them: such rows are dealt over as many shards as they fill. Other columns are left out.
    """
    last = end_id >> 8 * (width - 1)
    if not 0 <= last < 128:
        raise ValueError("the highest byte of the end id must be ASCII; write wider ids")
    starts = shard_starts(docs, shard_bytes, text)
    known, ids = np.array([k for k, _ in starts], bool), np.array([i for _, i in starts], np.int64)
    nulls = int((~known).sum())  # of shards that start within the rows without an id
    ids = ids[nulls:]

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = byte_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc, none, u = b["doc_id"].to_numpy(), b["_no_id"].to_numpy(), b["_u"].to_numpy()
            low, high = np.searchsorted(ids, doc, "left") + nulls, np.searchsorted(ids, doc, "right") + nulls
            low, high = np.where(none, -1, low), np.where(none, nulls, high)
            shard = np.where(high > low, low + 1 + np.floor(u * (high - low)).astype(np.int64), low)
            numbers = [np.frombuffer(encoder.encode(t) + end, "<u4") for t in b["_text"]]
            if width < 4 and any(int(x.max()) >> 8 * width for x in numbers):
                raise ValueError(f"an id needs more than {width} bytes")
            record = np.zeros(len(b), RECORD)
            record["doc_id"], record["n"], record["known"] = doc, [len(x) for x in numbers], ~none
            # Without the byte that the writer adds.
            yield pd.DataFrame({"shard": shard, "known": ~none, "doc_id": doc, "_h": b["_h"], "ids": [x.astype(f"<u{width}").tobytes()[:-1] for x in numbers], "key": [x.tobytes()[:-1] for x in record]})

    texts = in_text_batches(docs).select(*id_columns(), text_of(text).alias("_text"), F.rand(7).alias("_u"), F.xxhash64(text_of(text)).alias("_h"))
    rows = texts.mapInPandas(encoded, "shard int, known boolean, doc_id long, _h long, ids binary, key binary")
    rows = rows.select("shard", "known", "doc_id", "_h", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("ids").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("key").alias("value")))).alias("_r"))
    # Equal rows would else lie in another order in the two files only if their numbers of ids differed.
    rows = rows.select("_r.kind", "shard", "known", "doc_id", "_h", F.col("_r.value").cast("string").alias("value"))
    rows = rows.repartition("shard").sortWithinPartitions("kind", "shard", "known", "doc_id", "_h")
    rows.select("value", "kind", "shard").write.partitionBy("kind", "shard").option("lineSep", chr(last)).text(f"{folder}/data")
    write_index(docs.sparkSession, folder)


def shard_files(spark: SparkSession, folder: str, kind: int) -> DataFrame:
    """(shard, content) of the files of ids (0) or keys (1); none where nothing was written."""
    files = spark.read.format("binaryFile").load(f"{folder}/data")
    if "shard" not in files.columns:
        return spark.createDataFrame([], "shard int, content binary")
    return files.where(F.col("kind") == kind).select("shard", "content")


def listed_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(known, doc_id, copy, shard, at, n) of all documents in the files: which of the rows of its id it is, and where its ids begin in the shard."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, content in zip(b["shard"], b["content"], strict=True):
                r = np.frombuffer(content, RECORD)
                new = np.ones(len(r), bool)
                new[1:] = (r["doc_id"][1:] != r["doc_id"][:-1]) | (r["known"][1:] != r["known"][:-1])
                run = np.cumsum(new) - 1
                edge = (run == run[0]) | (run == run[-1])
                yield pd.DataFrame({"known": r["known"].astype(bool), "doc_id": r["doc_id"], "copy": np.arange(len(r)) - np.flatnonzero(new)[run], "shard": shard, "at": np.cumsum(r["n"]) - r["n"], "n": r["n"], "edge": edge})

    rows = shard_files(spark, folder, 1).mapInPandas(parsed, "known boolean, doc_id long, copy long, shard int, at long, n long, edge boolean")
    rows = checkpointed(rows)
    # Only the first and the last id of a shard can be in others too.
    edges = rows.where("edge").groupBy("known", "doc_id", "shard").agg(F.count("*").alias("c"))
    earlier = F.sum("c").over(Window.partitionBy("known", "doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    edges = checkpointed(edges.withColumn("c", earlier).where("c is not null"))
    return rows.join(small(edges), ["known", "doc_id", "shard"], "left").select("known", "doc_id", (F.col("copy") + F.coalesce("c", F.lit(0))).alias("copy"), "shard", "at", "n")


def key_hashes(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three 64-bit hashes of each key: for its bucket, its slot, and its fingerprint."""
    x = mixed(rows["doc_id"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    x = mixed(x + rows["copy"].to_numpy(np.int64).view(np.uint64) * np.uint64(2) + rows["known"].to_numpy().astype(np.uint64))
    return x, mixed(x ^ np.uint64(0xC2B2AE3D27D4EB4F)), mixed(x + np.uint64(0x165667B19E3779F9))


def slots(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """The slot of a hash under its bucket's displacement: not negative: mixed in; negative: the slot itself, of a bucket with one key."""
    moved = mixed(h + shift.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)
    return np.where(shift < 0, -shift - 1, moved.astype(np.int64))


def displacements(bucket: np.ndarray, h: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """A displacement for each bucket such that all n hashes get slots of their own.

    The largest buckets choose first, each the first displacement under which its keys fall on free slots; those with one key take what slots are left.
    """
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    first = np.cumsum(sizes) - sizes
    shift, taken = np.zeros(buckets, np.int32), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        own = h[order[first[b] : first[b] + sizes[b]]]
        low = 0
        while True:
            tried = np.arange(low, low + TRIED)
            at = np.sort(slots(np.tile(own, (TRIED, 1)), np.repeat(tried[:, None], len(own), 1), n), axis=1)
            good = np.flatnonzero(~taken[at].any(1) & (at[:, 1:] != at[:, :-1]).all(1))
            if len(good):
                shift[b] = tried[good[0]]
                taken[at[good[0]]] = True
                break
            low += TRIED
    alone = np.flatnonzero(sizes == 1)
    shift[alone] = -np.flatnonzero(~taken) - 1
    return shift


def hashed_part(rows: pd.DataFrame) -> pd.DataFrame:
    """A part of the index: its displacements, and by slot the keys' fingerprints and places."""
    n = len(rows)
    buckets = -(-n // BUCKET)
    a, b, c = key_hashes(rows)
    bucket = (a % np.uint64(buckets)).astype(np.int64)
    shift = displacements(bucket, b, n, buckets)
    by_slot = np.argsort(slots(b, shift[bucket], n))
    pick = lambda x, kind: np.ascontiguousarray(x[by_slot], kind).tobytes()
    columns = [shift.tobytes(), pick(c, "<u8"), pick(rows["shard"].to_numpy(), "<i4"), pick(rows["at"].to_numpy(), "<i8"), pick(rows["n"].to_numpy(), "<i8")]
    return pd.DataFrame([[rows["part"].iloc[0], n, *columns]], columns=[x.split()[0] for x in ENTRY.split(", ")])


def part_of(parts: int):
    return F.pmod(F.xxhash64(*KEY), F.lit(parts)).cast("int")


def write_index(spark: SparkSession, folder: str) -> None:
    """Manifest and index from the shards' key files. A part of the index has about PART_KEYS keys, whatever their number."""
    keys = checkpointed(listed_keys(spark, folder))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards = keys.groupBy("shard").agg(F.sum("n").alias("all"), F.count("*").alias("docs"))
    shards.select("shard", "docs", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("before")).write.parquet(f"{folder}/manifest")
    parts = max(1, -(-keys.count() // PART_KEYS))
    index = keys.withColumn("part", part_of(parts)).groupBy("part").applyInPandas(hashed_part, ENTRY)
    index.withColumn("parts", F.lit(parts)).write.parquet(f"{folder}/index")


def places(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """keys(known, doc_id, copy), each once, with shard, at and n from the index; a key that isn't there is left out.

    One displacement and one slot are looked at for a key; its fingerprint of 64 bits tells a key that isn't there.
    """

    def found(rows: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = rows[KEY]
        if part.empty or rows.empty:
            return out.iloc[:0].assign(shard=0, at=0, n=0)
        p = part.iloc[0]
        read = lambda name, kind: np.frombuffer(p[name], kind)
        shift, n = read("shift", "<i4"), int(p["n"])
        a, b, c = key_hashes(rows)
        slot = slots(b, shift[(a % np.uint64(len(shift))).astype(np.int64)].astype(np.int64), n)
        out = out.assign(shard=read("shard", "<i4")[slot], at=read("at", "<i8")[slot], n=read("length", "<i8")[slot])
        return out[read("print", "<u8")[slot] == c]

    index = spark.read.parquet(f"{folder}/index")
    head = index.select("parts").first()
    asked = keys.withColumn("part", part_of(head["parts"] if head else 1))
    return asked.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(found, "known boolean, doc_id long, copy long, shard int, at long, n long")


def read_tokens(spark: SparkSession, folder: str, keys: DataFrame, width: int = 2, keep_ids: bool = False) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids_crc32) of the documents asked for, from the files; keep_ids adds their ids as unsigned 32-bit numbers.

    keys(doc_id, copy): copy counts the rows of an id from 0. start: the ids of all documents before it. Only shards that are asked for are read, each whole in
    one task; up to a million places are sent to the files, beyond that both meet by shard.
    """
    asked = keys.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("copy").cast("long").alias("copy"))
    found = checkpointed(places(spark, folder, asked))
    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "before")
    entry = F.struct("known", "doc_id", "copy", "at", "n")
    wanted = found.groupBy("shard").agg(F.collect_list(entry).alias("entries")).join(manifest, "shard")
    wanted = F.broadcast(wanted) if found.limit(1_000_001).count() <= 1_000_000 else wanted

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for before, content, entries in zip(b["before"], b["content"], b["entries"], strict=True):
                out = []
                for e in entries:
                    ids = np.frombuffer(content, f"<u{width}", e["n"], e["at"] * width).astype("<u4").tobytes()
                    out.append((e["known"], e["doc_id"], e["copy"], before + e["at"], e["n"], zlib.crc32(ids), ids if keep_ids else None))
                yield pd.DataFrame(out, columns=["known", "doc_id", "copy", "start", "n_tokens", "ids_crc32", "ids"])

    rows = shard_files(spark, folder, 0).join(wanted, "shard").select("before", "content", "entries").mapInPandas(sliced, "known boolean, doc_id long, copy long, start long, n_tokens long, ids_crc32 long, ids binary")
    rows = rows.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "copy", "start", "n_tokens", "ids_crc32", "ids")
    return rows if keep_ids else rows.drop("ids")


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids, and reads each document by its key."""
    import public_tokenizers

    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "tokens")
    write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    copies = F.sequence(F.lit(0).cast("long"), F.col("c") - 1)
    keys = docs.groupBy("doc_id").agg(F.count("*").alias("c")).select("doc_id", F.explode(copies).alias("copy"))
    return read_tokens(spark, folder, keys).select("doc_id", "start", "n_tokens", "ids_crc32")
