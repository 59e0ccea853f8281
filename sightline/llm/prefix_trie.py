"""The trie of conversations' prefixes: count-min screening keeps what can't be shared out of the shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, table

#: Hash rows of the sketch, counters a row for each prefix, and the most counters of a row: what is broadcast is a bit for each, 25 MB at most.
ROWS, PER_PREFIX, MOST = 3, 4, 1 << 26
#: Counters of a slice of the sketch, in which the partial sketches are merged.
SLICE = 1 << 16
#: Nodes with more than this share of all prefixes are broadcast to their children: so many at most.
HOT_NODES = 100_000
#: Ids of a piece of the list of conversations that end at a node.
CHUNK = 512
KEY = ["depth", "k1", "k2"]
NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, block, pos, h1, h2, bytes) in their order, counted from 1, and (conv_id, n, block, many) for each conversation.

    The order is by turn, null first, then role, then text. All rows are sorted in ranges over many tasks; a range is a block, and a conversation that a range's end
    cuts (`many`) is counted on from block to block, so it may hold any share of the rows. Rows without a conv_id belong to no conversation.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    by = ["conv_id", "turn", "role", "text"]
    ranged = checkpointed(rows.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "conv_id", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("at"),
        F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2"), F.octet_length("text").cast("long").alias("bytes"),
    ))
    convs = ranged.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.min("block").alias("block"), F.max("block").alias("to"))
    convs = checkpointed(convs.select("conv_id", "n", "first", "block", (F.col("block") < F.col("to")).alias("many")))
    # A block's end cuts one conversation at most: a few rows for each block.
    cut = F.broadcast(convs.where("many").select("conv_id"))
    pieces = ranged.join(cut, "conv_id").groupBy("conv_id", "block").agg(F.min("at").alias("low"), F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("conv_id", "block", (F.col("low") - before).alias("zero"))
    turns = ranged.join(convs.select("conv_id", "first"), "conv_id").join(F.broadcast(pieces), ["conv_id", "block"], "left")
    return turns.select("conv_id", "block", (F.col("at") - F.coalesce("zero", "first") + 1).alias("pos"), "h1", "h2", "bytes"), convs.drop("first")


def with_prefixes(turns: DataFrame) -> DataFrame:
    """Per turn of turns(conv_id, block, pos, h1, h2, bytes, length, many) the 128-bit digest of the prefix that it ends (k1, k2) and of the one before (p1, p2).

    A prefix's digest is the exclusive or of its turns' hashes, each taken with its position; blocks are folded by themselves, and the cut conversations' go on
    from what their earlier blocks gave.
    """
    rows = turns.withColumn("t1", F.xxhash64(F.lit(3), "pos", "h1", "h2")).withColumn("t2", F.xxhash64(F.lit(4), "h2", "h1", "pos"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.where("many").groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("c1"), F.bit_xor("t2").alias("c2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("c1", "c2")))
    rows = rows.withColumn("k1", F.bit_xor("t1").over(so_far)).withColumn("k2", F.bit_xor("t2").over(so_far))
    rows = rows.join(F.broadcast(blocks), ["conv_id", "block"], "left")
    for c in "12":
        rows = rows.withColumn(f"k{c}", F.col(f"k{c}").bitwiseXOR(F.coalesce(f"c{c}", F.lit(0)))).withColumn(f"p{c}", F.col(f"k{c}").bitwiseXOR(F.col(f"t{c}")))
    return rows.select("conv_id", "block", F.col("pos").alias("depth"), "k1", "k2", "p1", "p2", "bytes", (F.col("pos") == F.col("length")).alias("last"))


def counters(k1: np.ndarray, k2: np.ndarray, width: int) -> list[np.ndarray]:
    """A digest's counter in each row of the sketch; the rows lie one behind the other."""
    a, b = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64) | np.uint64(1)
    return [((a + np.uint64(i) * b) >> np.uint64(20)) % np.uint64(width) + np.uint64(i * width) for i in range(ROWS)]


def sketched(prefixes: DataFrame, width: int) -> bytes:
    """A bit for each counter of the count-min sketch of all prefixes: whether it counts more than one.

    A counter stops at two, which is all that the screening asks. Tasks send the slices of their own sketch that aren't empty, and slices are merged in two rounds.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = [c for b in batches for c in counters(b["k1"].to_numpy(), b["k2"].to_numpy(), width)]
        cells, times = np.unique(np.concatenate(cells) if cells else np.empty(0, np.uint64), return_counts=True)
        number = (cells // np.uint64(SLICE)).astype(np.int64)
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        for low, high in zip(starts, [*starts[1:], len(cells)], strict=True):
            at = (cells[low:high] % np.uint64(SLICE)).astype(np.int64)
            yield pd.DataFrame({"slice": [number[low]], "once": [bits(at)], "twice": [bits(at[times[low:high] > 1])]})

    def bits(at: np.ndarray) -> bytes:
        out = np.zeros(SLICE, np.uint8)
        out[at] = 1
        return np.packbits(out).tobytes()

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SLICE // 8, np.uint8), np.zeros(SLICE // 8, np.uint8)
        for a, b in zip(rows["once"], rows["twice"], strict=True):
            a = np.frombuffer(a, np.uint8)
            twice |= np.frombuffer(b, np.uint8) | (once & a)
            once |= a
        return pd.DataFrame({"slice": rows["slice"][:1], "once": [once.tobytes()], "twice": [twice.tobytes()]})

    schema = "slice long, once binary, twice binary"
    parts = prefixes.select("k1", "k2").mapInPandas(partial, schema).withColumn("sub", F.spark_partition_id() % 64)
    slices = parts.groupBy("slice", "sub").applyInPandas(lambda rows: merged(rows[["slice", "once", "twice"]]), schema).groupBy("slice").applyInPandas(merged, schema)
    out = bytearray(-(-ROWS * width // SLICE) * (SLICE // 8))
    for r in slices.select("slice", "twice").toLocalIterator():
        out[r["slice"] * (SLICE // 8) : (r["slice"] + 1) * (SLICE // 8)] = r["twice"]
    return bytes(out)


def screened(prefixes: DataFrame) -> DataFrame:
    """prefixes with `alone` and `above_alone`: whether the sketch proves that no other conversation has the prefix, and the one a turn shorter.

    An estimate is never too small, so an estimate of one is a proof. The empty prefix counts as shared.
    """
    total = prefixes.count()
    width = 1 << min(MOST.bit_length() - 1, max(10, (PER_PREFIX * total).bit_length()))
    sketch = prefixes.sparkSession.sparkContext.broadcast(sketched(prefixes, width))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        twice = np.frombuffer(sketch.value, np.uint8)

        def alone(k1: pd.Series, k2: pd.Series) -> np.ndarray:
            out = np.zeros(len(k1), bool)
            for c in counters(k1.to_numpy(), k2.to_numpy(), width):
                out |= (twice[c >> np.uint64(3)] >> (np.uint8(7) - (c & np.uint64(7)).astype(np.uint8))) & 1 == 0
            return out

        for b in batches:
            yield b.assign(alone=alone(b["k1"], b["k2"]), above_alone=alone(b["p1"], b["p2"]) & (b["depth"] > 1).to_numpy())

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema.fields)
    return prefixes.mapInPandas(judged, f"{fields}, alone boolean, above_alone boolean")


def ends_of(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): the SHA-256 of each node's conversations (conv_id), ascending and joined by commas.

    Ids are sorted in ranges over many tasks and joined into short pieces there. A digest is a chain, so a node's pieces then pass through one task in their order,
    a batch at a time: what it keeps is the state of the hash.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                new = (b[KEY] != b[KEY].shift()).any(axis=1).cumsum()
                within = b.groupby(new, sort=False).cumcount() // CHUNK
                yield b.groupby([new, within], sort=False).agg(depth=("depth", "first"), k1=("k1", "first"), k2=("k2", "first"), ids=("conv_id", lambda x: ",".join(map(str, x))))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for *key, ids in zip(b["depth"], b["k1"], b["k2"], b["ids"], strict=True):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends"]).astype({k: "int64" for k in KEY})
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*KEY, "ends"])

    by = [*KEY, "conv_id"]
    short = rows.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInPandas(pieces, "depth long, k1 long, k2 long, ids string")
    short = checkpointed(short.withColumn("at", F.monotonically_increasing_id()))
    return short.repartition(*KEY).sortWithinPartitions(*KEY, "at").mapInPandas(hashed, "depth long, k1 long, k2 long, ends string")


def with_parents(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """rows(depth, p1, p2) with the smallest conversation of the node above (`parent`). Nodes with many members are broadcast, as a third of all rows may have one parent."""
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent"), "n")
    most = total // HOT_NODES
    hot = F.broadcast(up.where(F.col("n") > most).drop("n"))
    on = ["depth", "p1", "p2"]
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(up.where(F.col("n") <= most).drop("n"), on))


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns(conv_id, block, pos, h1, h2, bytes, length, many), pos from 1 without gaps, blocks in the order of pos; members(conv_id, length), those without turns too.

    Prefixes that the sketch proves alone, with the one above alone too, are nodes where they stand and are never shuffled. The others are grouped
    exactly by their digest. What a subtree sums up is carried by its members: a node's value belongs to its smallest conversation, each conversation adds up its
    values from the deepest on, and a node is the sum over its members. Nodes' groups are aggregated before the shuffle.
    """
    seen = checkpointed(screened(checkpointed(with_prefixes(turns))))
    total = seen.count() + members.count()
    shared, single = seen.where("not alone"), seen.where("alone")
    heads = single.where("not above_alone")
    grouped = shared.groupBy(*KEY, "p1", "p2", "above_alone").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.max("bytes").alias("bytes"))
    zero = [F.lit(0).cast("long").alias(c) for c in (*KEY, "p1", "p2")]
    root = members.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).where("n > 0").select(*zero, F.lit(True).alias("above_alone"), "n", "least", F.lit(0).cast("long").alias("bytes"))
    groups = checkpointed(grouped.unionByName(root))
    # A prefix whose parent is alone is alone itself, whatever its own estimate.
    below = groups.where("depth > 0 and not above_alone").select("depth", "p1", "p2").unionByName(heads.select("depth", "p1", "p2"))
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    groups = checkpointed(groups.join(children, KEY, "left").fillna(0, ["n_children"]))
    values = groups.where("depth > 0").select(F.col("least").alias("conv_id"), "depth", ((F.col("n") - 1) * F.col("bytes")).alias("value"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    values = values.where("value > 0 or leaf > 0")
    own = shared.join(values, ["conv_id", "depth"], "left").fillna(0, ["value", "leaf"]).select("conv_id", "block", *KEY, "value", "leaf", F.lit(True).alias("shared"))
    tips = single.where("last").select("conv_id", "block", *KEY, F.lit(0).cast("long").alias("value"), F.lit(1).cast("long").alias("leaf"), F.lit(False).alias("shared"))
    summed = checkpointed(with_totals(own.unionByName(tips)).where("shared").groupBy(*KEY).agg(F.sum("value").alias("saved"), F.sum("leaf").alias("n_leaves")))
    whole = values.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("a")).crossJoin(tips.agg(F.count("*").alias("b")))
    summed = summed.unionByName(whole.select(*zero[:3], "saved", F.greatest(F.lit(1), F.col("a") + F.col("b")).alias("n_leaves")))
    ends = ends_of(shared.where("last").select("conv_id", *KEY).unionByName(members.where("length = 0").select("conv_id", *zero[:3])))
    nodes = groups.join(summed, KEY, "left").join(ends, KEY, "left")
    nodes = checkpointed(nodes.select("depth", "p1", "p2", "above_alone", F.col("least").alias("conv_id"), "n", "n_children", "n_leaves", "saved", F.coalesce("ends", F.lit(NOTHING)).alias("ends")))
    by_itself = [F.lit(1).cast("long").alias("n"), (~F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"), F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends")]
    columns = ["depth", "conv_id", "parent", "n", "n_children", "n_leaves", "saved", "ends"]
    tails = single.where("above_alone").select("depth", "conv_id", F.col("conv_id").alias("parent"), *by_itself)
    above = with_parents(heads.select("depth", "p1", "p2", "conv_id", *by_itself).unionByName(nodes.where("depth > 0 and not above_alone").drop("above_alone")), groups, total)
    kept = nodes.where("above_alone").withColumn("parent", F.when(F.col("depth") > 0, F.col("conv_id")))
    out = tails.select(columns).unionByName(above.select(columns)).unionByName(kept.select(columns))
    return out.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )


def with_totals(rows: DataFrame) -> DataFrame:
    """rows with value and leaf summed over a conversation's rows from this depth down, block by block."""
    rows = checkpointed(rows)
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    spread = rows.groupBy("conv_id").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("conv_id")
    blocks = rows.join(F.broadcast(spread), "conv_id").groupBy("conv_id", "block").agg(F.sum("value").alias("value_after"), F.sum("leaf").alias("leaf_after"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("value_after", "leaf_after")))
    rows = rows.withColumn("value", F.sum("value").over(down)).withColumn("leaf", F.sum("leaf").over(down)).join(F.broadcast(blocks), ["conv_id", "block"], "left")
    return rows.withColumn("value", F.col("value") + F.coalesce("value_after", F.lit(0))).withColumn("leaf", F.col("leaf") + F.coalesce("leaf_after", F.lit(0)))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text) as they are.

    A null role or text is empty; turns are in the order of turn, null first, ties by role, then text; repeated rows are turns each; texts of any length go
    by their digest. Other columns are left out, whatever their names; rows without a conv_id too. No conversations, no nodes.
    """
    turns, convs = ordered_turns(conversations)
    turns = turns.join(convs.select("conv_id", F.col("n").alias("length"), "many"), "conv_id")
    return trie(turns, convs.select("conv_id", F.col("n").alias("length")))


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and members for `trie`: conversation c begins with the first h turns of c - c % family, and goes on with its own after its first h; h is the CRC-32 of c in decimal, modulo `most`."""
    turns, convs = ordered_turns(conversations)
    turns = checkpointed(turns)
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most)
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = checkpointed(convs.withColumn("length", F.col("given") + F.greatest(F.lit(0), F.col("n") - F.col("h"))))
    own = turns.join(convs.drop("block"), "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("given"))
    lent = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "h1", "h2", "bytes").join(convs, "base").where("pos <= h")
    columns = ["conv_id", "block", "pos", "h1", "h2", "bytes", "length", "many"]
    return own.select(columns).unionByName(lent.select(columns)), convs.select("conv_id", "length")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(table(spark, sf_dir, "conversations")))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT c, count(*) AS n FROM t GROUP BY c
), h AS (
  SELECT c, n, c - c % 5 AS base, xor(4294967295, list_reduce(string_split(CAST(c AS VARCHAR), ''), lambda a, ch: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, CAST(ord(ch) AS BIGINT))), 4294967295)) % 9 AS h FROM n
), g AS (SELECT h.*, least(h.h, coalesce(b.n, 0)) AS given FROM h LEFT JOIN n b ON b.c = h.base
), r AS (
  SELECT g.c, t.pos - g.h + g.given AS pos, role, text FROM g JOIN t ON t.c = g.c AND t.pos > g.h UNION ALL SELECT g.c, t.pos, role, text FROM g JOIN t ON t.c = g.base AND t.pos <= g.h
), p AS (
  SELECT c, pos AS d, octet_length(encode(text)) AS b, sha256(string_agg(sha256(role) || sha256(text), ',') OVER (PARTITION BY c ORDER BY pos)) AS k FROM r
  UNION ALL SELECT c, 0, 0, 'root' FROM g
), e AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS last FROM p
), v AS (
  SELECT k, up, d, min(c) AS c, count(*) AS n, (count(*) - 1) * max(b) AS own, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends FROM e GROUP BY k, up, d
), kids AS (SELECT up AS k, count(*) AS kids FROM v WHERE up IS NOT NULL GROUP BY up
), w AS (SELECT v.*, coalesce(kids, 0) AS kids FROM v LEFT JOIN kids USING (k)
), below AS (SELECT a.k, count(*) FILTER (w.kids = 0) AS leaves, sum(w.own) AS saved FROM w JOIN e b ON b.c = w.c AND b.d = w.d JOIN e a ON a.c = w.c AND a.d <= w.d GROUP BY a.k)
SELECT w.c AS conv_id, CAST(w.d AS BIGINT) AS depth, m.c AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM w LEFT JOIN v m ON m.k = w.up JOIN below ON below.k = w.k
"""
