"""Exact Jaccard join of documents on word shingles, with prefix filters under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import called, checkpointed, connected_components, id_columns, in_text_batches, small, table, text_of

#: Share of a set that its prefix under the hash order has; more prunes better and costs more rows.
HASH_PREFIX = 0.2
#: In buckets of one prefix token that have more documents than the first number, all are first compared with one of them. Up to the
#: second number documents are paired in one row, beyond it in blocks.
STAR, BUCKET = 4, 24
#: Documents and shingles in a block, of which two are compared in a task, or which small buckets in a task have together; documents that are verified in a task;
#: pairs for each document of a block beyond which the block is verified as a whole.
BLOCK_DOCS, BLOCK_SHINGLES, VERIFIED_DOCS, DENSE = 1024, 1_000_000, 64, 16
#: 64-bit words of the parity bitmap that stands for a hash prefix, and the most words of the one that stands for a whole set.
BITMAP, WIDE = 8, 512


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes in ascending order, which is the hash order of shingles.

    Words stand between ASCII white space; A-Z are lower-cased. With fewer words than width
    the whole sequence is the one shingle; with none there is none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    k = min(width, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = mixed(total + hashed[i : len(words) - k + 1 + i])
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def kept_out(n: int, share: float) -> int:
    """How many of n shingles the hash prefix leaves out."""
    return int(n * (1 - share) + 1e-9)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return tuple(int(mixed(tokens ^ np.uint64(s)).sum(dtype=np.uint64).astype(np.int64)) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def hashed_sets(docs: DataFrame, width: int, share: float, text: str) -> DataFrame:
    """Per document: the size of its set, a fingerprint, and the prefix of its set in hash order."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["_text"]:
                tokens = shingles(t, width)
                rows.append((len(tokens), *fingerprint(tokens), tokens[: len(tokens) - kept_out(len(tokens), share)].view(np.int64)))
            out = pd.DataFrame(rows, columns=["n", "fp_a", "fp_b", "prefix"])
            out.insert(0, "doc_id", pd.array(batch["doc_id"], dtype="Int64"))
            out.loc[batch["_no_id"].to_numpy(), "doc_id"] = pd.NA
            yield out

    return in_text_batches(docs).select(*id_columns(), text_of(text).alias("_text")).mapInPandas(
        sets, "doc_id long, n long, fp_a long, fp_b long, prefix array<long>"
    )


def full_sets(docs: DataFrame, width: int, share: float) -> DataFrame:
    """Per document its whole set, and parity bitmaps of its prefix in hash order and of the set (two bits or more for each shingle, in a power of two)."""

    def parity(tokens: np.ndarray, words: int) -> np.ndarray:
        odd = np.bincount((tokens % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, t in zip(batch["doc_id"], batch["_text"], strict=True):
                tokens = shingles(t, width)
                head = tokens[: len(tokens) - kept_out(len(tokens), share)]
                words = min(WIDE, max(BITMAP, 1 << max(0, 2 * len(tokens) - 1).bit_length() - 6)) if len(tokens) > 32 else BITMAP
                rows.append((doc, len(tokens), len(head), parity(head, BITMAP), parity(tokens, words), tokens.view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "n_prefix", "bitmap", "wide", "tokens"])

    return in_text_batches(docs).mapInPandas(sets, "doc_id long, n long, n_prefix long, bitmap array<long>, wide array<long>, tokens array<long>")


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """Common shingles of sets of n and m that are similar enough."""
    return F.ceil(percent * (n + m) / F.lit(100.0 + percent) - 1e-9)


class Bitmaps:
    """Parity bitmaps of different sizes. A bit that differs between two of them is a shingle, at least, that one set has and the other doesn't."""

    def __init__(self, bitmaps):
        self.size = np.array([len(x) for x in bitmaps], np.int64)
        self.place, self.stack = np.zeros(len(self.size), np.int64), {}
        for size in np.unique(self.size):
            own = np.flatnonzero(self.size == size)
            self.place[own] = np.arange(len(own))
            self.stack[size] = np.stack([np.asarray(bitmaps[i], np.int64) for i in own]).view(np.uint64)

    def differing(self, p: np.ndarray, other: Bitmaps, q: np.ndarray) -> np.ndarray:
        """Bits in which bitmaps p and the other's q differ; a larger one is folded to the smaller's size, which keeps parities."""
        out = np.zeros(len(p), np.int64)
        for a in self.stack:
            for b in other.stack:
                both = np.flatnonzero((self.size[p] == a) & (other.size[q] == b))
                least = min(a, b)
                step = max(1, 2_000_000 // max(a, b))
                for low in range(0, len(both), step):
                    at = both[low : low + step]
                    x, y = self.stack[a][self.place[p[at]]], other.stack[b][other.place[q[at]]]
                    x, y = (np.bitwise_xor.reduce(z.reshape(len(at), -1, least), axis=1) for z in (x, y))
                    out[at] = np.bitwise_count(x ^ y).sum(1)
        return out


def most_differing(n, m, percent: int):
    """Shingles that only one of two sets of n and m has, at most, if they are similar enough."""
    return n + m - 2 * np.ceil(percent * (n + m) / (100.0 + percent) - 1e-9)


def passing_pairs(percent: int):
    """Pairs (src, dst, n, m, a, b) whose bitmaps a and b of whole sets allow a link."""

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at = np.arange(len(rows))
            differ = Bitmaps(rows["a"].to_numpy()).differing(at, Bitmaps(rows["b"].to_numpy()), at)
            yield rows.loc[differ <= most_differing(rows["n"].to_numpy(), rows["m"].to_numpy(), percent), ["src", "dst"]]

    return passing


def forest(ids: np.ndarray, link: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric matrix connects."""
    out, new = [], np.ones(len(ids), bool)
    for first in np.flatnonzero(link.any(1)):
        if not new[first]:
            continue
        new[first] = False
        wave = [first]
        while wave:
            x = wave.pop()
            for y in np.flatnonzero(link[x] & new):
                new[y] = False
                wave.append(y)
                out.append((ids[x], ids[y]))
    return out


def overlaps(tokens: list[np.ndarray]) -> np.ndarray:
    """The number of common shingles of each two sets."""
    count = len(tokens)
    owner = np.repeat(np.arange(count), [len(x) for x in tokens])
    _, code, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    again = times[code] > 1
    owner, code = owner[again], code[again]
    common = np.zeros((count, count), np.float32)
    used, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    step = max(64, 4_000_000 // max(count, 1))
    for low in range(0, len(used), step):
        a, b = np.searchsorted(code, [low, low + step])
        there = np.zeros((count, min(step, len(used) - low)), np.float32)
        there[owner[a:b], code[a:b] - low] = 1
        common += there @ there.T
    return common


def similar(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    common = np.rint(common).astype(np.int64)
    return 100 * common >= percent * (n + m - common)


def linked_blocks(percent: int):
    """A block, or two: exact overlaps of sets that aren't connected yet, and a spanning forest of the links."""

    def links(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("doc_id", ignore_index=True)
        sizes, group = own["n"].to_numpy(np.int64), own["component"].to_numpy()
        common = overlaps([np.asarray(x, np.int64) for x in own["tokens"]])
        link = np.empty(common.shape, bool)
        for low in range(0, len(own), 256):
            part = slice(low, low + 256)
            link[part] = similar(common[part], sizes[part, None], sizes[None, :], percent) & (group[part, None] != group[None, :])
        return pd.DataFrame(forest(own["doc_id"].to_numpy(), link), columns=["src", "dst"]).astype("int64")

    return links


def passing_blocks(percent: int):
    """A task: buckets (key, i, j) of one prefix token, each of two blocks or one. The pairs that pass all filters and aren't connected yet: as (src, dst), or,
    where most of the documents pass with many, the documents as members (dst) of a group that is to be verified as a whole."""

    def passing(rows: pd.DataFrame) -> pd.DataFrame:
        pairs, dense = [], []
        for name, own in rows.groupby(["key", "i", "j"], sort=True):
            own = own.sort_values("doc_id", ignore_index=True)
            n, at, head, group = (own[c].to_numpy(np.int64) for c in ("n", "at", "n_prefix", "component"))
            bitmap, block = np.stack(own["bitmap"].to_numpy()).astype(np.int64).view(np.uint64), own["block"].to_numpy()
            link = np.empty((len(own), len(own)), bool)
            for low in range(0, len(own), 128):
                x = slice(low, low + 128)
                left, right = n[x, None], n[None, :]
                need = np.ceil(percent * (left + right) / (100.0 + percent) - 1e-9)
                ok = (group[x, None] != group[None, :]) & (100 * np.minimum(left, right) >= percent * np.maximum(left, right))
                ok &= np.minimum(at[x, None], at[None, :]) + np.minimum(left - at[x, None], right - at[None, :]) >= need
                differ = sum(np.bitwise_count(bitmap[x, k, None] ^ bitmap[None, :, k]).astype(np.int64) for k in range(BITMAP))
                link[x] = ok & (differ <= head[x, None] + head[None, :] - 2 * (need - np.maximum(left - head[x, None], right - head[None, :])))
            if (block != block[0]).any():
                link &= block[:, None] != block[None, :]
            p, q = np.nonzero(np.triu(link, 1))
            wide = Bitmaps(own["wide"].to_numpy())
            near = wide.differing(p, wide, q) <= most_differing(n[p], n[q], percent)
            p, q, ids = p[near], q[near], own["doc_id"].to_numpy()
            if len(p) <= DENSE * len(own):
                pairs.append(np.stack([ids[p], ids[q]]))
            else:
                dense.append(pd.DataFrame({"block": "|".join(map(str, name)), "src": -1, "dst": ids[np.union1d(p, q)]}))
        src, dst = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
        return pd.concat([pd.DataFrame({"block": None, "src": src, "dst": dst}), *dense])

    return passing


def star_links(percent: int):
    """A task: some documents and their leaders. The documents that are linked with their leader."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for leader, own in rows.groupby("key", sort=True):
            tokens, ids = own["tokens"].to_numpy(), own["doc_id"].to_numpy()
            center = np.sort(np.asarray(tokens[np.flatnonzero(ids == leader)[0]], np.int64))
            common = np.array([np.isin(np.asarray(x, np.int64), center, assume_unique=True).sum() for x in tokens])
            ok = similar(common, own["n"].to_numpy(np.int64), np.int64(len(center)), percent) & (ids != leader)
            out += [(leader, x) for x in ids[ok]]
        return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")

    return links


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among pairs(src, dst): first by bitmaps of whole sets, which leave hardly a pair that isn't one, then by the sets themselves."""
    wide = lambda end, n, bits: sets.select(F.col("doc_id").alias(end), F.col("n").alias(n), F.col("wide").alias(bits))
    near = pairs.join(wide("src", "n", "a"), "src").join(wide("dst", "m", "b"), "dst")
    near = checkpointed(near.mapInPandas(passing_pairs(percent), "src long, dst long"))
    near = near.withColumn("chunk", F.pmod(F.xxhash64("dst"), F.lit(1 + near.count() // VERIFIED_DOCS)))
    ends = near.select(F.col("src").alias("key"), "chunk", F.col("dst").alias("doc_id")).union(near.select(F.col("src").alias("key"), "chunk", F.col("src").alias("doc_id")).distinct())
    ends = small(checkpointed(ends), 300_000)  # else all whole sets are shuffled to meet them
    return ends.join(sets.select("doc_id", "n", "tokens"), "doc_id").groupBy("chunk").applyInPandas(star_links(percent), "src long, dst long")


def dealt(rows: DataFrame, weight: Column) -> DataFrame:
    """rows(key, component, doc_id, ...) with task, i, j and block, so that any two rows of a key and of different components meet in a group (key, i, j).

    weight: a row's share of a block. A key within one block is one group, and a task has many of those. A larger key is dealt into
    blocks: a component that fills a block has its own ones, which meet the others' but not one another; all else is dealt by a hash.
    """
    columns = [*rows.columns, "task", "i", "j", "block"]
    rows = checkpointed(rows.withColumn("_w", weight))
    keys = checkpointed(rows.groupBy("key").agg(F.sum("_w").alias("_all")))
    total, most = keys.agg(F.sum("_all"), F.max("_all")).first()
    light = [F.pmod(F.xxhash64("key"), F.lit(1 + int(total or 0))).alias("task"), *(F.lit("").alias(c) for c in ("i", "j", "block"))]
    if (most or 0) <= 1:
        return rows.select("*", *light).select(columns)
    # What is known of large keys and their blocks has a row for each block or pair of blocks.
    large = small(checkpointed(keys.where(F.col("_all") > 1).select("key")))
    sizes = checkpointed(rows.join(large, "key", "left_semi").groupBy("key", "component").agg(F.sum("_w").alias("_sum")))
    owned = sizes.where("_sum > 1").select("key", F.col("component").alias("_own"), F.ceil("_sum").cast("long").alias("_blocks"))
    others = sizes.where("_sum <= 1").groupBy("key").agg(F.ceil(F.sum("_sum")).cast("long").alias("_blocks"))
    name = lambda own, at: F.concat_ws("/", own, at)
    names = owned.select("key", F.col("_own").cast("string").alias("_owner"), "_blocks").union(others.select("key", F.lit("rest").alias("_owner"), "_blocks"))
    names = names.select("key", "_owner", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_at")).select("key", "_owner", name(F.col("_owner"), F.col("_at")).alias("block"))
    second = names.select("key", F.col("_owner").alias("_owner2"), F.col("block").alias("j"))
    meet = names.withColumnRenamed("block", "i").join(second, "key").where("i <= j and (_owner != _owner2 or _owner = 'rest')").select("key", "i", "j")
    sides = checkpointed(meet.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")))
    owned, others = small(checkpointed(owned.withColumnRenamed("_own", "component"))), small(checkpointed(others.withColumnRenamed("_blocks", "_rest")))
    placed = rows.join(large, "key", "left_semi").join(owned, ["key", "component"], "left").join(others, "key", "left")
    placed = placed.withColumn("block", F.when(F.col("_blocks").isNotNull(), name(F.col("component").cast("string"), F.pmod(F.xxhash64("doc_id"), "_blocks"))).otherwise(name(F.lit("rest"), F.pmod(F.xxhash64("doc_id"), "_rest"))))
    heavy = placed.join(small(sides), ["key", "block"]).withColumn("task", F.xxhash64("key", "i", "j"))
    return rows.join(large, "key", "left_anti").select("*", *light).select(columns).union(heavy.select(columns))


def similar_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) that connect what all links among sets(doc_id, n, n_prefix, bitmap, wide, tokens) connect."""
    t = percent / 100
    # Order two: rarest first. Shingles of one set only come first of all; of the others a set's prefix has the next ones.
    each = sets.select("doc_id", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    room = (F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("ranked"))).cast("int")
    prefixes = (
        each.join(shared, "token")
        .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
        .join(small(sets.select("doc_id", "n"), 300_000), "doc_id")
        .where(room > 0)
        .select("doc_id", "n", (F.col("n") - F.size("ranked")).alias("alone"), F.slice("ranked", 1, F.greatest(F.lit(0), room)).alias("ranked"))
        .select("doc_id", "n", "alone", F.posexplode("ranked").alias("at", "entry"))
        .select("doc_id", "n", (F.col("alone") + F.col("at")).alias("at"), F.col("entry.token").alias("token"))
    )
    prefixes = checkpointed(prefixes)
    buckets = checkpointed(prefixes.groupBy("token").agg(F.count("*").alias("m"), F.min("doc_id").alias("leader")).where("m > 1"))
    narrow = sets.select("doc_id", "n", "n_prefix", "bitmap")
    # Near copies: all of a bucket are compared with one of them, and those linked with it needn't meet again.
    stars = prefixes.join(buckets.where(F.col("m") > STAR), "token").where("doc_id != leader").select("leader", "doc_id").distinct()
    stars = stars.join(small(narrow, 100_000), "doc_id").join(_renamed(small(narrow, 100_000), "leader"), "leader").where(_alike(percent))
    close = checkpointed(verified(stars.select(F.col("leader").alias("src"), F.col("doc_id").alias("dst")), sets, percent))
    known = close.groupBy(F.col("dst").alias("doc_id")).agg(F.min("src").alias("component"))  # documents of one name are connected by that leader
    about = checkpointed(narrow.drop("n").join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    met = prefixes.join(buckets, "token").join(small(about, 100_000), "doc_id")
    # Small buckets: pairs that can be similar by size, by place in order two, and by what they share of order one's prefix.
    members = met.where(F.col("m") <= BUCKET).groupBy("token").agg(F.collect_list(F.struct("doc_id", "n", "at", "n_prefix", "bitmap", "component")).alias("members"))
    pairs = members.select(F.explode("members").alias("a"), "members").select(
        "a", F.explode(F.filter("members", lambda b: (b["doc_id"] > F.col("a.doc_id")) & (b["component"] != F.col("a.component")) & _may_match(F.col("a"), b, percent))).alias("b")
    )
    pairs = pairs.select(F.col("a.doc_id").alias("src"), F.col("b.doc_id").alias("dst"))
    # Large ones: the same tests in blocks of the documents that aren't connected yet.
    hot = met.where(F.col("m") > BUCKET)
    open_ = hot.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("token")
    hot = dealt(hot.join(small(checkpointed(open_)), "token", "left_semi").drop("m", "leader").withColumnRenamed("token", "key"), 1.0 / BLOCK_DOCS + F.col("n") / BLOCK_SHINGLES)
    passed = hot.join(sets.select("doc_id", "wide"), "doc_id").groupBy("task").applyInPandas(passing_blocks(percent), "block string, src long, dst long")
    passed = checkpointed(passed)
    found = verified(pairs.union(passed.where("block is null").select("src", "dst")).distinct(), sets, percent)
    dense = passed.where("block is not null").select("block", F.col("dst").alias("doc_id")).join(about.select("doc_id", "component"), "doc_id")
    dense = dense.join(sets.select("doc_id", "n", "tokens"), "doc_id").groupBy("block").applyInPandas(linked_blocks(percent), "src long, dst long")
    return close.union(found).union(dense)


def _renamed(narrow: DataFrame, name: str) -> DataFrame:
    return narrow.select(F.col("doc_id").alias(name), *(F.col(c).alias(f"l_{c}") for c in ("n", "n_prefix", "bitmap")))


def _alike(percent: int) -> Column:
    """Whether a document's and a leader's sizes and hash prefixes allow a link."""
    n, m = F.col("n"), F.col("l_n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & _prefixes_match(n, m, F.col("n_prefix"), F.col("l_n_prefix"), F.col("bitmap"), F.col("l_bitmap"), percent)


def _prefixes_match(n: Column, m: Column, head_a: Column, head_b: Column, bits_a: Column, bits_b: Column, percent: int) -> Column:
    in_prefix = least_overlap(n, m, percent) - F.greatest(n - head_a, m - head_b)
    differ = sum((F.bit_count(bits_a[i].bitwiseXOR(bits_b[i])) for i in range(BITMAP)), F.lit(0))
    return differ <= head_a + head_b - 2 * in_prefix


def _may_match(a: Column, b: Column, percent: int) -> Column:
    n, m = a["n"], b["n"]
    in_time = F.least(a["at"], b["at"]) + F.least(n - a["at"], m - b["at"])
    return (
        (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (in_time >= least_overlap(n, m, percent))
        & _prefixes_match(n, m, a["n_prefix"], b["n_prefix"], a["bitmap"], b["bitmap"], percent)
    )


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", share: float | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: documents are linked when
    100 * common shingles >= percent * shingles of both.

    Equal sets are one class from the start. Order one is the shingles' hash: a set's prefix holds
    its lowest hashes, and similar sets share a known number of prefix tokens. A class most of whose prefix
    tokens no other class has can't reach that number and needs no whole set. For the rest, order two is
    rarest first: similar sets share a token of their prefixes in it. Candidates must pass both
    (order one's overlap is tested on a parity bitmap of the prefix), and sizes, places and parity bitmaps of the whole sets must
    allow the overlap. What passes is verified pair by pair on whole sets. A token's
    large bucket is never expanded into all pairs: all its documents are first compared with one of them, and those that it is linked with
    are connected for good; the others are tested by all filters in blocks, and a block in which most pass with many is verified as a whole.

    A null or empty text, or one without words, has no shingles and is linked with nothing. Rows without a
    doc_id are linked through equal sets only; rows that share a doc_id count as one document and are returned each. A similarity of exactly the
    percentage links. Texts of any length are read whole. Similarity is
    of 64-bit shingle hashes. Extra columns are left out; no rows give no rows.
    """
    share = max(HASH_PREFIX, 1 - percent / 100 + 0.05) if share is None else share
    sets = checkpointed(hashed_sets(docs, width, share, text))
    classes = checkpointed(sets.where("n > 0").groupBy("fp_a", "fp_b", "n").agg(F.min("doc_id").alias("rep"), F.first(F.size("prefix")).alias("p")))
    # Prefix tokens that only one class has, counted for each class.
    alone = (
        sets.select(F.explode("prefix").alias("token"), "fp_a").groupBy("token").agg(F.min("fp_a").alias("fp_a"), F.max("fp_a").alias("to"))
        .where("fp_a = to").groupBy("fp_a").agg(F.count("*").alias("alone"))
    )
    need = F.greatest(F.lit(1), F.ceil((percent / 100 - 1 + share) * F.col("n") - 1e-6))
    alive = classes.join(alone, "fp_a", "left").where((F.col("p") - F.coalesce("alone", F.lit(0)) >= need) & F.col("rep").isNotNull())
    alive = checkpointed(alive.select(F.col("rep").alias("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("_text")).join(small(alive), "doc_id", "left_semi")
    whole = checkpointed(full_sets(texts, width, share))
    components = connected_components(similar_links(whole, percent))
    named = classes.join(components, classes.rep == components.node, "left").select("fp_a", "fp_b", "n", F.coalesce("component", "rep").alias("component_id"))
    return sets.select("doc_id", "n", "fp_a", "fp_b").join(named, ["fp_a", "fp_b", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The documents whose doc_id is the smallest of their component; all columns stay. Rows that share a doc_id stay or go together."""
    out = jaccard_components(docs, width, percent, text).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(small(checkpointed(out)), "doc_id", "left_anti").select(*called(docs.columns))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)


#: The same rows by brute force.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS node, doc_id AS to_id FROM documents UNION SELECT r.node, l.b FROM reached r JOIN ways l ON r.to_id = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(to_id) AS component_id FROM reached GROUP BY node) c ON c.node = d.doc_id
"""
