"""Packing of token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, id_columns, in_text_batches, table, text_of

#: Pieces that are packed together, and the longest piece that a document's remainder is cut into.
BLOCK_PIECES, PIECE_TOKENS = 1024, 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class ByteEncoder:
    """The ids of a text as little-endian unsigned 32-bit numbers."""

    #: White space so long that the pattern's look-ahead would exhaust its stack on it.
    long_space = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from .token_counts import byte_symbols

        code = {s: b for b, s in enumerate(byte_symbols())}
        self.ranks = {bytes(code[c] for c in x): n for x, n in spec["model"]["vocab"].items()}
        # The public pattern of byte-level BPE with use_regex.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @cached_property
    def whole(self):
        """Merges all that it is given as one word."""
        import tiktoken

        return tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})

    @staticmethod
    def numbers(encoding, text: str) -> bytes:
        return encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def plain(self, text: str) -> bytes:
        """Long white space is a word by itself but for its last character, which belongs to what follows, as the pattern has it."""
        out, at = [], 0
        if len(text) >= 10000:
            for run in self.long_space.finditer(text):
                end = run.end() - (run.end() < len(text))
                out += [self.numbers(self.encoding, text[at : run.start()]), self.numbers(self.whole, text[run.start() : end])]
                at = end
        out.append(self.numbers(self.encoding, text[at:] if at else text))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """A special token's string in the text becomes its id, as the library does by default."""
        if self.special_split and any(s in text for s in self.special):
            return b"".join(self.special.get(x) or self.plain(x) for x in self.special_split.split(text))
        return self.plain(text)


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One for each Python worker."""
    return ByteEncoder(path)


def cut(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full windows first, then the remainder in near-equal pieces."""
    full = n // capacity * capacity
    out = [(s, capacity) for s in range(0, full, capacity)]
    rest = n - full
    if rest:
        k = -(-rest // piece)
        ends = [full + rest * i // k for i in range(k + 1)]
        out += [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]
    return out


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The indexes of sizes dealt into k sets of near-equal sums.

    Karmarkar-Karp: each size starts as a partition with one set that isn't empty; the two partitions of
    the largest spread are merged again and again, the largest set of one with the smallest of the other.
    Only sets that aren't empty are kept, so a merge costs what the smaller partition has.
    """
    # A partition: ascending sums of its sets (those not listed are empty), and the sets.
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, sums_a, sets_a = heapq.heappop(heap)
        _, _, sums_b, sets_b = heapq.heappop(heap)
        if len(sums_a) < len(sums_b):
            sums_a, sets_a, sums_b, sets_b = sums_b, sets_b, sums_a, sets_a
        # b's largest set meets a's smallest: an empty one as long as there are some.
        free = k - len(sums_a)
        pairs = list(zip(sums_a, sets_a, strict=True))
        for j, (s, x) in enumerate(zip(reversed(sums_b), reversed(sets_b), strict=True)):
            if j < free:
                pairs.append((s, x))
            else:
                t, y = pairs[j - free]
                pairs[j - free] = (t + s, y + x)
        pairs.sort(key=lambda p: p[0])
        sums, sets = [p[0] for p in pairs], [p[1] for p in pairs]
        count += 1
        least = sums[0] if len(sums) == k else 0
        heapq.heappush(heap, (least - sums[-1], count, sums, sets))
    return heap[0][3] if heap else []


def pack_block(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity tokens: as few as the total allows, one more while a window is too full."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        windows = differencing(lengths, k)
        worst = max((sum(lengths[i] for i in w) for w in windows), default=0)
        if worst <= capacity:
            return windows
        k += max(1, k * (worst - capacity) // (4 * capacity))


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, piece: int, keep_ids: bool, text: str = "text") -> DataFrame:
    """A row for each piece of each document's ids."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, none, t in zip(batch["doc_id"], batch["_no_id"], batch["_text"], strict=True):
                ids = encoder.encode(t) + end
                doc = None if none else doc
                for start, length in cut(len(ids) // 4, capacity, piece):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(part), len(ids) // 4, part if keep_ids else None))
            out = pd.DataFrame([r[1:] for r in rows], columns=[x.split()[0] for x in PIECES.split(", ")][1:])
            out.insert(0, "doc_id", pd.array([r[0] for r in rows], dtype="Int64"))
            yield out

    return in_text_batches(docs).select(*id_columns(), text_of(text).alias("_text")).mapInPandas(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 1, piece: int = PIECE_TOKENS, block: int = BLOCK_PIECES, keep_ids: bool = False, text: str = "text") -> DataFrame:
    """A row for each piece of a document: where it lies in the document, and where in which sequence.

    docs: doc_id and text (null: empty); tokenizer: the path of a byte-level BPE file on every worker;
    end_id is added to each document. Ids that fill a window make one; a document's remainder is cut into
    near-equal pieces of at most `piece` tokens, and blocks of about `block` pieces, drawn by a
    hash, are packed by themselves with Karmarkar-Karp differencing, so no task holds more than a block. A
    block's windows are near-equal and not quite full; keep_ids adds the ids as bytes.

    A document without ids (an empty text and no end_id) has no piece; repeated rows are packed
    each; extra columns of docs are left out. Pieces of equal length lie in the order of doc_id and start; without rows
    the result is empty. A very long text is cut into windows as it is; white space of any length is one word.
    """
    pieces = checkpointed(encode_pieces(docs, tokenizer, end_id, capacity, piece, keep_ids, text))
    blocks = max(1, -(-pieces.count() // block))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(blocks)))
    dealt = dealt.withColumn("_no_id", F.col("doc_id").isNull()).fillna(0, ["doc_id"])
    columns = [f for f in PIECES.split(", ")]

    def windows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], kind="stable", ignore_index=True)
        lengths = rows["length"].tolist()
        free = [i for i, n in enumerate(lengths) if n < capacity]
        sets = [[free[i] for i in w] for w in pack_block([lengths[i] for i in free], capacity)] if free else []
        sets += [[i] for i, n in enumerate(lengths) if n >= capacity]
        sequence, offset = np.zeros(len(rows), "int64"), np.zeros(len(rows), "int64")
        for w, members in enumerate(sets):
            at = 0
            for i in members:
                sequence[i], offset[i] = key[0] << 32 | w, at
                at += lengths[i]
        return rows.drop(columns="_block").assign(sequence_id=sequence, offset=offset)

    packed = dealt.groupBy("_block").applyInPandas(windows, ", ".join([*columns, "_no_id boolean", "sequence_id long", "offset long"]))
    packed = packed.withColumn("doc_id", F.when(~F.col("_no_id"), F.col("doc_id"))).drop("_no_id")
    return packed if keep_ids else packed.drop("ids")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
