"""Token counts by byte-pair merging with a heap over a linked list; identifiers are never made."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_text_batches, table, text_of

#: Entries that a worker's memory of counted words may have; it is emptied when full.
MEMORY_ENTRIES = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for the characters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of words under the merge list of a tokenizer file (its `model`, word ends marked)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        end = spec["model"]["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        number: dict[str, int] = {}
        for x in (*spec["model"]["vocab"], *(a + b for a, b in merges), *(s + e for s in byte_symbols() for e in ("", end))):
            number.setdefault(x, len(number))
        #: (left << 20 | right) -> rank, and by rank the symbol that the merge makes.
        self.rank = {}
        self.made = []
        for k, (a, b) in enumerate(merges):
            self.rank.setdefault(number[a] << 20 | number[b], k)
            self.made.append(number[a + b])
        self.inner = [number[s] for s in byte_symbols()]
        self.last = [number[s + end] for s in byte_symbols()]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.path, self.pattern = path, spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.known: dict[str, int] = {}
        self.chunks = _Memory(self.count_chunk)

    def count_word(self, word: bytes) -> int:
        """Symbols of the word minus merges: the pair of lowest rank, leftmost first, is merged again and again."""
        n = len(word)
        symbols = [self.inner[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        rank_of, made = self.rank.get, self.made
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbols[i] << 20 | symbols[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= n or rank_of(symbols[i] << 20 | symbols[j]) != r:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = made[r], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank_of(symbols[i] << 20 | symbols[k])) is not None:
                    heapq.heappush(heap, s << 32 | i)
            if (h := before[i]) >= 0 and (s := rank_of(symbols[h] << 20 | symbols[i])) is not None:
                heapq.heappush(heap, s << 32 | h)
        return left

    @cached_property
    def newer(self):
        """Words of a text with characters that Python's tables don't have yet: normalised and split by the library, whose tables are of another version."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        normalizer, split = Tokenizer.from_file(self.path).normalizer, pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        return lambda text: [word for word, _ in split.pre_tokenize_str(normalizer.normalize_str(text))]

    def split(self, text: str) -> list[str]:
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in text):
            return self.newer(text)
        text = unicodedata.normalize("NFC", text)
        # Each character is lower-cased by itself: the form of a final sigma does not depend on what follows.
        return self.words.findall("".join(c.lower() for c in text) if "Σ" in text else text.lower())

    def count_plain(self, text: str) -> int:
        known, total = self.known, 0
        for word in self.split(text):
            if (n := known.get(word)) is None:
                n = self.count_word(word.encode())
                if len(known) >= MEMORY_ENTRIES:
                    known.clear()
                known[word] = n
            total += n
        return total

    def count_chunk(self, chunk: bytes) -> int:
        """chunk has no ASCII white space. A special token's string in it counts as one token."""
        text = chunk.decode()
        if self.special_split and "<" in text and (n := len(self.special_split.findall(text))):
            return n + sum(map(self.count_plain, self.special_split.split(text)))
        return self.count_plain(text)

    def count(self, text: bytes) -> int:
        """No token holds white space, so what stands between ASCII white space is counted by itself and remembered."""
        return sum(map(self.chunks.__getitem__, text.split()))


class _Memory(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key: bytes) -> int:
        if len(self) >= MEMORY_ENTRIES:
            self.clear()
        n = self.make(key)
        if len(key) <= 64:
            self[key] = n
        return n


@lru_cache(maxsize=2)
def merge_counter(path: str) -> MergeCounter:
    """One for each Python worker."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit.

    tokenizer: the path of a byte-level BPE file with word ends, on every worker. A null text counts as
    an empty one: no bytes, no tokens. Columns of docs with the new names are replaced, others stay. Rows are returned each, repeated ones too, and
    no rows give none. A text of exactly limit tokens isn't over it. Texts of any
    length are counted whole, in time n log n of their longest word; of pairs of equal rank the leftmost is merged first.
    """

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = merge_counter(tokenizer)
        for texts in batches:
            yield pd.Series([counter.count(t.encode("utf-8", "surrogatepass")) for t in texts], dtype="int64")

    return (
        in_text_batches(docs).withColumn("n_bytes", F.octet_length(text_of(text)).cast("long"))
        .withColumn("n_tokens", tokens(text_of(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
