"""MD5 of many short texts at once, in numpy: what `names.hash_order` orders by, for Python workers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

#: Texts that are hashed together, so that the registers stay in a core's cache.
CHUNK = 32768
SHIFTS = [(np.array(s, np.uint32), np.array(32 - s, np.uint32)) for turn in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in turn * 4]
PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


class Endings:
    """Texts that end a message; their words are kept for each of the four places in a word where they may start."""

    def __init__(self, texts: np.ndarray, lengths: np.ndarray):
        """texts: bytes of a fixed width, filled up with zeros."""
        self.lengths = lengths.astype(np.uint32)
        width = texts.dtype.itemsize
        self._bytes = np.zeros((len(texts), width + 8), np.uint8)
        self._bytes[:, :width] = np.ascontiguousarray(texts).view(np.uint8).reshape(len(texts), width)
        self._bytes[np.arange(len(texts)), lengths] = 0x80
        self._words: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, texts: Sequence[bytes]) -> Endings:
        return cls(np.array(texts, dtype=f"S{max(1, *map(len, texts), 1)}"), np.array([len(t) for t in texts]))

    @classmethod
    def of_numbers(cls, numbers: np.ndarray) -> Endings:
        texts = numbers.astype("S20")
        return cls(texts, np.strings.str_len(texts))

    def words(self, offset: int) -> np.ndarray:
        if offset not in self._words:
            width = self._bytes.shape[1]
            placed = np.zeros((len(self._bytes), (offset + width + 3) // 4 * 4), np.uint8)
            placed[:, offset : offset + width] = self._bytes
            self._words[offset] = np.ascontiguousarray(placed.view("<u4").T)
        return self._words[offset]


def _block(state: Sequence, words: Sequence, n: int) -> list[np.ndarray]:
    """The state after 16 words of each of n messages; a word is a number for all or an array."""
    a, b, c, d, f, g = np.empty((6, n), np.uint32)
    for register, s in zip((a, b, c, d), state):
        register[:] = s
    xor, both, either, plus = np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.add
    for i in range(64):
        word, (left, right) = words[PLACES[i]], SHIFTS[i]
        if i < 16:
            xor(c, d, f), both(f, b, f), xor(f, d, f)
        elif i < 32:
            xor(b, c, f), both(f, d, f), xor(f, c, f)
        elif i < 48:
            xor(b, c, f), xor(f, d, f)
        else:
            np.invert(d, f), either(f, b, f), xor(f, c, f)
        plus(f, a, f)
        if isinstance(word, np.ndarray):
            plus(f, word, f)
            word = 0
        plus(f, np.array((SINES[i] + word) % 2**32, np.uint32), f)
        np.left_shift(f, left, g), np.right_shift(f, right, f), either(f, g, f)
        plus(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    return [x + np.asarray(s, np.uint32) for x, s in zip((a, b, c, d), state)]


def digests(starts: np.ndarray, counts: np.ndarray, endings: Endings, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the MD5 of each message, as numbers in the order of its hex digits.

    starts(k, p) are bytes that begin messages, all p long; the first counts[0] messages begin with starts[0], and so on, and message i ends with the text picked[i] of the endings.
    """
    k, p = starts.shape
    n, whole, offset = len(picked), p // 4, p % 4
    padded = np.zeros((k, (whole + 1) * 4), np.uint8)
    padded[:, :p] = starts
    begin, ends, owner = padded.view("<u4"), endings.words(offset), np.repeat(np.arange(k), counts)
    halves = np.empty((n, 4), "<u4")
    for at in range(0, n, CHUNK):
        who, what = owner[at : at + CHUNK], picked[at : at + CHUNK]
        length = endings.lengths[what] + np.uint32(p)
        blocks = (length + 72) // 64
        least, most = int(blocks.min()), int(blocks.max())
        for size in range(least, most + 1):
            here = slice(None) if least == most else np.flatnonzero(blocks == size)
            w, e, last = who[here], what[here], 16 * size - 2
            if not len(w):
                continue
            one = w[0] == w[-1]
            words = [int(begin[w[0], i]) if one else begin[w, i] for i in range(whole)] + [ends[j][e] for j in range(min(len(ends), last - whole))]
            words[whole] |= begin[w, whole]
            words += [0] * (last - len(words)) + [length[here] * np.uint32(8), 0]
            state: Sequence = START
            for i in range(size):
                state = _block(state, words[16 * i : 16 * i + 16], len(w))
            for out, s in zip((0, 1, 2, 3), state):
                halves[at : at + CHUNK, out][here] = s
    return halves[:, :2].view(">u8")[:, 0].astype(np.uint64), halves[:, 2:].view(">u8")[:, 0].astype(np.uint64)


def joined(texts: Sequence[bytes], length: int) -> np.ndarray:
    """Texts of one length as rows of bytes."""
    return np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), length)


def first_numbers(begins: Sequence[bytes], owner: np.ndarray, low: np.ndarray, high: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, range, number), by key: of the numbers from low to high of a key's ranges the first `count` by the MD5 of the key's beginning and the number; of equals the smaller number, then the earlier range.

    Range i belongs to key owner[i]. All numbers are hashed, CHUNK or so at a time; of each piece of a range its first ones are kept.
    """
    lengths, size = np.array([len(b) for b in begins]), high - low + 1
    least, most = int(low.min(initial=0)), int(high.max(initial=0))
    table = Endings.of_numbers(np.arange(least, most + 1)) if most - least < min(2**21, 4 * int(size.sum()) + 1) else None
    kept = []
    for p in np.unique(lengths[owner]):
        keys = np.flatnonzero(lengths == p)
        begin, ranges = joined([begins[k] for k in keys], int(p)), np.flatnonzero(lengths[owner] == p)
        parts = -(-size[ranges] // CHUNK)
        piece = np.repeat(ranges, parts)
        first = low[piece] + (np.arange(len(piece)) - np.repeat(np.cumsum(parts) - parts, parts)) * CHUNK
        counts = np.minimum(high[piece] - first + 1, CHUNK)
        edges = np.flatnonzero(np.diff((np.cumsum(counts) - 1) // CHUNK, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            n, starts = counts[a:b], np.cumsum(counts[a:b]) - counts[a:b]
            total = int(n.sum())
            numbers = np.arange(total) + np.repeat(first[a:b] - starts, n)
            endings, picked = (Endings.of_numbers(numbers), np.arange(total)) if table is None else (table, numbers - least)
            h, l = digests(begin[np.searchsorted(keys, owner[piece[a:b]])], n, endings, picked)
            at = _first_of_each(h, n, starts, count)
            kept.append((np.repeat(piece[a:b], n)[at], numbers[at], h[at], l[at]))
    if not kept:
        return (np.empty(0, np.int64),) * 3
    source, number, h, l = (np.concatenate(x) for x in zip(*kept))
    order = np.lexsort((source, number, l, h, owner[source]))
    source, number = source[order], number[order]
    key = owner[source]
    taken = np.arange(len(key)) - np.searchsorted(key, key) < count
    return key[taken], source[taken], number[taken]


def _first_of_each(h: np.ndarray, counts: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Places of the `count` smallest of each of the consecutive groups of h, in no order; all of a group whose leading bits don't tell which they are."""
    places, groups = max(1, (len(h) - 1).bit_length()), max(1, (len(counts) - 1).bit_length())
    group = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    packed = group << np.uint64(64 - groups) | h >> np.uint64(groups + places) << np.uint64(places) | np.arange(len(h), dtype=np.uint64)
    packed.sort()
    rank = np.arange(len(h)) - np.repeat(starts, counts)
    wanted = rank < count
    longer = np.flatnonzero(counts > count)
    last = starts[longer] + count
    equal = longer[packed[last - 1] >> np.uint64(places) == packed[last] >> np.uint64(places)]
    if len(equal):
        wanted |= np.isin(np.repeat(np.arange(len(counts)), counts), equal)
    return (packed[wanted] & np.uint64(2**places - 1)).astype(np.int64)


def least_others(ids: tuple[Sequence[bytes], np.ndarray, np.ndarray], others: tuple[Sequence[bytes], np.ndarray, np.ndarray], own: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, time, other, high, low): for each id and time of it the other one of that time whose text, after the id's, has the least MD5, with that; none where there is no other.

    Both sides have texts, offsets and times: entry i has times[offsets[i] : offsets[i + 1]]. An id's text begins the message; own[i] is its place among the others, or -1. Of equal hashes the first other counts.
    Each pair is hashed once, at however many times it meets.
    """
    (texts, offsets, times), (endings, ends, dates) = ids, others
    known = np.unique(dates)
    order = np.argsort(dates, kind="stable")
    present = np.repeat(np.arange(len(endings)), np.diff(ends))[order]
    edges = np.append(np.searchsorted(dates[order], known), len(dates))
    tails, lengths, size = Endings.of(endings), np.array([len(t) for t in texts]), len(endings)
    bits = np.uint64(max(1, (size - 1).bit_length()))
    owner, at = np.repeat(np.arange(len(texts)), np.diff(offsets)), np.searchsorted(known, times)
    hit = np.flatnonzero(np.append(known, known[:1])[at] == times) if len(known) else np.empty(0, np.int64)
    owner, at = owner[hit], at[hit]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    found, batch, total = [], [], 0

    def looked_up() -> None:
        counts = np.array([len(u) for _, u, _, _ in batch])
        high, low = digests(joined([texts[i] for i, *_ in batch], int(lengths[batch[0][0]])), counts, tails, np.concatenate([u for _, u, _, _ in batch]))
        stop = np.cumsum(counts)
        for (i, u, lists, starts), b in zip(batch, stop):
            h, l = high[b - len(u) : b], low[b - len(u) : b]
            won = _least_of_lists(h, l, lists, starts, np.flatnonzero(u == own[i]), bits)
            some = np.flatnonzero(won >= 0)
            won = won[some]
            found.append((np.full(len(some), i), hit[first[i] : first[i + 1]][some], u[won], h[won], l[won]))

    for i in np.argsort(lengths, kind="stable"):
        mine = at[first[i] : first[i + 1]]
        if not len(mine):
            continue
        lists = np.concatenate([present[edges[t] : edges[t + 1]] for t in mine])
        n = edges[mine + 1] - edges[mine]
        if len(lists) < size:
            u, lists = np.unique(lists, return_inverse=True)
        else:
            u = np.arange(size)
        if batch and lengths[i] != lengths[batch[0][0]]:
            looked_up()
            batch, total = [], 0
        batch.append((i, u, lists, np.cumsum(n) - n))
        total += len(u)
        if total >= CHUNK:
            looked_up()
            batch, total = [], 0
    if batch:
        looked_up()
    if not found:
        return np.empty(0, np.int64), times[:0], np.empty(0, np.int64), *(np.empty(0, np.uint64),) * 2
    who, place, other, high, low = (np.concatenate(x) for x in zip(*found))
    return who, times[place], other, high, low


def _least_of_lists(h: np.ndarray, l: np.ndarray, lists: np.ndarray, starts: np.ndarray, but: np.ndarray, bits: np.uint64) -> np.ndarray:
    """For each of consecutive lists of places its place with the least (h, l), of equals the first place, without the places `but`; -1 where there is none."""
    none = np.uint64(2**64 - 1)
    packed = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
    packed[but] = none
    least = np.minimum.reduceat(packed[lists], starts)
    real = least != none
    if real.any():
        most = least[real].max() | np.uint64(2 ** int(bits) - 1)
        near = np.sort(packed[packed <= most])
        if (near[1:] >> bits == near[:-1] >> bits).any():  # leading bits don't tell all: whole hashes are compared
            at = np.flatnonzero((packed <= most) & (packed != none))
            rank = np.full(len(h), len(h), np.int64)
            at = at[np.lexsort((at, l[at], h[at]))]
            rank[at] = np.arange(len(at))
            won = np.minimum.reduceat(rank[lists], starts)
            return np.where(won < len(at), at[np.minimum(won, len(at) - 1)], -1)
    return np.where(real, (least & np.uint64(2 ** int(bits) - 1)).astype(np.int64), -1)
