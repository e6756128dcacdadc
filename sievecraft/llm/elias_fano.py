"""Monotone sequences in Elias-Fano form, and a two-level n-gram trie made of them, in one flat buffer.

Everything is little-endian arrays behind a small header, so that a buffer can be a file's memory map or a shared
anonymous one, and nothing has to be unpacked to be asked.
"""

from __future__ import annotations

import mmap

import numpy as np

#: By byte and k: the place of the k-th 0 bit.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)
_ZERO_AT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    _z = np.flatnonzero(_BITS[_b] == 0)
    _ZERO_AT[_b, : len(_z)] = _z
_ZEROS = (8 - _BITS.sum(axis=1)).astype(np.int64)


def in_parts(answer, asked: np.ndarray, size: int = 1 << 15) -> np.ndarray:
    """``answer`` of the array in parts, as its working memory is many times the part."""
    if len(asked) <= size:
        return answer(asked)
    return np.concatenate([answer(asked[i : i + size]) for i in range(0, len(asked), size)])


class Monotone:
    """A non-decreasing sequence of unsigned numbers: low bits as they are, high bits in unary."""

    def __init__(self, low_bits: int, low: np.ndarray, high: np.ndarray, size: int) -> None:
        self.low_bits, self.low, self.high, self.size = low_bits, low, high, size
        # zeros before each 64-bit word of the upper part
        zeros = _ZEROS[high].reshape(-1, 8).sum(axis=1) if len(high) else np.empty(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(zeros)])
        self.ranks = np.concatenate([[0], np.cumsum(64 - zeros)])

    @classmethod
    def of(cls, values: np.ndarray) -> Monotone:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shift = np.uint64(low_bits)
        kind = np.dtype(f"<u{1 if low_bits <= 8 else 2 if low_bits <= 16 else 4 if low_bits <= 32 else 8}")
        low = (values & np.uint64((1 << low_bits) - 1)).astype(kind)
        ones = (values >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-((top >> low_bits) + n + 2) // 64) * 64, np.uint8)
        bits[ones] = 1
        return cls(low_bits, low, np.packbits(bits, bitorder="little"), n)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th 0 bit of the upper part (from 0)."""
        word = np.searchsorted(self.before, k, side="right") - 1
        rest = k - self.before[word]
        octets = self.high.reshape(-1, 8)[word]
        running = np.cumsum(_ZEROS[octets], axis=1)
        octet = (running <= rest[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        inside = rest - np.where(octet > 0, running[rows, octet - 1], 0)
        return word * 64 + octet * 8 + _ZERO_AT[octets[rows, octet], inside]

    def find(self, targets: np.ndarray) -> np.ndarray:
        """Place of the first value of at least each target; the sequence's length where there is none."""
        return in_parts(self._find, targets)

    def get(self, places: np.ndarray) -> np.ndarray:
        """The values at these places."""
        return in_parts(self._get, places)

    def _find(self, targets: np.ndarray) -> np.ndarray:
        targets = targets.astype(np.uint64)
        if not self.size or not len(targets):
            return np.full(len(targets), self.size)
        bucket = (targets >> np.uint64(self.low_bits)).astype(np.int64)
        over = bucket >= int(self.before[-1])
        bucket = np.where(over, 0, bucket)
        # values with these high bits lie between two zeros
        stop = self._zero(bucket) - bucket
        start = np.where(bucket > 0, self._zero(np.maximum(bucket - 1, 0)) - bucket + 1, 0)
        wanted = targets & np.uint64((1 << self.low_bits) - 1)
        # halve what is left of each bucket; most hold a value or two
        at, left = start, np.flatnonzero(start < stop)
        while len(left):
            middle = (at[left] + stop[left]) // 2
            less = self.low[middle].astype(np.uint64) < wanted[left]
            at[left[less]] = middle[less] + 1
            stop[left[~less]] = middle[~less]
            left = left[at[left] < stop[left]]
        return np.where(over, self.size, at)

    def _get(self, places: np.ndarray) -> np.ndarray:
        ranks = self.ranks
        word = np.searchsorted(ranks, places, side="right") - 1
        bits = np.unpackbits(self.high.reshape(-1, 8)[word], axis=1, bitorder="little")
        rest = places - ranks[word]
        at = (np.cumsum(bits, axis=1, dtype=np.uint8) <= rest[:, None]).sum(axis=1)
        high = (word * 64 + at - places).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self.low[places].astype(np.uint64)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.low_bits, self.size], "<u8"), self.low, self.high]

    @classmethod
    def from_arrays(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray) -> Monotone:
        return cls(int(head[0]), low, high, int(head[1]))


#: Steps of a quantised logarithm to base 10.
STEPS = 4096


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEPS), 0, (1 << 16) - 1).astype("<u2")


def restored(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / -STEPS


class Trie:
    """Words, and after each word the words that follow it, with quantised probabilities.

    Level 1: sorted word hashes, counts, log probability and back-off of each word. Level 2: for each context the sorted
    numbers of its successors, made monotone over the whole level by adding what the contexts before it end with; where a
    context begins is a monotone pointer. A successor is found by one search relative to its context.
    """

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.words = Monotone.from_arrays(*arrays[0:3])
        self.pointers = Monotone.from_arrays(*arrays[3:6])
        self.followers = Monotone.from_arrays(*arrays[6:9])
        self.counts, self.log1, self.back, self.log2, self.bases = arrays[9:14]

    @classmethod
    def build(
        cls, words: np.ndarray, counts: np.ndarray, log1: np.ndarray, back: np.ndarray,
        context: np.ndarray, follower: np.ndarray, log2: np.ndarray,
    ) -> bytes:
        """``words`` sorted; pairs sorted by context, then follower, which are places in ``words``.

        A context one past the last word is the start of a text.
        """
        starts = np.searchsorted(context, np.arange(len(words) + 2))
        last = np.zeros(len(words) + 1, np.int64)
        some = starts[1:] > starts[:-1]
        last[some] = follower[starts[1:][some] - 1] + 1
        bases = np.concatenate([[0], np.cumsum(last)])[:-1]
        parts = [
            *Monotone.of(words).arrays(), *Monotone.of(starts).arrays(),
            *Monotone.of(follower + bases[context]).arrays(),
            counts.astype("<u8"), quantised(log1), quantised(back), quantised(log2), bases.astype("<u8"),
        ]
        head = [len(parts)]
        for p in parts:
            head += [{"|u1": 1, "<u1": 1, "<u2": 2, "<u4": 4, "<u8": 8}[p.dtype.str], p.nbytes]
        out = [np.array(head, "<u8").tobytes()]
        for p in parts:
            data = p.tobytes()
            out.append(data + b"\0" * (-len(data) % 8))
        return b"".join(out)

    @classmethod
    def map(cls, buffer: bytes | mmap.mmap | memoryview) -> Trie:
        """A trie over a buffer, which is not copied."""
        n = int(np.frombuffer(buffer, "<u8", 1)[0])
        head = np.frombuffer(buffer, "<u8", 2 * n, 8).reshape(-1, 2)
        at, arrays = 8 + 16 * n, []
        for width, size in head.tolist():
            arrays.append(np.frombuffer(buffer, f"<u{width}", size // width, at))
            at += size + -size % 8
        return cls(arrays)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in level 1; the number of words where there is none."""
        at = self.words.find(hashes)
        inside = at < self.words.size
        same = np.zeros(len(at), bool)
        same[inside] = self.words.get(at[inside]) == hashes[inside]
        return np.where(same, at, self.words.size)

    def log10(self, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """log10 P(follower | context), backing off to the follower alone."""
        out = restored(self.back)[context] + restored(self.log1)[follower]
        if self.followers.size:
            wanted = follower.astype(np.uint64) + self.bases[context]
            at = self.followers.find(wanted)
            start, stop = self.pointers.get(context), self.pointers.get(context + 1)
            hit = (at >= start.astype(np.int64)) & (at < stop.astype(np.int64))
            hit[hit] = self.followers.get(at[hit]) == wanted[hit]
            out[hit] = restored(self.log2)[at[hit]]
        return out


def anonymous_map(data: bytes) -> mmap.mmap:
    """The buffer in pages of its own, as a mapped file's would be."""
    pages = mmap.mmap(-1, max(len(data), 1))
    pages[: len(data)] = data
    return pages
