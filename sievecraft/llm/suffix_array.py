"""Suffix arrays by two-stage sorting, and the common prefixes of neighbours, over a few passages at a time.

A suffix smaller than its successor (the suffix one place on) is sorted directly, all others are induced: when a sorted
suffix is passed, the one that begins a place before it goes to the next free place of its first symbol's bucket, if it is
the larger one.

The direct sort names the stretches between such suffixes by their symbols and sorts the sequence of names by doubling.
The scan takes a whole bucket at a time, as nothing it holds can change any more, up to runs of the bucket's own symbol,
which are laid out by length.
"""

from __future__ import annotations

import numpy as np

#: Symbols in one key of the first sort, and bits of each: a byte or a separator, and the type.
KEY_SYMBOLS, SYMBOL_BITS = 6, 10


class Passages:
    """Passages in a row, each followed by a separator that is smaller than every byte and equal to no other separator."""

    def __init__(self, passages: list[bytes]) -> None:
        self.data = b"\0".join([*passages, b""])
        sizes = np.fromiter(map(len, passages), np.int64, len(passages))
        self.separators = np.cumsum(sizes + 1) - 1
        self.starts = self.separators - sizes
        self.symbols = np.frombuffer(self.data, np.uint8).astype(np.int16) + np.int16(1)
        self.symbols[self.separators] = 0

    def left(self) -> np.ndarray:
        """Bytes from each place to the end of its passage."""
        ends = np.repeat(self.separators, self.separators - self.starts + 1)
        return ends - np.arange(len(self.symbols))


def smaller_than_successor(symbols: np.ndarray) -> np.ndarray:
    """By place, whether its suffix is smaller than the next one; the last one is."""
    ends = np.append(np.flatnonzero(symbols[1:] != symbols[:-1]), len(symbols) - 1)
    lengths = np.diff(ends, prepend=-1)
    of_run = np.append(symbols[ends[:-1]] < symbols[ends[:-1] + 1], True)
    return np.repeat(of_run, lengths)


def refined(rank: np.ndarray, among: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Orders ``among`` (whole groups of equal rank) by key within their groups; returns those that are still not alone.

    A rank is the number of items before its group.
    """
    if not len(among):
        return among
    old = rank[among]
    order = np.lexsort((key, old))
    among, old, key = among[order], old[order], key[order]
    at = np.arange(len(among))
    new_group = np.concatenate([[True], old[1:] != old[:-1]])
    new = new_group | np.concatenate([[True], key[1:] != key[:-1]])
    group_start = np.maximum.accumulate(np.where(new_group, at, 0))
    start = np.maximum.accumulate(np.where(new, at, 0))
    rank[among] = old + start - group_start
    alone = new & np.append(new[1:], True)
    return among[~alone]


def directly_sorted(text: Passages, small: np.ndarray) -> np.ndarray:
    """The places in ``small``'s true positions, in the order of their suffixes."""
    symbols, places = text.symbols, np.flatnonzero(small)
    # symbols with types: a stretch that ends at a smaller suffix differs from one that goes on with a larger one
    typed = symbols.astype(np.int64) * 2 + small
    typed = np.concatenate([typed, np.zeros(KEY_SYMBOLS, np.int64)])
    n = len(symbols)
    two = (typed[:-1] << SYMBOL_BITS) | typed[1:]
    four = (two[: n + 2] << (2 * SYMBOL_BITS)) | two[2 : n + 4]
    six = (four[:n] << (2 * SYMBOL_BITS)) | two[4 : n + 4]
    length = np.diff(np.append(places, n - 1)) + 1

    def key_of(items: np.ndarray, chunk: int) -> np.ndarray:
        beyond = np.clip(KEY_SYMBOLS * (chunk + 1) - length[items], 0, KEY_SYMBOLS) * SYMBOL_BITS
        return (six[np.minimum(places[items] + KEY_SYMBOLS * chunk, n - 1)] >> beyond) << beyond

    rank = np.zeros(len(places), np.int64)
    # separators come first, each alone, in their order
    is_separator = symbols[places] == 0
    rank[is_separator] = np.arange(is_separator.sum())
    rank[~is_separator] = is_separator.sum()
    tied = refined(rank, np.flatnonzero(~is_separator), key_of(np.flatnonzero(~is_separator), 0))
    chunk = 1
    while True:
        longer = tied[length[tied] > KEY_SYMBOLS * chunk]
        if not len(longer):
            break
        # equal so far, so a group's stretches are all longer or all done
        done = tied[length[tied] <= KEY_SYMBOLS * chunk]
        tied = np.concatenate([done, refined(rank, longer, key_of(longer, chunk))])
        chunk += 1
    step = 1
    while len(tied):
        # the last stretch begins at the last separator, which is alone, so what is tied has a successor
        tied = refined(rank, tied, rank[tied + step])
        step *= 2
    out = np.empty(len(places), np.int64)
    out[rank] = places
    return out


def suffix_array(text: Passages) -> np.ndarray:
    """All places in the order of their suffixes."""
    symbols = text.symbols
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    small = smaller_than_successor(symbols)
    sorted_small = directly_sorted(text, small)
    sizes = np.bincount(symbols, minlength=257)
    first = np.cumsum(sizes) - sizes
    larger = sizes - np.bincount(symbols[small], minlength=257)
    free = first.copy()
    out = np.empty(n, np.int64)
    # of one symbol, the larger-than-successor suffixes come before the smaller ones
    at = np.cumsum(sizes - larger) - (sizes - larger)
    of_small = symbols[sorted_small]
    out[first[of_small] + larger[of_small] + np.arange(len(sorted_small)) - at[of_small]] = sorted_small
    run_start = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    run_start = np.repeat(run_start, np.diff(np.append(run_start, n)))
    for symbol in np.flatnonzero(sizes).tolist():
        low = first[symbol]
        seeds = out[low : free[symbol]]
        before = seeds - run_start[seeds]
        if before.any():
            # the seeds, then those one place before them within their run, then two places, ...
            which = np.repeat(np.arange(len(seeds)), before + 1)
            back = np.arange(len(which)) - np.repeat(np.cumsum(before + 1) - before - 1, before + 1)
            order = np.argsort(back, kind="stable")
            out[low : low + len(order)] = seeds[which[order]] - back[order]
            free[symbol] = low + len(order)
        bucket = out[low : low + sizes[symbol]]
        previous = bucket[bucket > 0] - 1
        previous = previous[symbols[previous] > symbol]
        if not len(previous):
            continue
        to = symbols[previous]
        order = np.argsort(to, kind="stable")
        previous, to = previous[order], to[order]
        counts = np.bincount(to, minlength=257)
        inside = np.arange(len(to)) - (np.cumsum(counts) - counts)[to]
        out[free[to] + inside] = previous
        free += counts
    return out


def common_prefixes(text: Passages, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By place: the place before it in the order (-1 for none), and how long their common prefix is.

    Only places whose predecessors differ are compared; from one place to the next a common prefix shrinks by one.
    """
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    left, symbols = text.left(), text.symbols
    inner = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    same = symbols[inner - 1] == symbols[before[inner] - 1]
    same &= symbols[inner - 1] > 0
    compared = np.ones(n, bool)
    compared[inner[same]] = False
    compared[before < 0] = True
    places = np.flatnonzero(compared & (before >= 0))
    length = np.zeros(n, np.int64)
    length[places] = _compared(text.data, places, before[places], np.minimum(left[places], left[before[places]]))
    last = np.maximum.accumulate(np.where(compared, np.arange(n), 0))
    length = length[last] - (np.arange(n) - last)
    length[before < 0] = 0
    return before, length


def _compared(data: bytes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes from ``a`` and ``b`` on, at most ``most``."""
    padded = data + b"\0" * 8
    eight = np.ndarray((len(data),), "<u8", padded, 0, (1,))
    out = np.zeros(len(a), np.int64)
    left = np.flatnonzero(most > 0)
    while len(left) > 64:
        at = out[left]
        differ = eight[a[left] + at] ^ eight[b[left] + at]
        lowest = differ & (~differ + np.uint64(1))
        # the place of the lowest bit that differs, in bytes; a power of two is exact as a float
        equal = np.where(differ == 0, 8, (np.frexp(lowest.astype(np.float64))[1] - 1) >> 3)
        out[left] = np.minimum(at + equal, most[left])
        left = left[(equal == 8) & (out[left] < most[left])]
    for i in left.tolist():
        x, y, top, same, step = int(a[i]), int(b[i]), int(most[i]), int(out[i]), 64
        while same < top and step:
            size = min(step, top - same)
            if data[x + same : x + same + size] == data[y + same : y + same + size]:
                same += size
                step *= 2
            elif size == 1:
                break
            else:
                # the difference lies within: go on with smaller steps
                top, step = same + size, size // 2
        out[i] = same
    return out
