"""Comparing token sets inside a task: rare words name the candidates, parity bitmaps bound the difference of two sets.

Two sets that overlap by ``threshold`` share at least (na + nb) * threshold / (1 + threshold) words, so whatever order the words
have, the first few words of one hold a word that is among the first few of the other. Words are put in order of how rare they
are, and only sets that meet there are looked at. A set's bitmap holds, per place, whether an odd number of its token hashes fall
there; the number of places in which two bitmaps differ is at most the number of tokens that only one of the sets has, at
most (na + nb) * (1 - threshold) / (1 + threshold) for similar sets. What the bound leaves is verified with all hashes.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 1 << 22                 # places of bitmaps that are counted at once
SLOTS = 1 << 20                 # hash slots in which words are counted to tell how rare they are
SLOT_ROW = 1 << 12            # slots whose counts travel in one row
MEETINGS = 1 << 21              # meetings on a word that are looked at together
PIECE = 1 << 19                 # pairs that are verified together
EDGES = np.array(sorted({int(np.ceil(2 ** (i / 8) - 1e-9)) for i in range(8 * 31)}), np.int64)    # sizes at which a class of sets begins, powers of two among them


def bitmaps(hashes: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    """One row of 64-bit words per set; ``bits`` is a power of two from 64."""
    n, step = len(bounds) - 1, max(1, CELLS // bits)
    out = np.empty((n, bits // 64), np.uint64)
    place = (hashes.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
    for a in range(0, n, step):
        b = min(n, a + step)
        rows = np.repeat(np.arange(b - a), np.diff(bounds[a:b + 1]))
        odd = np.bincount(rows * bits + place[bounds[a]:bounds[b]], minlength=(b - a) * bits).astype(np.uint8) & 1
        out[a:b] = np.packbits(odd.reshape(b - a, bits), axis=1, bitorder="little").view(np.uint64)
    return out


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """The bitmaps that fewer places would have given."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _limit(total: np.ndarray, threshold: float) -> np.ndarray:
    return np.floor(total * ((1 - threshold) / (1 + threshold)) + 1e-6).astype(np.int64)


def survivors(one: np.ndarray, n: int, by_word: np.ndarray, sizes: np.ndarray, lo: int, hi: int, threshold: float) -> np.ndarray:
    """Positions in lo..hi of the sets that may overlap enough with one set. ``by_word`` holds their bitmaps, a row per word."""
    if hi <= lo:
        return np.empty(0, np.int64)
    limit, words = _limit(sizes[lo:hi] + n, threshold), len(by_word)
    acc = np.zeros(hi - lo, np.uint16)
    stops = sorted({max(1, words // 2), max(1, 3 * words // 4), words})
    at, k = None, 0
    for stop in stops:
        while k < stop:
            row = by_word[k, lo:hi] if at is None else by_word[k, at + lo]
            acc += np.bitwise_count(row ^ one[k])
            k += 1
        near = np.flatnonzero(acc <= limit)
        at, acc, limit = near if at is None else at[near], acc[near], limit[near]
        if not len(at):
            break
    return at + lo


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... of all spans, one after the other."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())


def reach(n: np.ndarray, low: int, high: int, threshold: float) -> np.ndarray:
    """How many leading words of sets of ``n`` words must hold one that a similar set of low..high words also leads with; 0 if no size fits."""
    least = np.maximum(low, np.ceil(n * threshold - 1e-6))
    need = np.ceil((n + least) * (threshold / (1 + threshold)) - 1e-6)
    return np.where(least <= np.minimum(high, np.floor(n / threshold + 1e-6)), np.clip(n - need + 1, 0, n), 0).astype(np.int64)


def in_order(hashes: np.ndarray, bounds: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """32 bits of each set's hashes, words in rare slots first. ``ranks`` has a byte per slot; any ranks give an order that all sets share."""
    h = hashes.view(np.uint64)
    keys = (ranks[(h & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        keys[a:b].sort()
    return ((keys >> np.uint64(24)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def bytes_of(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a column of byte strings that hold numbers."""
    flat = pa.concat_arrays(column.cast(pa.large_binary()).chunks)
    bounds = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    values = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.empty(0, np.uint8)
    width = np.dtype(kind).itemsize
    return np.frombuffer(values.tobytes(), kind), (bounds - bounds[0]) // width


def as_bytes(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A column of byte strings from numbers that lie one after the other."""
    offsets = (bounds * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


@dataclass
class Sets:
    """A block of sets in order of size: sizes, leading words with their bounds, and bitmaps with a row per word."""
    sizes: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    maps: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Sets:
        """Columns, sorted by n: n, words, bits."""
        words, bounds = bytes_of(table["words"], np.uint32)
        maps, _ = bytes_of(table["bits"], np.uint64)
        return cls(table["n"].to_numpy().astype(np.int64), words, bounds, maps.reshape(table.num_rows, -1))


def _meetings(left: Sets, right: Sets | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per leading word of the left sets: where the right sets that lead with it begin and how many they are; and those sets."""
    def sorted_words(s: Sets):
        keys = (s.words.astype(np.uint64) << np.uint64(32)) | np.arange(len(s.words), dtype=np.uint64)
        keys.sort()
        return (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)

    asked, place = sorted_words(left)
    other, rows = (asked, place) if right is None else sorted_words(right)
    owner = np.repeat(np.arange(len((right or left).sizes)), np.diff((right or left).bounds))[rows]
    first = np.flatnonzero(np.concatenate(([True], other[1:] != other[:-1]))) if len(other) else np.empty(0, np.int64)
    last = np.concatenate((first[1:], [len(other)])).astype(np.int64) if len(other) else first
    start, count = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    if right is None:
        ends = np.repeat(last, last - first)
        start[place] = np.arange(len(asked)) + 1
        count[place] = ends - np.arange(len(asked)) - 1
    elif len(other):
        at = np.minimum(np.searchsorted(other[first], asked), len(first) - 1)
        met = other[first][at] == asked
        start[place], count[place] = first[at], np.where(met, last[at] - first[at], 0)
    return start, count, owner


def close_pairs(left: Sets, right: Sets | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of two blocks, or of one, that share a leading word and whose bitmaps do not rule them out.

    Where frequent words would make more meetings than there are pairs to look at, all pairs of fitting sizes are looked at instead.
    """
    other = left if right is None else right
    words = min(left.maps.shape[1], other.maps.shape[1])
    maps, by_word = fold(left.maps, words), np.ascontiguousarray(fold(other.maps, words).T)
    lo = np.searchsorted(other.sizes, np.ceil(left.sizes * threshold - 1e-6), "left")
    hi = np.searchsorted(other.sizes, np.floor(left.sizes / threshold + 1e-6), "right")
    if right is None:
        lo = np.maximum(lo, np.arange(len(lo)) + 1)
    hi = np.maximum(lo, hi)
    start, count, owner = _meetings(left, right)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    if 40 * count.sum() > (hi - lo).sum() * words + 40_000 * len(lo):                    # nanoseconds, roughly
        for i in range(len(lo)):
            near = survivors(maps[i], int(left.sizes[i]), by_word, other.sizes, int(lo[i]), int(hi[i]), threshold)
            if len(near):
                found.append((np.full(len(near), i), near))
    else:
        own_by_word = np.ascontiguousarray(maps.T)
        upto = np.concatenate(([0], np.cumsum(count)))[left.bounds]                      # meetings before each set
        i = 0
        while i < len(lo):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + MEETINGS, "right")) - 1)
            a, b = left.bounds[i], left.bounds[j]
            if upto[j] > upto[i]:
                per_set = np.repeat(np.arange(i, j), upto[i + 1:j + 1] - upto[i:j])
                met = owner[spans(start[a:b], count[a:b])]
                fits = (met >= lo[per_set]) & (met < hi[per_set])
                keys = (per_set[fits] << 32) | met[fits]
                keys.sort()
                keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
                one, two = keys >> 32, keys & 0xFFFFFFFF
                limit, acc, k = _limit(left.sizes[one] + other.sizes[two], threshold), np.zeros(len(keys), np.uint16), 0
                for stop in sorted({max(1, words // 2), max(1, 3 * words // 4), words}):
                    while k < stop:
                        acc += np.bitwise_count(own_by_word[k][one] ^ by_word[k][two])
                        k += 1
                    near = acc <= limit
                    one, two, acc, limit = one[near], two[near], acc[near], limit[near]
                found.append((one, two))
            i = j
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def pieces(a: np.ndarray, b: np.ndarray, part_a: np.ndarray, part_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs cut by the parts of their sets, and to at most ``PIECE``."""
    key = part_a[a] * (int(part_b.max(initial=0)) + 1) + part_b[b]
    order = np.argsort(key, kind="stable")
    key, a, b = key[order], a[order], b[order]
    cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), [len(key)])) if len(key) else [0]
    for x, y in zip(cuts[:-1], cuts[1:]):
        for at in range(int(x), int(y), PIECE):
            yield a[at:min(at + PIECE, y)], b[at:min(at + PIECE, y)]


def shared_words(hashes: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the sets a[i] and b[i] share, counted whole: words that several sets hold get a bit each."""
    sets, shared = len(bounds) - 1, np.zeros(len(a), np.int64)
    if not len(a):
        return shared
    order = np.argsort(hashes, kind="stable")
    row = np.repeat(np.arange(sets), np.diff(bounds))[order]
    new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
    word = np.cumsum(new) - 1
    several = np.bincount(word)[word] > 1
    row, word = row[several], word[several]
    if not len(row):
        return shared
    word = np.cumsum(np.concatenate(([False], word[1:] != word[:-1])))
    step = max(64, (1 << 25) // sets // 64 * 64)
    for at in range(0, int(word[-1]) + 1, step):
        x, y = np.searchsorted(word, (at, at + step))
        held = np.zeros((sets, min(step, -(-(int(word[-1]) + 1 - at) // 64) * 64)), np.uint8)
        held[row[x:y], word[x:y] - at] = 1
        for bits in np.ascontiguousarray(np.packbits(held, axis=1).view(np.uint64).T):
            shared += np.bitwise_count(bits[a] & bits[b])
    return shared


def earliest_arrivals(times: np.ndarray, ids: pa.Array, bounds: np.ndarray, asker: np.ndarray, other: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Per arrival of an asking unit, the earliest arrival of the other units it is paired with, no more than ``span`` before it.

    Unit u has the arrivals bounds[u] to bounds[u + 1], ascending; ``ids`` decide between arrivals of one instant. Returns
    positions of arrivals and of what was found, without arrivals that found nothing.
    """
    moments = np.unique(times)
    width = len(moments) + 1
    unit = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keys = unit * width + np.searchsorted(moments, times)
    since = np.searchsorted(moments, times - span)
    ranks = np.empty(len(times), np.int64)
    ranks[pc.sort_indices(pa.table({"t": times, "id": ids}), [("t", "ascending"), ("id", "ascending")]).to_numpy()] = np.arange(len(times))
    best = np.full(len(times), len(times), np.int64)
    for x in range(0, len(asker), PIECE):
        ask, far = asker[x:x + PIECE], other[x:x + PIECE]
        count = bounds[ask + 1] - bounds[ask]
        asked, far = spans(bounds[ask], count), np.repeat(far, count)
        at = np.searchsorted(keys, far * width + since[asked])
        held = at < bounds[far + 1]
        asked, at = asked[held], at[held]
        held = times[at] <= times[asked]
        np.minimum.at(best, asked[held], ranks[at[held]])
    asked = np.flatnonzero(best < len(times))
    return asked, np.argsort(ranks)[best[asked]]
