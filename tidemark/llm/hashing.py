"""Words and tokens of many texts at once: runs found and hashed with numpy, never one by one."""
from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPAN = 1 << 20                 # positions hashed at once
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over all output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_POWERS.get("up", ()))
    if have < n:
        n = max(n, 2 * have, _SPAN + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, U64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]. ``values`` are random 64-bit letters; runs are ascending and disjoint.

    A polynomial in an odd base modulo 2**64: prefix sums give any run, the inverse base moves it to position 0.
    """
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(values[a:b] * up[:b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWERED = _BYTES[_LOWER]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(hash of every word, bounds per text, (bytes, starts, ends)); words are runs without blanks, A-Z may count as a-z.

    Text i owns words bounds[i]:bounds[i + 1]. Null counts as empty.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    letters = (_LOWERED if lower else _BYTES)[data]
    return hash_runs(letters, starts, ends), np.searchsorted(starts, offsets), (data, starts, ends)


_NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def letter_words(texts: list[str], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words without signs, one column for the word and one for each prefix length in bytes; bounds per text)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _NO_LETTER[data])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    letters = _LOWERED[data]
    columns = [hash_runs(letters, starts, ends)]
    columns += [hash_runs(letters, starts, np.minimum(ends, starts + p)) ^ U64(p) for p in prefixes]
    offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    return np.stack(columns, 1) if len(starts) else np.empty((0, 1 + len(prefixes)), U64), np.searchsorted(starts, offsets)
