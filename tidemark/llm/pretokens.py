"""The split of a byte-level BPE tokenizer, done with numpy over many texts, and the encoding of single pieces.

The rule (contractions, letters, numbers, other signs, each with one space before, white space kept apart from the word
that follows) is the public one of byte-level BPE. Pieces never depend on their neighbours, so each distinct piece needs
encoding once.
"""
from __future__ import annotations

import json
import os

import numpy as np

from .hashing import U64, hash_runs, mix

BLANK, LETTER, NUMBER, SIGN, SPECIAL, BREAK = range(6)
_STATE: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and random letter of every code point; built once a process."""
    if "classes" not in _STATE:
        import regex

        every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        classes = np.full(0x110000, SIGN, np.uint8)
        for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, every):
                classes[m.start():m.end()] = k
        for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
            classes[a:b + 1] = BLANK
        _STATE["classes"] = classes
        _STATE["letters"] = mix(np.arange(1, 0x110001, dtype=U64) * U64(0xA0761D6478BD642F))
    return _STATE["classes"], _STATE["letters"]


def split(texts: list[str], specials: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray, str, np.ndarray, np.ndarray]:
    """(hash of every piece, bounds per text, all text, starts, ends). Piece j is all_text[starts[j]:ends[j]]."""
    classes, letters = _tables()
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = classes[cp]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    kind[offsets[1:] - 1] = BREAK
    new = np.empty(len(kind), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    for s in specials:
        at = joined.find(s)
        while at >= 0:
            kind[at:at + len(s)] = SPECIAL
            new[at:at + len(s) + 1] = False
            new[at] = new[at + len(s)] = True
            at = joined.find(s, at + len(s))
    new[offsets[1:] - 1] = True
    new[offsets[1:-1]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(kind))
    kinds = kind[start]
    after = np.append(kinds[1:], BREAK)
    wordlike = (kinds == LETTER) | (kinds == NUMBER) | (kinds == SIGN)
    # White space before a word gives up its last character: to the word if it is a space, else as a piece of its own.
    gives = (kinds == BLANK) & np.append(wordlike[1:], False)
    joins = gives & (cp[end - 1] == 32)
    tail_start = np.where(gives & ~joins, end - 1, end)
    first_end = np.where(gives, end - 1, end)
    first_start = start.copy()
    led = np.flatnonzero(joins) + 1
    # An apostrophe at a piece's start takes s, t, m, d, re, ve or ll from the letters that follow.
    lone = (kinds == SIGN) & (end - start == 1) & (cp[start] == 39) & (after == LETTER)
    lone[led] = False
    lone = np.flatnonzero(lone)
    if len(lone):
        a, b = cp[end[lone]], cp[np.minimum(end[lone] + 1, len(cp) - 1)]
        takes = np.where(np.isin(a, [115, 116, 109, 100]), 1, np.where(((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108), 2, 0))
        first_end[lone] += takes
        first_start[lone + 1] += takes
    first_start[led] -= 1
    s = np.stack((first_start, tail_start), 1).ravel()
    e = np.stack((first_end, end), 1).ravel()
    keep = (s < e) & np.repeat(kinds != BREAK, 2)
    s, e = s[keep], e[keep]
    return hash_runs(letters[cp], s, e), np.searchsorted(s, offsets), joined, s, e


class Pieces:
    """Encodes single pieces with the tokenizers library; ``spec`` is the JSON of a byte-level BPE tokenizer."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = {t["content"]: t["id"] for t in json.loads(spec).get("added_tokens", [])}
        self.tokenize = self.tokenizer.model.tokenize
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.visible = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}   # how the vocabulary writes bytes
        size = self.tokenizer.get_vocab_size()
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids per piece)."""
        flat, counts = [], []
        for p in pieces:
            if p in self.specials:
                ids = [self.specials[p]]
            else:
                ids = [t.id for t in self.tokenize(p.encode().decode("latin-1").translate(self.visible))]
            flat += ids
            counts.append(len(ids))
        return np.array(flat, self.width), np.array(counts, np.int64)

    def table(self) -> list[bytes]:
        """Bytes of every id: the id-to-piece table, as large as the vocabulary."""
        back = {c: b for b, c in self.visible.items()}
        out = [b""] * (max(self.tokenizer.get_vocab(True).values()) + 1)
        for piece, i in self.tokenizer.get_vocab(True).items():
            out[i] = piece.encode() if piece in self.specials else bytes(back[c] for c in piece)
        return out


def pieces_of(spec: str) -> Pieces:
    """One per process and tokenizer."""
    key = ("pieces", hash(spec))
    if key not in _STATE:
        _STATE[key] = Pieces(spec)
    return _STATE[key]


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0] + counts[0]], then the next run, and so on, in one array."""
    ends = np.cumsum(counts)
    at = np.repeat(starts - (ends - counts), counts)
    at += np.arange(len(at))
    return flat[at]


class Memory:
    """Ids of pieces seen by this process, found through two slots of the piece's hash. A cache: results never depend on it.

    A piece whose two slots are taken is encoded anew each time; when ``most`` pieces are held, all are forgotten.
    """

    def __init__(self, pieces: Pieces, most: int = 1_500_000, bits: int = 22):
        self.pieces, self.most, self.bits = pieces, most, bits
        self.clear()

    def clear(self) -> None:
        self.slots = [np.full(1 << self.bits, -1, np.int32) for _ in range(2)]
        self.hashes, self.starts, self.counts = np.zeros(1, U64), np.zeros(1, np.int64), np.zeros(1, np.int64)   # entry 0 is nobody's
        self.flat = np.empty(0, self.pieces.width)

    def _slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> U64(64 - self.bits * (k + 1))) & U64((1 << self.bits) - 1)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = self.slots[0][self._slot(h, 0)].astype(np.int64)
        miss = np.flatnonzero((at < 0) | (self.hashes[at] != h))
        second = self.slots[1][self._slot(h[miss], 1)].astype(np.int64)
        at[miss] = np.where((second >= 0) & (self.hashes[second] == h[miss]), second, -1)
        return at

    def _learn(self, h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.hashes)
        self.hashes, self.starts, self.counts = np.append(self.hashes, h), np.append(self.starts, starts), np.append(self.counts, counts)
        left = np.arange(n, n + len(h), dtype=np.int32)
        for k in (0, 1):
            slot = self._slot(self.hashes[left], k)
            free = self.slots[k][slot] < 0
            self.slots[k][slot[free]] = left[free]
            left = left[self.slots[k][slot] != left]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        h, bounds, joined, s, e = split(texts, tuple(self.pieces.specials))
        if len(self.hashes) > self.most:
            self.clear()
        at = self._find(h)
        miss = np.flatnonzero(at < 0)
        starts, counts = self.starts[at], self.counts[at]
        if len(miss):
            u, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            where = miss[first]
            flat, n = self.pieces.encode([joined[a:b] for a, b in zip(s[where].tolist(), e[where].tolist())])
            begin = len(self.flat) + np.cumsum(n) - n
            self.flat = np.concatenate((self.flat, flat))
            self._learn(u, begin, n)
            starts[miss], counts[miss] = begin[inverse], n[inverse]
        ids = gather(self.flat, starts, counts)
        ends = np.concatenate(([0], np.cumsum(counts)))[bounds]
        return ids, np.diff(ends)


def memory_of(spec: str) -> Memory:
    key = ("memory", hash(spec))
    if key not in _STATE:
        _STATE[key] = Memory(pieces_of(spec))
    return _STATE[key]
