"""Vector helpers over the bytes of many texts at once: word bounds and hashes.

A hash of a byte span is a polynomial in a fixed odd base over random byte codes,
taken from prefix sums, so that every span of a batch costs a few array passes.

Sums are modulo 2^64, where long spans of few different bytes can be built to collide
(their differences factor into many even numbers).  So `span_hashes` is only a key to
look up: who takes it for identity compares the bytes (`encode`), or uses `word_hashes`,
which takes long words from a cryptographic digest."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Space, and tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        step = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        size = max(n, 1 << 16)
        grown = np.full(size, step & _MASK, np.uint64)
        grown[0] = 1
        _powers[which] = have = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODES[buf] * _power("up", len(buf)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix((sums[ends] - sums[starts]) * _power("down", len(sums))[starts])


#: Longer words are hashed by digest.  Up to here no repetitive pair of words can lose
#: more than about half of the 64 bits.
_LONGEST = 64


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes that stand for the words of ``buf``: two words agree by chance only."""
    out = span_hashes(prefix_sums(buf), starts, ends)
    for i in np.flatnonzero(ends - starts > _LONGEST):
        raw = buf[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=b"words").digest(), "little")
    return out


def word_spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of word bytes, never across rows, and for each row
    the number of words before it (n + 1 values)."""
    word = is_word[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    rows = offs[:-1][offs[:-1] < offs[1:]]
    first[rows] = word[rows]
    last[rows[1:] - 1] = word[rows[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
