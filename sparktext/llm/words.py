"""Word boundaries and word hashes of a text as arrays."""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Odd numbers without structure: base of the polynomial, and multipliers of the final mixing.
BASE = 0x9E3779B97F4A7C15 | 1
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
# Powers that a worker keeps; those of longer texts are made for one text and go with it.
KEPT_POWERS = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS["up"]) >= n:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    made = {}
    for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        made[name] = np.cumprod(steps, dtype=np.uint64)
    if n <= KEPT_POWERS:
        _POWERS.update(made)
    return made["up"][:n], made["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits; one-to-one."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX[0]
    h ^= h >> np.uint64(33)
    h *= MIX[1]
    h ^= h >> np.uint64(33)
    return h


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word (bytes other than ASCII blanks)."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~BLANK[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


# First bytes of characters from U+3000 to U+9FFF (kana, Han): scripts written without blanks.
UNSPACED = np.zeros(256, bool)
UNSPACED[0xE3:0xEA] = True


def unspaced_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_bounds``, but every character from U+3000 to U+9FFF is a word by itself."""
    own = UNSPACED[raw]
    if not own.any():
        return word_bounds(raw)
    inside = ~BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | own[1:]
    first[3:] |= inside[3:] & own[:-3]  # such a character has three bytes
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX[0])


def lowered(text: str) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased."""
    return LOWER[np.frombuffer(text.encode(), np.uint8)]


_STEPS = [np.uint64(x) for x in (0x8F3A1C5B7D9E2F41, 0x1B873593CC9E2D51, 0xE6546B64A3B1C2D7, 0x85EBCA6BC2B2AE35, 0x27D4EB2F165667C5)]


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``words`` words, A-Z lower-cased; of a shorter text the
    hash of all its words, of a text without words none."""
    raw = lowered(text)
    h = word_hashes(raw, *word_bounds(raw))
    if not len(h):
        return h
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = mixed(out) + h[j : j + n] * _STEPS[j % len(_STEPS)]
    return np.unique(mixed(out))
