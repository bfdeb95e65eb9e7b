"""Vectorised hashing of words and character n-grams over code points."""

from __future__ import annotations

import functools

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier, so that it has an inverse modulo 2**64
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (public splitmix64 constants: fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_R), -1, 1 << 64))
    n = 2 * _BLOCK + 2
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, r, np.uint64)]), dtype=np.uint64) for r in (_R, inverse))


@functools.cache
def space_table() -> np.ndarray:
    return np.fromiter((chr(i).isspace() for i in range(0x110000)), bool, 0x110000)


@functools.cache
def word_table() -> np.ndarray:
    """Letters, digits and the underscore."""
    return np.fromiter((chr(i).isalnum() or chr(i) == "_" for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def parts(text: str, size: int = _BLOCK):
    """The text in parts of about ``size`` characters, cut behind white space; a word of over that length is cut inside."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        back = max(text.rfind(" ", at + size // 2, cut), text.rfind("\n", at + size // 2, cut))
        cut = back + 1 if back > 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end], from sums of powers: the work doesn't depend on how long words are."""
    up, down = _powers()
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts])


def ngram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of codes[i:i + n] for every i that has as many."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(codes) - n + 1, np.uint64(n))
    for j in range(n):
        out = out * _R + codes[j : len(codes) - n + 1 + j]
    return mix(out)
