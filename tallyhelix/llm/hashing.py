"""Words of many texts as 64-bit hashes, computed together in numpy."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over all output bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, for as many bytes as are usually taken at once."""
    return _powers_of(1 << 19)


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(_ODD, -1, 1 << 64)
    up, down = np.full(n, _ODD, U), np.full(n, back, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


@functools.cache
def space_bytes() -> np.ndarray:
    """Each byte's class: 0 ends a word (space, 9 to 13), else the byte with A-Z lower-cased."""
    out = np.arange(256, dtype=np.int16)
    out[65:91] += 32
    out[[32, *range(9, 14)]] = 0
    out[0] = 256  # the byte 0 is part of a word
    return out


@functools.cache
def letter_bytes() -> np.ndarray:
    """Each byte's class: letters of ASCII, lower-cased, and bytes of other characters; all else ends a word."""
    out = np.arange(256, dtype=np.int16)
    out[65:91] += 32
    out[:65] = 0
    out[91:97] = 0
    out[123:128] = 0
    return out


def words_at(texts: list[bytes], classes: np.ndarray):
    """(byte classes of the joined texts, starts, ends, index of its text) of every word, in order."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = classes[buf]
    edge = np.flatnonzero(np.diff((kind > 0).astype(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return kind, start, end, np.searchsorted(ends, start, "right")


def words(texts: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of every word of the texts, in order."""
    kind, start, end, doc = words_at(texts, classes)
    up, down = _powers() if len(kind) <= 1 << 19 else _powers_of(len(kind))
    symbol = mix(np.arange(257, dtype=U) + U(1))
    symbol[0] = 0
    total = np.zeros(len(kind) + 1, U)
    np.multiply(symbol[kind], up[: len(kind)], out=total[1:])
    np.cumsum(total, out=total)
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U)), doc
