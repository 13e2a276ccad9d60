"""Anchors of a text: positions that equal strings of `length` bytes share, wherever they stand.

Every window of `length` bytes owns the place with the least hash among its strings of `probe` bytes (the first of equals).
The choice depends on the window's bytes alone, so equal windows have an anchor at the same offset; the windows of one
anchor are a range of starts. The same holds of strings of words, which are told apart by two 64-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
BLOCK = 1 << 16
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


@lru_cache(4)
def _powers(n: int, base: int, inverse: bool) -> np.ndarray:
    b = pow(base, -1, 1 << 64) if inverse else base
    out = np.empty(n, np.uint64)
    out[0] = 1
    size = 1
    while size < n:
        step = np.uint64(pow(b, size, 1 << 64))
        more = min(size, n - size)
        out[size : size + more] = out[:more] * step
        size += more
    return out


@lru_cache(2)
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _prefix(of: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix sums of letters' or words' values times powers of the base, modulo 2**64."""
    out = np.zeros(len(of) + 1, np.uint64)
    np.cumsum(of * _powers(_size(len(of)), int(base), False)[: len(of)], out=out[1:])
    return out


def _size(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


def _span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64, n: int) -> np.ndarray:
    return (prefix[end] - prefix[start]) * _powers(_size(n), int(base), True)[start]


def split(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word where it starts and ends, and two hashes."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]])))
    start, end = edge[::2], edge[1::2]
    one, two = (_mix(_span_hash(_prefix(_letters(seed)[raw], base), start, end, base, len(raw))) for base, seed in ((_BASE, 1), (_BASE2, 2)))
    return start, end, one, two


def word_anchors(data: bytes, length: int, probe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `anchors`, all in words."""
    return _anchors(*split(data)[2:], length, probe)


def anchors(data: bytes, length: int, probe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, hash of the probe, hash of all that the windows cover and how they lie)."""
    raw = np.frombuffer(data, np.uint8)
    return _anchors(_letters(1)[raw], _letters(2)[raw], length, probe)


def _anchors(values: np.ndarray, others: np.ndarray, length: int, probe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(values)
    if n < length:
        e = np.empty(0, np.int64)
        return e, e, e, e, e
    one = _prefix(values, _BASE)
    k = n - probe + 1
    probes = _mix((one[probe:] - one[:k]) * _powers(_size(n), int(_BASE), True)[:k])
    width = length - probe + 1
    windows = n - length + 1
    owner = np.empty(windows, np.int64)
    for at in range(0, windows, BLOCK):
        size = min(BLOCK, windows - at)
        # the place in the low bits: the least hash wins, among equals the first place
        key = (probes[at : at + size + width - 1] & ~np.uint64(0x1FFFF)) | np.arange(size + width - 1, dtype=np.uint64)
        span, have = 1, key
        while span < width:
            step = min(span, width - span)
            have = np.minimum(have[: len(have) - step], have[step:])
            span += step
        owner[at : at + size] = (have & np.uint64(0x1FFFF)).astype(np.int64) + at
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    last = np.append(first[1:], windows) - 1
    place = owner[first]
    two = _prefix(others, _BASE2)
    cover = _span_hash(two, first, last + length, _BASE2, n)
    shape = (place - first).astype(np.uint64) * np.uint64(0x100000001B3) + (last - first).astype(np.uint64)
    return place, first, last, probes[place].view(np.int64), (_mix(cover) ^ _mix(shape * _BASE)).view(np.int64)
