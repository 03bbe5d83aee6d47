"""Words, 64-bit word hashes and hashes of word windows, with numpy on Arrow's own text buffers."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    """The maximal runs `[^\\x20\\x09-\\x0D]+`, as UTF-8; bytes.split() without argument splits at just those six bytes."""
    return text.encode().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (multiply and shift)."""
    x = x * _A
    x ^= x >> U(29)
    x *= _C
    x ^= x >> U(32)
    return x


def join2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent hash of pairs."""
    return mix(a * _B + (b ^ (b >> U(31))))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive items (len(h) - k + 1 of them), by doubling: O(n log k) whatever k is."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, cur, width = None, 0, h, 1
    while width <= k:
        if k & width:
            part = cur[done : done + n]
            out = mix(part + U(width)) if out is None else join2(out, part)
            done += width
        width *= 2
        if width <= k:
            cur = join2(cur[: len(cur) - width // 2], cur[width // 2 :])
    return out


def sliding_min(v: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values."""
    n = len(v) - k + 1
    if n <= 0:
        return v[:0]
    width, cur = 1, v
    while width * 2 <= k:
        cur = np.minimum(cur[: len(cur) - width], cur[width:])
        width *= 2
    return np.minimum(cur[:n], cur[k - width : k - width + n])


# Fixed pseudo-random value of each byte; separators count nothing.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
ONLY_SPACE = np.zeros(256, bool)
ONLY_SPACE[0x20] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW = np.full(4096, 0x9FB21C651E98DF25, np.uint64)
_POW[0] = 1
_POW = np.cumprod(_POW, dtype=np.uint64)
CHUNK = 1 << 20


def _powers(n: int) -> np.ndarray:
    global _POW
    while len(_POW) < n:
        _POW = np.concatenate([_POW, _POW * (_POW[-1] * _POW[1])])
    return _POW


def hash_words(raw: np.ndarray, bounds: np.ndarray, lower: bool = False, gaps: np.ndarray = _SPACE, places: bool = False) -> tuple[np.ndarray, ...]:
    """(hash of each word, index of the first word of each text[, starts, ends]) of adjacent texts raw[bounds[i]:bounds[i + 1]].

    gaps: which bytes part words.

    A word's hash depends on its bytes alone. Work is done in chunks that end at separators or text ends, so memory
    follows CHUNK, not a text's length (a single longer word excepted).
    """
    if lower:
        raw = _LOWER[raw]
    blank = gaps[raw]
    start = ~blank
    start[1:] &= blank[:-1]
    edges = bounds[:-1]
    edges = edges[edges < len(raw)]
    start[edges] = ~blank[edges]
    starts = np.flatnonzero(start)
    first = np.searchsorted(starts, bounds)
    value = np.where(gaps, U(0), _BYTE)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(starts, starts[at] + CHUNK))
        to = max(to, at + 1)
        a, b = starts[at], starts[to] if to < len(starts) else len(raw)
        own = starts[at:to] - a
        span = np.diff(np.append(own, b - a))
        k = np.arange(b - a, dtype=np.int32) - np.repeat(own, span).astype(np.int32)
        v = value[raw[a:b]]
        v *= _powers(int(span.max()))[k]
        out[at:to] = np.add.reduceat(v, own)
        at = to
    if places:
        last = ~blank
        last[:-1] &= blank[1:]
        edges = bounds[1:]
        edges = edges[edges > 0] - 1
        last[edges] = ~blank[edges]
        return mix(out), first, starts, np.flatnonzero(last) + 1
    return mix(out), first


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, lower: bool = False, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, next row, word hashes, first word of each text and the end) of runs of texts of about `size` bytes."""
    raw, bounds = texts_of(column)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, side="right")) - 1)
        h, first = hash_words(raw[bounds[row] : bounds[to]], bounds[row : to + 1] - bounds[row], lower)
        yield row, to, h, first
        row = to


def trimmed(f: Callable) -> Callable:
    """f (batches -> iterator) that gives freed memory back to the system when its task ends, as idle workers keep theirs."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if name := ctypes.util.find_library("c"):
                getattr(ctypes.CDLL(name), "malloc_trim", lambda _: 0)(0)

    return run
