"""Word arrays of many texts at once, with numpy over Arrow's UTF-8 buffers.

The functions here run inside Arrow tasks. A batch is cut into slices of a few
megabytes of text, so memory follows the slice and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
SLICE_BYTES = 2 << 20
#: Of work that adds nothing up over a slice: numpy takes some 50 bytes for a byte of it.
SMALL_SLICE_BYTES = 1 << 18
#: Powers are kept up to those of a slice. What a long text takes goes with it.
KEPT_POWERS = 22


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def table(n: int, salt: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U) + U(salt)) * GOLD)


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACE = _flags(b" \t\n\x0b\f\r")
NEWLINE = _flags(b"\n")
#: Everything ASCII but letters; bytes of other letters stay in a word.
NOT_LETTER = _flags(bytes(c for c in range(128) if not chr(c).isalpha()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTES = table(256, 77)
FOLDED = BYTES[LOWER]
BASE = 0x9FB21C651E98DF25


def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    n, inverse = 1 << log2, pow(BASE, -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.r_[U(1), np.full(n - 1, U(b))]) for b in (BASE, inverse))


_kept_powers = lru_cache(2)(_powers)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each piece has about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and offsets; null counts as empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text's number) of each maximal run without separators."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word, begins = ~separator[data], np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | begins[1:-1]
    last[:-1] &= ~word[1:] | begins[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of spans; ``fold`` lower-cases A-Z first."""
    if not len(start):
        return np.zeros(0, U)
    log2 = max(16, int(len(data)).bit_length())
    up, down = _kept_powers(log2) if log2 <= KEPT_POWERS else _powers(log2)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((FOLDED if fold else BYTES)[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * GOLD)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours of ``h``."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    return mix(sum((h[k : k + m] + U(k)) * U(2 * k + 3) * GOLD + (h[k : k + m] >> U(29)) for k in range(n)))
