"""Vectorised word hashing: whole Arrow batches of texts become arrays of 64-bit word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
#: Bytes hashed at once; longer batches are worked through in blocks of whole texts.
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: dict = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, BLOCK), base, U)
        out[0] = U(1)
        out = np.multiply.accumulate(out)
        if n > BLOCK:
            return out
        _powers[base] = out
    return _powers[base][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n+1 offsets into them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, size: int = BLOCK):
    """Ranges of texts of about that many bytes together, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, and bounds of the words of each text.

    bounds: offsets of the texts in data, the first 0 and the last len(data). Words never cross a text's end.
    """
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = bounds[1:-1]
    edge = edge[edge < len(data)]
    starts[edge] = inside[edge]
    at = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edge[edge > 0] - 1
    ends[last] = inside[last]
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, depending on its content alone."""
    n = len(data)
    prefix = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(BASE_INV, n + 1)[starts] + (ends - starts).astype(U))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k word hashes that start at each of the first n-k+1 words."""
    n = len(words)
    if n < k:
        return np.empty(0, U)
    prefix = np.zeros(n + 1, U)
    np.cumsum(words * powers(BASE, n), out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * powers(BASE_INV, n - k + 1))


def char_counts(data: np.ndarray) -> np.ndarray:
    """Characters that begin before each byte, and at the end all of them."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def as_int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())
