"""Words and shingles of Arrow string columns as 64-bit hashes, with numpy and without a Python loop over words.

A column is worked through in chunks of whole texts of about ``CHUNK`` bytes, so the working memory of a task
is a small multiple of that, or of its longest text. Words are maximal runs of bytes outside ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept and grown by doubling."""
    p = _powers.get(int(base))
    if p is None or len(p) < n:
        size = max(n, 2 * CHUNK)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if size <= 8 * CHUNK:  # powers for one very long text are not kept
            _powers[int(base)] = p
    return p[:n]


def chunks(column: pa.Array, rows: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive slices of at most ``rows`` texts of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1), at + rows, len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges of bytes: equal ones of equal content, wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_BASE_INVERSE, n)[np.minimum(starts, n - 1)])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one chunk: word hashes, their byte starts and ends, and for each text the range of its words (n + 1 bounds)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return range_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; with fewer words, of the whole sequence; without words, none."""
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | U(1)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * factors[k]
    rolled = mix(rolled)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= width:
            own = np.sort(rolled[lo : hi - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif hi > lo:
            short = (hashes[lo:hi] * factors[: hi - lo]).sum(dtype=np.uint64)
            yield mix(np.array([short + U(hi - lo)], np.uint64) ^ U(0x5851F42D4C957F2D))
        else:
            yield np.zeros(0, np.uint64)
