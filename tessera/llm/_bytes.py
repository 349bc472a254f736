"""Vectorised work on Arrow binary columns: chunks, words and 64-bit hashes without a Python object per word."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RNG = np.random.default_rng(20240229)
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


_holder: tuple[str, object] = ("", None)


def claim(owner: str, release=None) -> None:
    """A task of `owner` starts in this worker: what another operator's tasks remembered here is let go."""
    global _holder
    if _holder[0] == owner:
        return
    if _holder[1] is not None:
        _holder[1]()
    _powers.clear()
    _holder = (owner, release)
    gc.collect()
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system, so that a worker that waits for its next task holds none."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library, which keeps freed memory as it likes


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives memory back when it ends, however it ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(inverse)
    if got is None or len(got) < n:
        step = np.full(max(n, 1 << 20), _BASE_INVERSE if inverse else _BASE, dtype=np.uint64)
        step[0] = 1
        _powers[inverse] = got = np.cumprod(step)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array, and int64 offsets (one more than rows) into them. Null rows are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"")
    large = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(array: pa.Array, target: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Pieces of about `target` bytes, whole rows each: (rows, bytes, offsets)."""
    if not len(array):
        return
    data, offsets = column_bytes(array)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + target, "right")) - 1)
        last = min(last, len(offsets) - 1)
        yield slice(first, last), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes other than 0x20 and 0x09-0x0D; runs end with their row."""
    solid = ~WHITE[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    starts[at] = solid[at]
    at = offsets[1:][full] - 1
    ends[at] = solid[at]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def rolling_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands.

    It is a polynomial, cheap for spans that overlap; unequal spans with one hash are easily made, so it may only bring
    spans together that are compared by their bytes afterwards.
    """
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_HASH[data] * powers(n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(n + 1, inverse=True)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def ends_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 bytes of each span, and the 8 after them, as little-endian integers; zeros beyond its end."""
    size, padded = ends - starts, np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    near = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        keep = np.where(left >= 8, ~U64(0), (U64(1) << (np.clip(left, 0, 7) * 8).astype(np.uint64)) - U64(1))
        return near[at].copy().view("<u8").ravel() & keep

    return eight(starts, size), eight(np.minimum(starts + 8, len(data)), size - 8)


def span_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each span: its bytes and length themselves up to 15 bytes, else its BLAKE2b."""
    size = ends - starts
    hi, lo = ends_of(data, starts, ends)
    lo |= np.minimum(size, 255).astype(np.uint64) << U64(56)
    for i in np.flatnonzero(size > 15).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        hi[i], lo[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 0xFF << 56
    return hi, lo


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 128 bits and the row of every word, A-Z read as a-z."""
    s, e, row = words(data, offsets)
    return *span_ids(LOWER[data], s, e), row


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes, each of all 128 bits, and the row of every word, A-Z read as a-z."""
    hi, lo, row = word_ids(data, offsets)
    return mix(hi ^ mix(lo ^ U64(0x9FB21C651E98DF25))), mix(lo ^ mix(hi ^ U64(0x2545F4914F6CDD1D))), row


def shingle_hashes(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every `width` consecutive words of a row; a row of fewer words gives its whole sequence once."""
    m = len(h)
    if not m:
        return h, row
    mult = [U64((0xA0761D6478BD642F * (2 * k + 3)) % 2**64 | 1) for k in range(width)]
    count = np.bincount(row, minlength=row[-1] + 1)
    if m >= width:
        full = row[: m - width + 1] == row[width - 1 :]
        total = np.zeros(m - width + 1, dtype=np.uint64)
        for k in range(width):
            total += mix(h[k : m - width + 1 + k] * mult[k])
        out, rows = mix(total)[full], row[: m - width + 1][full]
    else:
        out, rows = h[:0], row[:0]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            extra[has] += mix(h[first[has] + k] * mult[k])
        out = np.concatenate([out, mix(extra + count[short].astype(np.uint64))])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) inside consecutive groups of these sizes."""
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(start)) - start
    i = np.repeat(np.arange(len(start)), np.repeat(sizes, sizes) - 1 - place)
    first = np.cumsum(np.bincount(i, minlength=len(start))) - np.bincount(i, minlength=len(start))
    return i, i + 1 + np.arange(len(i)) - first[i]


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores added until no other column has it (columns' names ignore case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
