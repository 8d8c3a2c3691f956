"""Vectorised words, shingles and hashes over whole texts, straight from Arrow's UTF-8 buffers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_random = np.random.default_rng(20240229)
BYTE = _random.integers(1, 2**64, 256, dtype=U64) | U64(1)
GRAM = _random.integers(1, 2**64, 64, dtype=U64) | U64(1)
BASE = int(_random.integers(1, 2**64, dtype=U64)) | 1
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def frugal(run: Callable) -> Callable:
    """A function over Arrow batches that gives the memory it worked in back to the system at its end; workers live on between tasks, and what
    they keep counts against their executor."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not glibc
                pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def blocks(raw: np.ndarray, offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of groups of whole texts of about limit bytes."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(raw: np.ndarray, offs: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words (runs of no separator, A-Z lower-cased), and each text's n + 1 word offsets."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), np.zeros(len(offs), np.int64)
    gap = separator[raw]
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[offs[:-1][offs[:-1] < len(raw)]] = True
    starts = np.flatnonzero(before & ~gap)
    after = np.empty(len(raw), bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[offs[1:][offs[1:] > 0] - 1] = True
    ends = np.flatnonzero(after & ~gap) + 1
    low = LOWER[raw]
    return starts, ends, span_hashes(low, starts, ends), np.searchsorted(starts, offs)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.empty(len(raw) + 1, U64)
    total[0] = 0
    np.cumsum(BYTE[raw] * powers(BASE, len(raw)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(U64))


def shingles(hashes: np.ndarray, word_offs: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, the word each starts at, and each text's offsets into them. With short, a text
    of fewer than n words has its whole sequence as its one shingle."""
    lens = np.diff(word_offs)
    count = np.where(lens >= n, lens - n + 1, ((lens > 0) & short).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(offs[-1]) - np.repeat(offs[:-1] - word_offs[:-1], count)
    padded = np.concatenate([hashes, np.zeros(n, U64)])
    total = np.zeros(len(hashes), U64)
    for j in range(n):
        total += padded[j : j + len(hashes)] * GRAM[j]
    out = total[at]
    if short:
        for i in np.flatnonzero((lens > 0) & (lens < n)):
            own = hashes[word_offs[i] : word_offs[i + 1]]
            out[offs[i]] = (own * GRAM[: len(own)]).sum(dtype=U64)
    return mix(out), at, offs


def distinct(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values, sorted, and their offsets."""
    out, sizes = [], np.zeros(len(offs), np.int64)
    for i in range(len(offs) - 1):
        own = np.sort(values[offs[i] : offs[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.cumsum(sizes)
