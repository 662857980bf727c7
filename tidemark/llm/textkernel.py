"""Vectorised kernels over Arrow string columns, shared by the operators of this subpackage.

Words are the maximal runs of bytes other than space and 0x09-0x0D. As every one of these
separators is a single ASCII byte, splitting the UTF-8 bytes equals splitting the characters,
so the kernels work on the Arrow value buffer and never build Python strings per word.

A word's hash is a polynomial over its bytes modulo 2**64, from prefix sums:
``(S[end] - S[start]) * R**-start`` with an odd (so invertible) base, then a finaliser.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_BYTE = _BYTE[_LOWER]
_powers: dict[int, np.ndarray] = {}
#: Bytes hashed at once: the temporaries of a chunk are some 30 times this.
CHUNK = 1 << 21


def _power_table(base: int, size: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < size:
        size = 1 << (size - 1).bit_length()
        table = np.ones(size, dtype=np.uint64)
        have, step = 1, base
        while have < size:
            table[have : 2 * have] = table[:have] * np.uint64(step)
            have, step = 2 * have, step * step % (1 << 64)
        _powers[base] = table
    return table


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text counts as an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base = offsets[0] if len(offsets) else 0
    return raw[base : offsets[-1] if len(offsets) else 0], offsets - base


def fold_case(raw: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z and the two-byte letters U+00C0 to U+00DE, byte for byte."""
    out = _LOWER[raw]
    second = np.flatnonzero(out[:-1] == 0xC3) + 1
    upper = second[(out[second] >= 0x80) & (out[second] <= 0x9E) & (out[second] != 0x97)]
    out[upper] += 0x20
    return out


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each text's first word (one more entry at the end)."""
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased if asked for; words are in byte order."""
    out = np.empty(len(starts), dtype=np.uint64)
    table = _LOWER_BYTE if lower else _BYTE
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, side="right")))
        piece = raw[low : ends[to - 1]]
        size = len(piece) + 1
        sums = np.zeros(size, dtype=np.uint64)
        np.cumsum(table[piece] * _power_table(_R, size)[: size - 1], out=sums[1:])
        s = starts[at:to] - low
        e = ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * _power_table(_RINV, size)[s] + (e - s).astype(np.uint64)
        at = to
    return mix64(out)


def texts_words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a column, and each text's first word (one more entry at the end)."""
    raw, offsets = string_buffer(column)
    starts, ends, first = word_spans(raw, offsets)
    return word_hashes(raw, starts, ends, lower), first


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; by a sort, which is many times faster than hashing here."""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]))]


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every shingle of ``size`` words, in text order, repeats kept.

    A text with 1 to ``size - 1`` words has its whole word sequence as its only shingle;
    one without words has none.
    """
    counts = np.diff(first)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), number)
    begin = np.cumsum(number) - number
    at = first[:-1][owner] + (np.arange(len(owner)) - begin[owner])
    length = np.minimum(counts[owner], size)
    h = np.zeros(len(owner), dtype=np.uint64)
    for k in range(size):
        live = length > k
        if live.all():
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
        elif live.any():
            h[live] = mix64(h[live] * np.uint64(0x9E3779B97F4A7C15) + words[at[live] + k])
    return h, owner


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20):
    """Consecutive slices of a batch with about ``limit`` bytes of text each, so that temporaries stay bounded."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(False), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
