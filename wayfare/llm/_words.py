"""Words of whole texts as 64-bit hashes, computed over Arrow buffers without a Python object per word.

A word is a maximal run of characters outside space and U+0009-U+000D. In UTF-8 these six bytes never occur
inside a longer character, so the split is done on bytes. Upper-case A-Z can be folded. Texts are handled in
slices of about ``SLICE`` bytes, so memory is bounded by a slice and by the hashes of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 16
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256)
FOLD[65:91] += 32
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTES[FOLD]
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _tables:
        one = np.ones(size, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:], down[1:] = np.uint64(_P), np.uint64(_P_INV)
        _tables.clear()
        _tables[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _tables[size]


def offsets_and_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1) and the bytes of a string or binary array; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _hash_slice(data: np.ndarray, bounds: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``data``; ``bounds``: starts of texts within it."""
    solid = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    before[bounds[bounds < len(data)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    cuts = bounds[bounds > 0]
    after[cuts - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_FOLDED if fold else _BYTES)[data] * up[: len(data)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_words(column: pa.Array, fold: bool = True, spans: bool = False) -> Iterator[tuple]:
    """For each text, in order: ``(index, word hashes)``, with ``spans`` also the words' start and end bytes in the text."""
    off, data = offsets_and_bytes(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= 4 * SLICE:
            part = data[lo:hi]
            if len(part):
                bounds = off[i : j + 1] - lo
                starts, ends, words = _hash_slice(part, bounds[:-1], fold)
                at = np.searchsorted(starts, bounds)
            else:
                starts = ends = np.zeros(0, np.int64)
                words, at, bounds = np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64), np.zeros(j - i + 1, np.int64)
            for k in range(j - i):
                a, b = at[k], at[k + 1]
                if spans:
                    yield i + k, words[a:b], starts[a:b] - bounds[k], ends[a:b] - bounds[k]
                else:
                    yield i + k, words[a:b]
        else:  # one long text: cut before a space, so that no word is cut
            out, p = [], lo
            while p < hi:
                q = min(hi, p + SLICE)
                while q < hi:
                    gap = np.flatnonzero(SPACE[data[q : min(hi, q + SLICE)]])
                    if len(gap):
                        q += int(gap[0])
                        break
                    q = min(hi, q + SLICE)
                starts, ends, words = _hash_slice(data[p:q], np.zeros(1, np.int64), fold)
                out.append((starts + (p - lo), ends + (p - lo), words))
                p = q
            starts, ends, words = (np.concatenate(x) for x in zip(*out, strict=True))
            yield (i, words, starts, ends) if spans else (i, words)
        i = j


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the ``k``-word shingles, in order; with fewer words, the whole sequence as one; none without words."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[j : n - size + 1 + j])
    return out


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most`` bytes of text, one row at least."""
    for batch in batches:
        off, _ = offsets_and_bytes(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
