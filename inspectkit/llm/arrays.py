"""Arrow/numpy helpers shared by the corpus operators.

Texts are handled as the UTF-8 bytes of an Arrow column: word boundaries,
word hashes and window hashes are computed for a slice of many documents at
once, so no per-document or per-word Python runs on the hot paths.  Slices
are bounded in bytes (one document is never cut), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
NULL_ID = np.iinfo(np.int64).min  # a null doc_id sorts before every id

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20250101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_WORD_BYTE = np.where(_SEPARATOR, np.uint64(0), _BYTE)
_WORD_LOWER_BYTE = np.where(_SEPARATOR, np.uint64(0), _LOWER_BYTE)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_K1, _K2, _K3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _P) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept for reuse up to slice size)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _K1
    h = (h ^ (h >> np.uint64(27))) * _K2
    return h ^ (h >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence whose halves have the hashes a and b."""
    h = a * np.uint64(_P) + (b ^ (b >> np.uint64(32))) * _K3
    return h ^ (h >> np.uint64(29))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k neighbours of h, by doubling: len(h)-k+1 values."""
    if k < 1 or len(h) < k:
        return h[:0]
    out, done, size = None, 0, 1
    level = h
    while True:
        if k & size:
            out = level if out is None else joined(out[: len(h) - done - size + 1], level[done:])
            done += size
        if done == k:
            return mix(out[: len(h) - k + 1])
        level = joined(level[: len(level) - size], level[size:])
        size *= 2


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (a longer single row alone)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, apart: np.ndarray = _SEPARATOR):
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts, or the runs of bytes
    that ``apart`` (a flag per byte) does not separate.

    Returns (starts, ends, hashes, first): byte spans, 64-bit hashes of the
    words (ASCII upper case folded if ``lower``) and, for each text, the index
    of its first word (one more entry than texts)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    letter = ~apart[raw]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = letter[cuts]
    stops = letter.copy()
    stops[:-1] &= ~letter[1:]
    stops[cuts - 1] = letter[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64), first
    reach = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, reach)
    longest = int((ends - starts).max())
    np.minimum(place, longest, out=place)
    table = _WORD_LOWER_BYTE if lower else _WORD_BYTE
    if apart is not _SEPARATOR:
        table = np.where(apart, np.uint64(0), _LOWER_BYTE if lower else _BYTE)
    h = np.add.reduceat(table[raw[starts[0] :]] * powers(longest + 1)[place], starts - starts[0])
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * _K3), first


def row_of(first: np.ndarray) -> np.ndarray:
    """The text that each word (or window) belongs to, from ``first``."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Running polynomial sums of a slice, for ``span_hash``."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(len(raw)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, stop) of a slice: equal bytes, equal hash."""
    inverse = powers(max(1, len(sums)), _P_INV)
    return mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64) * _K3)


def spans(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c of counts, concatenated."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Boolean cover of 0..n-1 by the half-open intervals."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(starts, n), 1)
    np.add.at(step, np.minimum(stops, n), -1)
    return np.cumsum(step[:-1]) > 0


def binary(sorted_values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: ``counts`` neighbouring values of the array per row."""
    flat = np.ascontiguousarray(sorted_values)
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * flat.dtype.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def numbers(column, dtype) -> np.ndarray:
    """All values packed in a binary column."""
    return bytes_of(column)[0].view(dtype)


def packed(dest: np.ndarray, **cols: np.ndarray) -> pa.RecordBatch:
    """Rows (dest, one binary column per array): entries gathered by destination."""
    dest = np.asarray(dest)
    order = np.argsort(dest.astype(np.uint16) if len(dest) and dest.max() < 65536 else dest, kind="stable")
    ordered = dest[order]
    at = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(ordered) else np.empty(0, np.int64)
    counts = np.diff(np.append(at, len(ordered)))
    arrays = [pa.array(ordered[at].astype(np.int32))] + [binary(v[order], counts) for v in cols.values()]
    return pa.RecordBatch.from_arrays(arrays, names=["dest", *cols])


def packed_schema(*cols: str) -> str:
    return "dest int, " + ", ".join(f"{c} binary" for c in cols)


def gathered(batches: Iterable[pa.RecordBatch], **dtypes) -> dict[str, np.ndarray]:
    """Concatenation of the packed columns of all batches."""
    parts = {c: [] for c in dtypes}
    for b in batches:
        for c, t in dtypes.items():
            parts[c].append(numbers(b.column(b.schema.get_field_index(c)), t).copy())
    return {c: np.concatenate(v) if v else np.empty(0, dtypes[c]) for c, v in parts.items()}
