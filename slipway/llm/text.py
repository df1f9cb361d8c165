"""Vectorised words, word hashes and shingles over Arrow text columns.

A batch of texts is one flat UTF-8 buffer with offsets. Words are runs of bytes of a class, so all bytes of all texts
are classified and cut at once; no Python loop runs over words or texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # texts handled at once; one longer text is a slice of its own
_BLOCK = 1 << 16
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_values = {True: _lower + np.uint64(1), False: np.arange(1, 257, dtype=np.uint64)}  # of bytes in a hash, lower-cased or not
_bytes = np.arange(256)
#: Words of letters, digits and all non-ASCII characters.
ALNUM = ((_bytes >= 48) & (_bytes < 58)) | ((_lower >= 97) & (_lower < 123)) | (_bytes >= 128)
#: Words of everything but ASCII white space.
NONSPACE = (_bytes != 32) & ~((_bytes >= 9) & (_bytes <= 13))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Hand freed memory back to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if "r" not in _tables or len(_tables["r"]) < n:
        size = max(n, _BLOCK + 64)
        _tables["r"], _tables["i"] = _powers(size, _R), _powers(size, pow(_R, -1, 1 << 64))
    return _tables["r"], _tables["i"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]] if len(offsets) else buf[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, trim: bool = True) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, or one longer text.

    Memory goes back to the system after each part, unless ``trim`` is off: to get it anew takes a third of the time
    that words and windows take.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // limit
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(lengths)])) if len(lengths) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)
        if trim:
            release()


def groups(batches: Iterator[pa.RecordBatch], column: str, limit: int, rows: int, trim: bool = True) -> Iterator[list[pa.RecordBatch]]:
    """Slices of a partition's batches, together of about ``limit`` bytes of text and no more than ``rows`` rows.

    With ``trim`` off, memory goes back to the system at the end of the partition only.
    """
    held: list[pa.RecordBatch] = []
    size = count = 0
    for batch in batches:
        for whole in slices(batch, column, trim=trim):
            for k in range(0, whole.num_rows, rows):
                part = whole.slice(k, rows)
                if held and (size + part.nbytes > limit or count + part.num_rows > rows):
                    yield held
                    held, size, count = [], 0, 0
                    if trim:
                        release()
                held.append(part)
                size, count = size + part.nbytes, count + part.num_rows
    if held:
        yield held
        held = []
        release()


def spans(buf: np.ndarray, offsets: np.ndarray, word_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each maximal run of bytes of the class; runs never cross texts."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = word_class[buf]
    flips = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = flips[::2], flips[1::2]
    # Where one text's last run and the next one's first run touch.
    within = offsets[(offsets > 0) & (offsets < len(buf))]
    touch = np.unique(within[inside[within] & inside[within + 1]])
    if len(touch):
        starts, ends = (np.sort(np.concatenate([x, touch])) for x in (starts, ends))
    return starts, ends


def hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte run (runs in order, not overlapping): polynomial modulo 2**64, scrambled."""
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _BLOCK, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        r, inv = powers(hi - lo + 1)
        values = _values[lower][buf[lo:hi]]
        values *= r[:hi - lo]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(_R))
        a = b
    return out


def words(column: pa.Array, word_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of all texts, and the offset of each text's first word."""
    buf, offsets = flat(column)
    starts, ends = spans(buf, offsets, word_class)
    return hash_runs(buf, starts, ends), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` consecutive words, and its text's index.

    With ``short``, a text of fewer words, but not none, gives its whole sequence as one.
    """
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    if not short:
        m = max(len(hashes) - n + 1, 0)
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out *= np.uint64(3)
            out += hashes[k:k + m]
            out = mix(out)
        keep = owner[:m] == owner[n - 1:n - 1 + m]
        return mix(out[keep] + np.uint64(n * _R & _MASK)), owner[:m][keep]
    out = np.zeros(len(hashes), np.uint64)
    size = np.zeros(len(hashes), np.uint64)
    last = first[1:][owner] if len(owner) else first[:0]
    pos = np.arange(len(hashes))
    for k in range(n):
        ok = pos + k < last
        out[ok] = mix(out[ok] * np.uint64(3) + hashes[pos[ok] + k])
        size[ok] += np.uint64(1)
    keep = (pos + n <= last) | (count[owner] < n) & (pos == first[:-1][owner])
    return mix(out[keep] + size[keep] * np.uint64(_R)), owner[keep]
