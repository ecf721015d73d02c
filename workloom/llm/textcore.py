"""Vectorised helpers on the text column of Arrow batches: words, word hashes and shingles.

A batch is handled in slices of bounded size, so memory follows the slice (or the longest single
text), not the batch. Hashes are 64 bits wide; they depend on the bytes alone, so every task and
every rerun gets the same values.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 256 << 10
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(outside):
    """Truth per byte value: False for the values of ``outside``, True for all others."""
    table = np.ones(256, dtype=bool)
    table[list(outside)] = False
    return table


#: Words without white space: [^\x20\x09-\x0D]+
PLAIN_WORD = byte_class([0x20, *range(0x09, 0x0E)])
#: Words of letters, digits and all bytes beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower-cased text
ALNUM_WORD = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def _powers(n):
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    size = 1
    while size < n:
        more = min(size, n - size)
        up[size:size + more] = up[:more] * up[size - 1] * base
        down[size:size + more] = down[:more] * down[size - 1] * inverse
        size += more
    return up, down


_POWERS = {}


def powers(n):
    size = max(SLICE_BYTES, 1 << max(n, 1).bit_length())
    if _POWERS.get("n", 0) < size:
        _POWERS.update(n=size, both=_powers(size))
    return _POWERS["both"]


def mix64(x):
    """Finalising bijection on 64-bit values (the published splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column):
    """(bytes, offsets, is_null) of an Arrow string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    nulls = np.asarray(column.is_null())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data, offsets, nulls


def slices(offsets, limit=SLICE_BYTES):
    """Row ranges [a, b) of about ``limit`` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def words(data, offsets, inside):
    """Starts and ends of all words and the index of the first word of every row (one more at the end).

    ``data`` are lower-cased bytes of the rows, ``offsets`` their bounds from 0 on.
    """
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    flags = inside[data]
    before = np.empty_like(flags)
    before[0] = False
    before[1:] = flags[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(flags & ~before)
    after = np.empty_like(flags)
    after[-1] = False
    after[:-1] = flags[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(flags & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data, starts, ends):
    """A 64-bit hash per word; pieces of the buffer bound the memory of long rows."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE_BYTES, "right")))
        low, high = int(starts[a]), int(ends[b - 1])
        up, down = powers(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[:high - low], out=sums[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def sequence_hashes(hashes, width):
    """A hash of every run of ``width`` neighbouring word hashes."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k:k + n] * np.uint64(pow(_BASE, 2 * k + 1, 1 << 64))
    return mix64(total + np.uint64(width))


def lowered_slices(column, inside):
    """Yields (first row, last row + 1, lower-cased bytes, row bounds, starts, ends, first words, nulls)."""
    data, offsets, nulls = text_bytes(column)
    for a, b in slices(offsets):
        low = LOWER[data[offsets[a]:offsets[b]]]
        bounds = offsets[a:b + 1] - offsets[a]
        yield a, b, low, bounds, *words(low, bounds, inside), nulls[a:b]
