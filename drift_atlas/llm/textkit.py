"""Vectorised word hashing over the UTF-8 buffers of Arrow batches.

A word is a run of bytes other than U+0020 and U+0009-U+000D, with A-Z lowered.
Its 64-bit hash comes from prefix sums of ``table[byte] * base**position``
modulo 2**64, so every word of a batch is hashed in a few passes over the
bytes, with no Python object per word. Bytes map to random 64-bit values and
hashes are mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text hashed at once, which bounds the arrays of a pass to some tens of bytes each; one word may be longer.
SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, xor and multiply), elementwise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each; only tables of a slice's length are kept."""
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(max(n, SLICE_BYTES + 2), base, U64)
        factors[0] = 1
        made.append(np.multiply.accumulate(factors))
    if n <= SLICE_BYTES + 2:
        _powers[:] = made
    return made


def buffers(column: pa.Array, large: pa.DataType | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or, with its large type, binary) column, nulls as empty, and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(large or pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(at: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    most = most or SLICE_BYTES
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + most, "right")) - 1
        last = min(max(last, first + 1), len(at) - 1)
        yield first, last
        first = last


def word_hashes(raw: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of consecutive texts, and the n + 1 offsets of each text's words.

    ``space`` tells of each byte whether it separates words; bytes of 128 and more must not.
    """
    begin, end = int(at[0]), int(at[-1])
    out_hash, out_start = [], []
    pos = begin
    while pos < end:
        stop = min(pos + SLICE_BYTES, end)
        if stop < end:  # end at white space or at the end of a text, so no word is cut
            spaces = np.flatnonzero(space[raw[pos:stop]])
            ends = at[np.searchsorted(at, stop, "right") - 1]
            cut = max(pos + int(spaces[-1]) + 1 if len(spaces) else pos, int(ends))
            while cut <= pos:
                more = min(stop + SLICE_BYTES, end)
                spaces = np.flatnonzero(space[raw[stop:more]])
                nexts = at[np.searchsorted(at, stop, "left")]
                cut = min(stop + int(spaces[0]) + 1 if len(spaces) else end, int(nexts)) if len(spaces) or nexts <= more else pos
                stop = more
                if stop == end and cut <= pos:
                    cut = end
            stop = cut
        piece = raw[pos:stop]
        inside = ~space[piece]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        final = inside.copy()
        final[:-1] &= ~inside[1:]
        bounds = at[np.searchsorted(at, pos, "left") : np.searchsorted(at, stop, "right")] - pos
        first = bounds[(bounds >= 0) & (bounds < len(piece))]
        start[first] |= inside[first]
        prior = bounds[(bounds > 0) & (bounds <= len(piece))] - 1
        final[prior] |= inside[prior]
        s, e = np.flatnonzero(start), np.flatnonzero(final) + 1
        power, inverse = _power_tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, U64)
        np.cumsum(_BYTE[piece] * power[: len(piece)], out=total[1:])
        out_hash.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64)))
        out_start.append(s + pos)
        pos = stop
    hashes = np.concatenate(out_hash) if out_hash else np.zeros(0, U64)
    starts = np.concatenate(out_start) if out_start else np.zeros(0, np.int64)
    return hashes, np.searchsorted(starts, at, "left")


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside each text, with repeats, and their offsets by text.

    A text of fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    count = np.diff(at)
    many = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out_at = np.concatenate(([0], np.cumsum(many)))
    rng = np.random.Generator(np.random.PCG64(size))
    factors = rng.integers(1, 1 << 63, size, dtype=np.uint64) * U64(2) + U64(1)
    n = max(len(words) - size + 1, 0)
    runs = np.zeros(n, U64)
    for k in range(size):
        runs += words[k : k + n] * factors[k]
    where = np.repeat(at[:-1] - out_at[:-1], many) + np.arange(out_at[-1])
    short = np.repeat(count < size, many)
    out = np.zeros(out_at[-1], U64)
    out[~short] = runs[where[~short]]
    for k in np.flatnonzero(short):  # at most one for each short text
        doc = np.searchsorted(out_at, k, "right") - 1
        own = words[at[doc] : at[doc + 1]]
        out[k : k + 1] = (own * factors[: len(own)]).sum(dtype=U64, keepdims=True) + np.full(1, len(own), U64) * U64(0xD6E8FEB86659FD93)
    return mix(out), out_at
