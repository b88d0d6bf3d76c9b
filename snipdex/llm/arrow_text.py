"""Texts of Arrow batches as bytes, and hashes of their words, without a loop over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (two multiply and shift rounds)."""
    x = x + U64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Alphabet:
    """Which bytes of UTF-8 text belong to words, after A-Z are lower-cased."""

    def __init__(self, inside: np.ndarray):
        self.inside = inside
        lower = np.arange(256, dtype=np.uint64)
        lower[65:91] += U64(32)
        self.values = mix(lower, 17)
        self.powers = np.ones(1, dtype=np.uint64)

    def power_table(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            steps = np.full(max(n, 64), 0xD6E8FEB86659FD93, dtype=np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
        return self.powers


def letters_and_digits() -> Alphabet:
    """Words of 0-9, a-z and everything beyond ASCII."""
    inside = np.zeros(256, dtype=bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    return Alphabet(inside)


def not_blank() -> Alphabet:
    """Words of everything but blanks and the control characters 9 to 13."""
    inside = np.ones(256, dtype=bool)
    inside[9:14] = inside[32] = False
    return Alphabet(inside)


def text_chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [first, last), their bytes, and the offsets of rows in them; nulls are empty.

    A chunk has up to `limit` bytes, or one row if that row alone is longer.
    """
    array = pc.fill_null(array.cast(pa.large_string()), "")
    n = len(array)
    if n == 0:
        return
    _, offset_buffer, data_buffer = array.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each row the number of words before it.

    A word's hash is the sum of its bytes' random values times powers of an odd base, mixed with its length.
    """
    rows = len(offsets) - 1
    inside = alphabet.inside[data]
    n = len(inside)
    if n == 0 or not inside.any():
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]  # a row's first byte begins a word even if the row before ends within one
    starts = np.flatnonzero(begins)
    before = np.searchsorted(starts, offsets)
    values = alphabet.values[data[inside]]
    firsts = np.flatnonzero(begins[inside])
    lengths = np.diff(np.append(firsts, len(values)))
    place = np.arange(len(values), dtype=np.int64)
    place -= np.repeat(firsts, lengths)
    values *= alphabet.power_table(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64)), before


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column of fixed-width values with the given number in each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
