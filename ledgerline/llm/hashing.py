"""Hashes of many pieces of UTF-8 at once: polynomials of their bytes modulo 2**64, by prefix sums over whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time.
BLOCK_BYTES = 1 << 20
BASE = 0x2545F4914F6CDD1D
MASK = (1 << 64) - 1
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def byte_numbers(seed: int) -> np.ndarray:
    """A number for each byte."""
    return mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * seed)) * GOLD)


_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """BASE to the power of every place in a block, and the inverses."""
    if not _powers:
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(BLOCK_BYTES + 1, b, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def _long_piece(piece: np.ndarray, number: np.ndarray) -> int:
    """The hash of a piece of any length, block by block."""
    total, scale = 0, 1
    for k in range(0, len(piece), BLOCK_BYTES):
        block = number[piece[k : k + BLOCK_BYTES]]
        total += int((block * powers()[0][: len(block)]).sum(dtype=np.uint64)) * scale
        scale = scale * int(powers()[0][BLOCK_BYTES]) & MASK
    return total & MASK


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Hashes of the pieces data[starts:ends], which lie in order, by the numbers of their bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        base = starts[k]
        upto = max(k + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
        block = data[base : ends[upto - 1]]
        if len(block) > BLOCK_BYTES:
            out[k] = _long_piece(block, number)
        else:
            total = np.zeros(len(block) + 1, dtype=np.uint64)
            np.cumsum(number[block] * powers()[0][: len(block)], out=total[1:])
            a = starts[k:upto] - base
            out[k:upto] = (total[ends[k:upto] - base] - total[a]) * powers()[1][a]
        k = upto
    return mix(out)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and where each begins; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def sub_batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts of a few blocks of bytes, or of a single text: from, to, their bytes, and where each begins."""
    data, offsets = texts_of(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + 2 * BLOCK_BYTES, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
