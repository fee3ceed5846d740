"""Whole-batch text primitives: words, their hashes and rolling hashes of byte strings, by numpy over Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: All ASCII bytes but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[int, np.ndarray] = {}
BLOCK = 2_000_000


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.full(size, base, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows (one more than rows); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about size bytes; a longer text is a block of its own."""
    raw, off = buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def tokens(data: np.ndarray, off: np.ndarray, lower: bool = True, gap: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word, in order: first byte, end byte, row, and a 64-bit hash of its bytes (A-Z as a-z if lower). gap tells of each byte whether it separates words."""
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return start, end, start, np.zeros(0, np.uint64)
    row = np.searchsorted(off, start, "right") - 1
    size = end - start
    at = np.flatnonzero(inside)
    begin = np.zeros(len(start), np.int64)
    np.cumsum(size[:-1], out=begin[1:])
    place = np.arange(len(at)) - np.repeat(begin, size)
    codes = data[at]
    with np.errstate(over="ignore"):
        value = _CODE[_LOWER[codes] if lower else codes] * powers(int(size.max()))[place]
        return start, end, row, mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * BASE)


def grams(hashes: np.ndarray, row: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n consecutive words of a row; a row of fewer words, but one at least, has one gram of them all."""
    counts = np.bincount(row, minlength=rows)
    with np.errstate(over="ignore"):
        p = powers(n + 1)
        if len(hashes) >= n:
            total = np.zeros(len(hashes) - n + 1, np.uint64)
            for k in range(n):
                total += hashes[k : len(hashes) - n + 1 + k] * p[k]
            whole = row[: len(total)] == row[n - 1 :]
            at, value = row[: len(total)][whole], mix(total[whole] + np.uint64(n))
        else:
            at, value = np.zeros(0, row.dtype), np.zeros(0, np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            begin = np.concatenate(([0], np.cumsum(counts)))[short]
            more = np.array([int(np.sum(hashes[b : b + counts[s]] * p[: counts[s]])) & (2**64 - 1) for s, b in zip(short, begin)], np.uint64)
            at, value = np.concatenate((at, short)), np.concatenate((value, mix(more + counts[short].astype(np.uint64))))
            order = np.argsort(at, kind="stable")
            at, value = at[order], value[order]
    return at, value


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
