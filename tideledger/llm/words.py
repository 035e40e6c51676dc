"""Words and word shingles of whole texts, as flat numpy arrays over UTF-8 bytes.

Every word class used here is a set of single bytes (all bytes from 0x80 on belong to
words), so word bounds can be found on the encoded text.  A word's hash is a polynomial
over a table of random numbers, modulo 2**64, taken from one prefix sum per piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = _U(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_byte = np.arange(256)
ALNUM = (_byte >= 0x80) | ((_byte >= 48) & (_byte < 58)) | ((_byte >= 65) & (_byte < 91)) | ((_byte >= 97) & (_byte < 123))
SOLID = ~((_byte == 0x20) | ((_byte >= 9) & (_byte <= 13)))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F | 1)
    x ^= x >> _U(32)
    return x


def _table(seed: int) -> np.ndarray:
    return mix(mix(np.arange(256, dtype=_U) + _U(seed * 1000003 + 1)) + _U(seed))


TABLES = (_table(1), _table(2))


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        row = np.full(max(n, PIECE_BYTES + 64), base, dtype=_U)
        row[0] = 1
        known = _powers[name] = np.cumprod(row, dtype=_U)
    return known


@dataclass
class Piece:
    """Some whole rows of a batch: `data` holds their bytes, row r has data[bounds[r]:bounds[r+1]]."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def row(self, r: int) -> bytes:
        return self.data[self.bounds[r] : self.bounds[r + 1]].tobytes()


def pieces(texts: pa.Array | pa.ChunkedArray, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """Splits a column of texts into pieces of about `most` bytes; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        upto = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        upto = min(n, max(upto, at + 1))
        bounds = offsets[at : upto + 1]
        yield Piece(at, data[bounds[0] : bounds[-1]], bounds - bounds[0])
        at = upto


@dataclass
class Words:
    """Words of a piece: byte spans, and first[r]:first[r+1] the words of row r."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(piece: Piece, inside: np.ndarray) -> Words:
    data, bounds = piece.data, piece.bounds
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64))
    solid = inside[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    cuts = bounds[:-1]
    before[cuts[cuts < len(data)]] = False
    ends = bounds[1:]
    after[ends[ends > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, bounds))


def word_hashes(piece: Piece, found: Words, lower: bool, table: int = 0) -> np.ndarray:
    if not len(found.starts):
        return np.zeros(0, _U)
    lut = TABLES[table]
    if lower:
        lut = lut[LOWER]
    n = len(piece.data)
    sums = np.zeros(n + 1, _U)
    np.cumsum(lut[piece.data] * powers("up", BASE, n + 1)[:n], out=sums[1:])
    inverse = powers("down", BASE_INVERSE, n + 1)
    value = (sums[found.ends] - sums[found.starts]) * inverse[found.starts]
    return mix(value + (found.ends - found.starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def run_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive values."""
    n = len(values)
    if n < width:
        return np.zeros(0, _U)
    sums = np.zeros(n + 1, _U)
    np.cumsum(values * powers("up", BASE, n + 1)[:n], out=sums[1:])
    at = np.arange(n - width + 1)
    return mix((sums[at + width] - sums[at]) * powers("down", BASE_INVERSE, n + 1)[at] + _U(width))


def shingle_sets(piece: Piece, inside: np.ndarray, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of every row (a shorter row is one shingle): hashes, and the bounds of rows."""
    found = words(piece, inside)
    hashes = word_hashes(piece, found, lower)
    counts = found.counts()
    long_enough = np.maximum(counts - width + 1, 0)
    short = (counts > 0) & (counts < width)
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(long_enough + short, out=bounds[1:])
    out = np.zeros(bounds[-1], _U)
    if len(hashes) >= width:
        runs = run_hashes(hashes, width)
        at = np.repeat(found.first[:-1] - bounds[:-1], long_enough + short) + np.arange(bounds[-1])
        whole = np.repeat(~short, long_enough + short)
        out[whole] = runs[at[whole]]
    for r in np.flatnonzero(short):
        own = hashes[found.first[r] : found.first[r + 1]]
        out[bounds[r]] = run_hashes(own, len(own))[0]
    return out, bounds
