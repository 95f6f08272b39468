"""Words of whole Arrow columns of text as NumPy arrays, without a Python step per word.

A word is a run of ASCII letters and digits and of all bytes of other scripts; letter case does not count. Offsets are
bytes of the original UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in pieces of about so many bytes; a longer text makes a piece of its own.
PIECE_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: all bits of 64-bit numbers depend on all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the base and of its inverse modulo 2^64. One task keeps one, which grows with the longest piece."""

    def __init__(self) -> None:
        self.pair = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pair[0]) < n:
            tables = []
            for base in (BASE, BASE_INVERSE):
                table = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
                table[0] = 1
                tables.append(np.cumprod(table))
            self.pair = (tables[0], tables[1])
        return self.pair


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hash of each run values[start:end], mixed; the place of the run does not matter."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a piece: document index in the piece, byte range in that document's text, hash."""

    data: np.ndarray
    bounds: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.bounds) - 1)


def pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first text, texts) in pieces of about PIECE_BYTES; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = np.asarray(pc.binary_length(column), dtype=np.int64)
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(column):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + PIECE_BYTES, side="right")))
        yield begin, column.slice(begin, end - begin)
        begin = end


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts in one array, and the bounds of each."""
    texts = pa.concat_arrays([texts])
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(texts: pa.Array, powers: Powers) -> Words:
    """Words of a piece. Lower case is used where it keeps the length of a text in bytes, else the text as it is."""
    low = pc.utf8_lower(texts)
    low = pc.if_else(pc.equal(pc.binary_length(low), pc.binary_length(texts)), low, texts)
    data, bounds = raw_bytes(low)
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = IS_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    hashes = segment_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends, powers)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    return Words(data, bounds, doc, starts - bounds[doc], ends - bounds[doc], hashes)
