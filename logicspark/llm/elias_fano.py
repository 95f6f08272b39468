"""Elias-Fano sequences as NumPy arrays that can be memory-mapped, read for whole arrays of places or values at once.

A rising sequence of n numbers below u keeps about log2(u / n) low bits of each number as they are. The rest is written in
unary: one bit for each number, a zero at the end of each bucket of equal high parts. Ones and zeros before each word are
stored, so that selecting is a search in them and one word.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

U = np.uint64
ALIGN = 64


def or_into(words: np.ndarray, place: np.ndarray, bits: np.ndarray) -> None:
    """Puts bits of no common position into words; places rise."""
    if len(place):
        first = np.flatnonzero(np.diff(place, prepend=-1))
        words[place[first]] |= np.add.reduceat(bits, first)


def repeated(byte: int) -> np.uint64:
    return U(int.from_bytes(bytes([byte]) * 8, "little"))


#: Position of the nth one of each byte.
SELECT_IN_BYTE = np.array(
    [([k for k in range(8) if byte >> k & 1] + [0] * 8)[:8] for byte in range(256)], dtype=np.int64
).ravel()


def select_in_word(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Position of the nth one (from 0) of each word: the byte by the ones up to each byte, then its bit."""
    ones = words - (words >> U(1) & repeated(0x55))
    ones = (ones & repeated(0x33)) + (ones >> U(2) & repeated(0x33))
    upto = (ones + (ones >> U(4)) & repeated(0x0F)) * repeated(1)
    nth = nth.astype(U)
    over = (nth * repeated(1) | repeated(0x80)) - upto & repeated(0x80)
    place = np.bitwise_count(over).astype(U) << U(3)
    rest = nth - (upto << U(8) >> place & U(0xFF))
    byte = words >> place & U(0xFF)
    return place.astype(np.int64) + SELECT_IN_BYTE[(byte << U(3) | rest).astype(np.int64)]


@dataclass
class EliasFano:
    """``n`` numbers; ``low`` and ``high`` are 64-bit words, ``ones`` and ``zeros`` how many come before each high word."""

    n: int
    bits: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray
    zeros: np.ndarray

    @staticmethod
    def of(values: np.ndarray, universe: int) -> EliasFano:
        """Sequence of rising ``values`` (equal ones allowed) below ``universe``."""
        values, n = values.astype(U), len(values)
        universe = universe if n else 1
        bits = min(63, max(0, (universe // max(1, n)).bit_length() - 1))
        at = np.arange(n, dtype=np.int64) * bits
        low = np.zeros(n * bits // 64 + 2, dtype=U)
        tail = values & U((1 << bits) - 1)
        off = at & 63
        or_into(low, at >> 6, tail << off.astype(U))
        over = off + bits > 64
        or_into(low, (at[over] >> 6) + 1, tail[over] >> (64 - off[over]).astype(U))
        place = (values >> U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(((universe >> bits) + n + 1) // 64 + 1, dtype=U)
        or_into(high, place >> 6, U(1) << (place & 63).astype(U))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high[:-1]), dtype=np.int64)])
        zeros = 64 * np.arange(len(high)) - ones
        kind = np.uint32 if 64 * len(high) < 1 << 32 else np.int64
        return EliasFano(n, bits, low, high, ones.astype(kind), zeros.astype(kind))

    def _select(self, before: np.ndarray, nth: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(before, nth.astype(before.dtype), side="right") - 1
        words = self.high[word]
        return 64 * word + select_in_word(~words if flip else words, nth - before[word].astype(np.int64))

    def tail(self, place: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(place), dtype=U)
        at = place * self.bits
        word, off = at >> 6, (at & 63).astype(U)
        out = self.low[word] >> off
        over = off + U(self.bits) > U(64)
        out[over] |= self.low[word[over] + 1] << (U(64) - off[over])
        return out & U((1 << self.bits) - 1)

    def at(self, place: np.ndarray) -> np.ndarray:
        """Numbers at these places."""
        place = place.astype(np.int64)
        return (self._select(self.ones, place, False) - place).astype(U) << U(self.bits) | self.tail(place)

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number that is not below each value, in places [begin, end), or end where there is none;
        and whether that number is the value.

        The high part of the value gives the bucket, the low bits are searched in it by halving."""
        values = values.astype(U)
        high = (values >> U(self.bits)).astype(np.int64)
        last = 64 * len(self.high) - int(self.ones[-1]) - int(np.bitwise_count(self.high[-1])) - 1
        beyond = high > last
        high = np.minimum(high, last)
        bit = np.zeros(len(high), dtype=np.int64)
        after = np.flatnonzero(high > 0)
        bit[after] = self._select(self.zeros, high[after] - 1, True) + 1
        start = bit - high
        # The bucket goes on to the next zero, mostly in the same word.
        rest = ~self.high[bit >> 6] >> (bit & 63).astype(U)
        stop = start + np.bitwise_count((rest & (~rest + U(1))) - U(1))
        long = np.flatnonzero(rest == 0)
        stop[long] = self._select(self.zeros, high[long], True) - high[long]
        low, top = np.clip(start, begin, end), np.clip(stop, begin, end)
        low[beyond] = top[beyond] = end[beyond]
        tail = values & U((1 << self.bits) - 1)
        until = top.copy()
        open_ = np.flatnonzero(low < top)
        while len(open_):
            middle = (low[open_] + top[open_]) >> 1
            below = self.tail(middle) < tail[open_]
            low[open_] = np.where(below, middle + 1, low[open_])
            top[open_] = np.where(below, top[open_], middle)
            open_ = open_[low[open_] < top[open_]]
        exact = np.zeros(len(values), dtype=bool)
        inside = np.flatnonzero(low < until)
        exact[inside] = self.tail(low[inside]) == tail[inside]
        return low, exact

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        size = np.array([self.n, self.bits], dtype=np.int64)
        parts = (size, self.low, self.high, self.ones, self.zeros)
        return {f"{name}.{k}": part for k, part in enumerate(parts)}

    @staticmethod
    def from_arrays(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        size, low, high, ones, zeros = (arrays[f"{name}.{k}"] for k in range(5))
        return EliasFano(int(size[0]), int(size[1]), low, high, ones, zeros)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one file: length of the list of arrays, the list, the arrays."""
    listed, at, parts = {}, 0, []
    for name, array in arrays.items():
        raw = np.ascontiguousarray(array).tobytes()
        listed[name] = (array.dtype.str, at, len(raw))
        parts.append(raw + bytes(-len(raw) % ALIGN))
        at += len(parts[-1])
    head = json.dumps(listed).encode()
    head += b" " * (-(len(head) + 8) % ALIGN)
    return len(head).to_bytes(8, "little") + head + b"".join(parts)


def unpacked(data: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a file that is mapped (or read) as bytes; nothing is copied."""
    length = int.from_bytes(data[:8].tobytes(), "little")
    listed = json.loads(data[8 : 8 + length].tobytes())
    return {
        name: data[8 + length + at : 8 + length + at + size].view(np.dtype(kind))
        for name, (kind, at, size) in listed.items()
    }
