"""Elias-Fano coding of a rising sequence of offsets.

A sequence of n values up to u is split at bit ``low = floor(log2(u / n))``. The low bits are stored side by side, the
rest as one bit per value in a bit vector where value i sets bit ``(v_i >> low) + i``. That is at most
``2 + log2(u / n)`` bits a value. ``hints`` holds, for every 256th value, the place of its bit as unsigned 32-bit
number, so ``select`` looks at one short stretch of the vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HINT_EVERY = 256


@dataclass(frozen=True)
class EliasFano:
    count: int
    low_bits: int
    low: bytes
    high: bytes
    hints: bytes


def encode(values) -> EliasFano:
    """Encode a non-decreasing sequence of non-negative integers; an empty sequence gives empty parts."""
    v = np.asarray(values, dtype=np.int64)
    n = len(v)
    if n == 0:
        return EliasFano(0, 0, b"", b"", b"")
    if v[0] < 0 or (np.diff(v) < 0).any():
        raise ValueError("Elias-Fano needs a non-decreasing sequence of non-negative integers")
    low_bits = max(0, int(v[-1] // n).bit_length() - 1)
    places = (v >> low_bits) + np.arange(n)
    if places[-1] >= 2**32:
        raise ValueError("the bit vector of one block must stay below 2^32 bits; make blocks smaller")
    bits = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
    bits[places] = 1
    low = b""
    if low_bits:
        shifts = np.arange(low_bits - 1, -1, -1)
        low = np.packbits(((v[:, None] >> shifts) & 1).astype(np.uint8).ravel()).tobytes()
    return EliasFano(n, low_bits, low, np.packbits(bits).tobytes(), places[::HINT_EVERY].astype("<u4").tobytes())


def _low_part(code: EliasFano, first: int, last: int) -> np.ndarray:
    if code.low_bits == 0:
        return np.zeros(last - first, dtype=np.int64)
    begin, end = first * code.low_bits, last * code.low_bits
    piece = np.frombuffer(code.low, dtype=np.uint8)[begin // 8 : (end + 7) // 8]
    bits = np.unpackbits(piece)[begin % 8 :][: end - begin].reshape(-1, code.low_bits).astype(np.int64)
    return bits @ (1 << np.arange(code.low_bits - 1, -1, -1, dtype=np.int64))


def decode(code: EliasFano) -> np.ndarray:
    """All values."""
    if code.count == 0:
        return np.zeros(0, dtype=np.int64)
    places = np.flatnonzero(np.unpackbits(np.frombuffer(code.high, dtype=np.uint8)))
    return ((places - np.arange(code.count)) << code.low_bits) | _low_part(code, 0, code.count)


def select(code: EliasFano, i: int) -> int:
    """Value number ``i`` without decoding the others: from the nearest hint, over one stretch of the bit vector."""
    if not 0 <= i < code.count:
        raise IndexError(i)
    hints = np.frombuffer(code.hints, dtype="<u4")
    block, rest = divmod(i, HINT_EVERY)
    begin = int(hints[block])
    end = int(hints[block + 1]) if block + 1 < len(hints) else len(code.high) * 8
    bits = np.unpackbits(np.frombuffer(code.high, dtype=np.uint8)[begin // 8 : (end + 7) // 8])[begin % 8 :]
    place = begin + int(np.flatnonzero(bits)[rest])
    return ((place - i) << code.low_bits) | int(_low_part(code, i, i + 1)[0])
