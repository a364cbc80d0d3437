"""CRC-32 of joined strings from the CRCs of their parts, for whole numpy arrays at once.

Appending n bytes to a string is linear in its CRC: the CRC of the joined string is the CRC of the first part moved over n
zero bytes, exclusive-or the CRC of the second part. Moving over 2 ** k zero bytes is kept as four tables of 256 entries, one
for each byte of the CRC.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

REFLECTED = 0xEDB88320  # fixed value: the polynomial of zlib's crc32


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """CRC register after one byte, for each value of the byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(REFLECTED), c >> 1).astype(np.uint32)
    return c


def _move(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low, high = tables[0][crc & 255] ^ tables[1][crc >> 8 & 255], tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]
    return low ^ high


@lru_cache(maxsize=64)
def mover(k: int) -> np.ndarray:
    """Tables that move a CRC over ``2 ** k`` zero bytes."""
    if k:
        half = mover(k - 1)
        return np.stack([_move(half, t) for t in half])
    bytes_ = [np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)]
    return np.stack([byte_table()[b & 255] ^ (b >> 8) for b in bytes_])


def joined(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRC of left + right from both CRCs and the number of bytes of the right part."""
    crc, rest, k = left.astype(np.uint32), np.asarray(right_bytes, np.int64), 0
    while rest.any():
        set_here = np.flatnonzero(rest & 1)
        crc[set_here] = _move(mover(k), crc[set_here])
        rest, k = rest >> 1, k + 1
    return crc ^ right.astype(np.uint32)


def with_byte(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRC of each string with one byte behind it."""
    register = ~crc.astype(np.uint32)
    return ~(byte_table()[(register ^ np.uint32(byte)) & 255] ^ (register >> 8))
