"""Patched frame-of-reference blocks of unsigned 32-bit ids.

A file is a header, an index and a payload, all little-endian:

    magic "PFR1", block size u32, ids u64, blocks u32, exceptions u32
    per block: minimum u32, width u8, first exception u32, first payload word u32
    exception positions u16, exception values u32
    payload: 64-bit words

Each block holds the ids less the block's minimum, packed at the width that the chosen percentile
of its values needs; wider values keep their low bits in place and their high bits in the
exception list. The index gives each block's start, so a reader can decode any range of ids.
The last block is filled up with its own minimum. An empty array is a file without blocks.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, _HEAD = b"PFR1", struct.Struct("<4sIQII")


def _layout(width: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and shift of each value, and the values that run on into the next word."""
    bit = np.arange(block, dtype=np.int64) * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    return word, shift, np.flatnonzero((bit & 63) + width > 64)


def encode(ids: np.ndarray, block: int = 128, percentile: float = 90.0) -> bytes:
    """block: a multiple of 64."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n, blocks = len(ids), -(-len(ids) // block)
    if not n:
        return _HEAD.pack(MAGIC, block, 0, 0, 0)
    values = np.empty(blocks * block, np.uint32)
    values[:n] = ids
    values[n:] = ids[(blocks - 1) * block :].min()
    values = values.reshape(blocks, block)
    low = values.min(axis=1)
    delta = values - low[:, None]
    bits = np.frexp(delta.astype(np.float64))[1].astype(np.uint8)
    k = min(block - 1, int(block * percentile / 100))
    width = np.partition(bits, k, axis=1)[:, k]
    row, at = np.nonzero(bits > width[:, None])
    high = delta[row, at] >> width[row]
    first_exception = np.searchsorted(row, np.arange(blocks)).astype(np.uint32)
    words = width.astype(np.int64) * (block // 64)
    first_word = np.cumsum(words) - words
    payload = np.zeros(int(words.sum()), np.uint64)
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        word, shift, over = _layout(int(w), block)
        v = delta[rows].astype(np.uint64) & np.uint64((1 << int(w)) - 1)
        packed = np.bitwise_or.reduceat(v << shift, np.searchsorted(word, np.arange(int(w) * (block // 64))), axis=1)
        packed[:, word[over] + 1] |= v[:, over] >> (np.uint64(64) - shift[over])
        payload[first_word[rows][:, None] + np.arange(packed.shape[1])] = packed
    return b"".join([
        _HEAD.pack(MAGIC, block, n, blocks, len(row)),
        low.astype("<u4").tobytes(), width.tobytes(), first_exception.astype("<u4").tobytes(), first_word.astype("<u4").tobytes(),
        at.astype("<u2").tobytes(), high.astype("<u4").tobytes(), payload.astype("<u8").tobytes(),
    ])


class Reader:
    """Decodes ranges of ids of one file's bytes."""

    def __init__(self, data: bytes):
        magic, self.block, self.n, blocks, exceptions = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        place = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(data, kind, count, place)
            place += out.nbytes
            return out

        self.low, self.width, self.first_exception, self.first_word = take("<u4", blocks), take("u1", blocks), take("<u4", blocks), take("<u4", blocks)
        self.at, self.high = take("<u2", exceptions), take("<u4", exceptions)
        self.payload = np.frombuffer(data, "<u8", (len(data) - place) // 8, place)

    def read(self, start: int, count: int) -> np.ndarray:
        """The ids start, start + 1, ..., touching only the blocks that hold them."""
        if start < 0 or count < 0 or start + count > self.n:
            raise IndexError("range is outside the file")
        if not count:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-(start + count) // self.block)
        width = self.width[a:b]
        out = np.zeros((b - a, self.block), np.uint32)
        for w in np.unique(width):
            if not w:
                continue
            rows = np.flatnonzero(width == w)
            word, shift, over = _layout(int(w), self.block)
            packed = self.payload[self.first_word[a:b][rows].astype(np.int64)[:, None] + np.arange(int(w) * (self.block // 64))]
            v = packed[:, word] >> shift
            v[:, over] |= packed[:, word[over] + 1] << (np.uint64(64) - shift[over])
            out[rows] = (v & np.uint64((1 << int(w)) - 1)).astype(np.uint32)
        lo = int(self.first_exception[a])
        hi = int(self.first_exception[b]) if b < len(self.first_exception) else len(self.at)
        row = np.searchsorted(self.first_exception[a:b], np.arange(lo, hi), side="right") - 1
        out[row, self.at[lo:hi]] |= self.high[lo:hi] << width[row]
        out += self.low[a:b, None]
        return out.reshape(-1)[start - a * self.block : start - a * self.block + count]
