"""Word shingles of many texts at once, as hashes in numpy."""

from __future__ import annotations

import numpy as np

from wavelot.llm.hashing import SYMBOL, mix, powers

_BASE = np.uint64(0xD1342543DE82EF95)
# ASCII white space.
_WHITE = np.zeros(256, bool)
_WHITE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space) in order, the number of each text's words, and the words' bytes."""
    sizes = np.fromiter((len(d) + 1 for d in data), np.int64, len(data))
    b = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(data), np.int64), np.zeros(0, np.int64)
    inside = ~_WHITE[b]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, back = powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(SYMBOL[b] * power, dtype=np.uint64)])
    # the hash of a word at place s is shifted back by base^-s, so equal words agree wherever they stand
    h = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    count = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))
    return h, count, end - start


def sequences(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of each run of count words, 0 without words."""
    ends = np.cumsum(count)
    place = np.arange(len(h)) - np.repeat(ends - count, count)
    own = mix(h + mix(place.astype(np.uint64)))  # order matters
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
    whole = mix(run[ends] - run[ends - count] + count.astype(np.uint64))
    whole[count == 0] = 0
    return whole


def sequence_hashes(data: list[bytes]) -> np.ndarray:
    """A hash of each text's word sequence, 0 without words."""
    return sequences(*word_hashes(data)[:2])


def shingles(data: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: text number, hash, multiplicity; and a hash of each text's word sequence (0: no words).

    A text with fewer words than size has one shingle of all its words.
    """
    h, count, _ = word_hashes(data)
    ends = np.cumsum(count)
    starts = ends - count
    number = np.maximum(count - size + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(data)), number)
    at = starts[text] + np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    s = np.zeros(len(text), np.uint64)
    for k in range(size):
        part = padded[at + k]
        s = s * _BASE + np.where(at + k < ends[text], part, np.uint64(k + 1))
    s = mix(s)
    whole = sequences(h, count)
    order = np.lexsort((s, text))
    text, s = text[order], s[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (s[1:] != s[:-1])])[: len(s)]
    first = np.flatnonzero(new)
    return text[first], s[first], np.diff(np.append(first, len(s))), whole
