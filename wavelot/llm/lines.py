"""Fuzzy line dedup.

Lines are normalised (lower case, words only) and equal normal forms are one node. Candidates are nodes that share a bucket; every candidate is
verified by the edit similarity of the normal forms. In each connected group the first occurrence, by (doc_id, hash of the text,
line number), stays; all others go. Buckets come from one of two sources:

* differ=None, as the queries use it: a link means edit similarity >= threshold alone. MinHash of the weighted words gives `BANDS` buckets of
  `ROWS` minima a line; lines under `SHORT` characters add all their forms with as many deletions as the threshold lets them differ
  by, which misses no pair of short lines. MinHash can miss a pair; the README gives the measured recall.
* differ=n: 64-bit SimHash of the words. Two hashes that differ in at most n bits agree in some `keep` of the `blocks` blocks (pigeonhole), so
  lines are joined on every choice of `keep` blocks. A link means Hamming distance <= n and edit similarity >= threshold.

Defined results: lines without anything but white space always stay and aren't counted as removed. A line without words stands for itself, its white
space collapsed. Null texts have no lines and stay null. Rows that repeat doc_id and text get equal results (each keeps the lines that the first
of them keeps). A null doc_id comes first. Long texts are taken a run of lines at a time, so memory follows the longest line. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelot.llm.common import cut, giving_back, join_hot, scratch, thin
from wavelot.llm.hashing import mix, powers
from wavelot.llm.links import across_links, components, packed_star_pairs
from wavelot.llm.sieve import sift
from wavelot.llm.shingles import sequences, word_hashes

BANDS, ROWS, AGREE, SHORT, LONG, SLICE = 16, 4, 10, 15, 4000, 128_000
_WORD = re.compile(r"\w+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FAR = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)  # exponential waiting times by their 16 bits
_PAIRS = 512


def normal_form(line: str) -> str:
    return " ".join(_WORD.findall(line.lower())) or " ".join(line.split())


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point below U+10000: part of a word, white space, a random symbol."""
    signs = "".join(" " if 0xD800 <= i < 0xE000 else chr(i) for i in range(1 << 16))
    word, white = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
    for m in _WORD.finditer(signs):
        word[m.start() : m.end()] = True
    for m in re.finditer(r"\s+", signs):
        white[m.start() : m.end()] = True
    return word, white, mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * _GOLDEN)


def _classes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part of a word, any sign, and symbol of each code point."""
    word, white, symbol = _tables()
    low = np.minimum(codes, 0xFFFF)
    is_word, sign, own = word[low], ~white[low], symbol[low]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        own[high] = mix((codes[high].astype(np.uint64) + np.uint64(1)) * _GOLDEN)
        sign[high] = True
        kinds, of = np.unique(codes[high], return_inverse=True)
        is_word[high] = np.array([bool(_WORD.match(chr(c))) for c in kinds.tolist()])[of]
    return is_word, sign, own


class Lines:
    """The lines with a sign of some texts. row: number of the text; number: of the line in it; words, count, length: hashes of all
    words, how many a line has, their lengths; norm: hash of each normal form; forms: the normal forms."""

    def __init__(self, texts: list[str], first: list[int]):
        lowered = [t.lower() for t in texts]
        codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "replace"), np.uint32)
        is_word, sign, symbol = _classes(codes)
        ends = np.append(np.flatnonzero(codes == 10), len(codes))
        starts = np.concatenate([[0], ends[:-1] + 1])
        own = np.fromiter((t.count("\n") + 1 for t in lowered), np.int64, len(lowered))
        row = np.repeat(np.arange(len(own)), own)
        number = np.arange(len(row)) - np.repeat(np.cumsum(own) - own - np.array(first, np.int64), own)
        up_to = lambda x: np.concatenate([[0], np.cumsum(x)])
        signs, in_words = up_to(sign), up_to(is_word)
        some = signs[ends] > signs[starts]
        for i in np.flatnonzero(some & (in_words[ends] == in_words[starts])).tolist():
            is_word[starts[i] : ends[i]] = sign[starts[i] : ends[i]]
        edge = np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, back = powers(len(codes) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbol * power[: len(codes)], dtype=np.uint64)])
        self.words, self.length = mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64)), b - a
        count = np.diff(np.searchsorted(a, np.append(starts, len(codes) + 1)))
        self.row, self.number, self.count = row[some], number[some], count[some]
        self.norm = sequences(self.words, self.count)
        # a form: the signs of its words, and one blank after each word but the line's last
        line = np.repeat(np.arange(len(self.count)), self.count)
        more = np.append(line[1:] == line[:-1], False)[: len(b)]
        taken = is_word.copy()
        taken[b[more]] = True
        codes = np.where(is_word, codes, np.uint32(32))[taken]
        whole = codes.tobytes().decode("utf-32-le", "replace")
        size = np.bincount(line, self.length + more, len(self.count)).astype(np.int64)
        cuts = up_to(size).tolist()
        self.size = size
        self.forms = [whole[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


def runs_of_lines(texts: list[str | None], most: int = SLICE) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Text numbers, parts and the number of each part's first line, so that parts make up about `most` characters. Long texts are cut at line ends."""
    rows, parts, first, held = [], [], [], 0
    for i, text in enumerate(texts):
        at, number = 0, 0
        while text and at < len(text):
            end = len(text)
            if end - at > most:
                end = text.rfind("\n", at, at + most)
                end = text.find("\n", at + most) if end < 0 else end
                end = len(text) if end < 0 else end
            rows.append(i)
            parts.append(text[at:end])
            first.append(number)
            held += end - at + 1
            if end < len(text):
                number += text.count("\n", at, end) + 1
            at = end + 1
            if held > most:
                yield rows, parts, first
                rows, parts, first, held = [], [], [], 0
    if parts:
        yield rows, parts, first


def simhashes(data: list[bytes]) -> np.ndarray:
    """64-bit SimHash of each text's words, with multiplicity. A word weighs the square of its length (15 at most), so
    that the short words which most lines share don't pull their hashes together."""
    return _simhashes(*word_hashes(data))


def _simhashes(h: np.ndarray, count: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        starts = (np.cumsum(count) - count)[some]
        weight = np.minimum(size, 15).astype(np.uint8) ** 2
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1) * weight[:, None]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        total = np.add.reduceat(weight, starts, dtype=np.int32)
        out[some] = np.packbits(2 * ones > total[:, None], axis=1).view(np.uint64)[:, 0]
    return out


def band_keys(h: np.ndarray, count: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines x BANDS: hashes of ROWS minima each over a line's words; and lines x minima: a byte of each. Words weigh as in simhashes, so two lines
    agree in a minimum about as often as the weight of their words is shared. Each minimum serves in two bands; two bands share one at most."""
    n = BANDS * ROWS // 2
    low = np.empty((n, len(count)), np.uint64)
    if len(count):
        starts = np.cumsum(count) - count
        scale = 1 / np.minimum(size, 15).astype(np.float32) ** 2
        for k in range(0, n, 4):
            own = mix(h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.uint16).reshape(-1, 4)
            for j in range(4):
                low[k + j] = np.minimum.reduceat(_FAR[own[:, j]] * scale, starts).view(np.uint32)
    half = BANDS // 2
    chosen = [range(b * ROWS, b * ROWS + ROWS) for b in range(half)] + [range(b, n, half) for b in range(half)]
    out = np.empty((len(count), BANDS), np.uint64)
    for b, rows in enumerate(chosen):
        key = np.full(len(count), b + 1, np.uint64)
        for k in rows:
            key = mix(key ^ low[k])
        out[:, b] = key
    return out, (mix(low) >> np.uint64(56)).astype(np.uint8).T


def deletion_keys(form: str, threshold: float) -> list[int]:
    """Hashes of what a short form leaves when as many characters go as two forms of its length may differ by."""
    if len(form) >= SHORT:
        return []
    left = every = {form}
    for _ in range(int((1 - threshold) * len(form) + 1e-9)):
        left = {x[:i] + x[i + 1 :] for x in left for i in range(len(x))}
        every = every | left
    return [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little") for x in every] if len(every) > 1 else []


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, bit-parallel over the shorter string. Above most, if given, any larger number may come back."""
    a, b = _middles(a, b)
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, distance = full, 0, len(a)
    least = (len(a) + len(b) if most is None else most) + len(b)
    for c in b:
        least -= 1  # the rest of b can take away one each at most
        same = where.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus, minus = down | ~(diagonal | up), up & diagonal
        distance += bool(plus & top) - bool(minus & top)
        if distance > least:
            return distance
        plus, minus = (plus << 1) | 1, minus << 1
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal & full
    return distance


def _middles(a, b):
    """a and b without what they share at their beginnings and ends."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    m = 0
    while m < most - n and a[-1 - m] == b[-1 - m]:
        m += 1
    return a[n : len(a) - m], b[n : len(b) - m]


def pair_profile(forms: list[str]) -> np.ndarray:
    """Forms x _PAIRS: how many pairs of neighbouring characters fall into each class, 16,383 at most."""
    size = np.fromiter(map(len, forms), np.int64, len(forms))
    c = np.frombuffer("".join(forms).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(forms)), size)
    kind = (c[:-1] * np.uint32(37) + c[1:]) & np.uint32(_PAIRS - 1)
    same = row[:-1] == row[1:]
    count = np.bincount((row[:-1] * _PAIRS + kind)[same], minlength=len(forms) * _PAIRS)
    return np.minimum(count, (1 << 14) - 1).astype(np.int16).reshape(len(forms), _PAIRS)


def apart(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """By how much rows i of profile x differ from rows j of profile y. An edit takes two pairs of characters at most and brings two, so
    forms that differ by d edits are apart by 4 d at most."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 2048):
        out[at : at + 2048] = np.abs(x[i[at : at + 2048]] - y[j[at : at + 2048]]).sum(axis=1, dtype=np.int64)
    return out


def edit_similarity(a: str, b: str) -> float:
    return 1 - edit_distance(a, b) / max(len(a), len(b), 1)


def distance_by_words(x: list[str], y: list[str], most: int) -> int:
    """A distance that is never too small: the words that occur once in both and keep their order hold still, what lies between them is
    compared by itself. Above most, or with few such words, any larger number."""
    once = lambda words: {w: i for i, w in enumerate(words) if w not in seen and not seen.add(w)}
    seen: set[str] = set()
    at = once(y)
    twice = {w for w, i in at.items() if w in y[i + 1 :]} if len(at) < len(y) else set()
    seen = set()
    mine = once(x)
    twice |= {w for w, i in mine.items() if w in x[i + 1 :]} if len(mine) < len(x) else set()
    common = [(i, at[w]) for w, i in mine.items() if w in at and w not in twice]
    ends: list[int] = []  # the longest run of words in one order, by patience sorting
    last: list[int] = []
    before = [-1] * len(common)
    for k, (_, j) in enumerate(common):
        place = bisect_left(ends, j)
        before[k] = last[place - 1] if place else -1
        ends[place : place + 1] = [j]
        last[place : place + 1] = [k]
    if 16 * len(ends) < len(x):
        return most + 1
    chain, k = [(len(x), len(y))], last[-1] if last else -1
    while k >= 0:
        chain.append(common[k])
        k = before[k]
    apart, i, j = [], 0, 0
    for p, q in reversed(chain):
        if x[i:p] != y[j:q]:
            apart.append((" ".join([*x[i:p], ""]), " ".join([*y[j:q], ""])))
        i, j = p + 1, q + 1
    total = sum(max(len(p), len(q)) for p, q in apart)
    for p, q in apart:
        if total <= most:
            break
        total += edit_distance(p, q) - max(len(p), len(q))
    return total


def alike(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Which pairs of forms are at most so many edits apart. Those that differ in one short run of words need no distance; the others are
    compared many at a time, or by themselves above LONG characters."""
    out, rest = np.zeros(len(a), bool), []
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = _middles(p.split(" "), q.split(" "))
        m, n = sum(map(len, x)) + len(x), sum(map(len, y)) + len(y)  # with a blank after each word, so the distance is that of the whole forms
        out[i] = max(m, n) <= most[i]
        if not out[i] and max(m, n) > LONG:
            out[i] = distance_by_words(x, y, most[i]) <= most[i] or edit_distance(p, q, int(most[i])) <= most[i]
        elif not out[i] and abs(m - n) <= most[i]:
            rest.append((max(m, n), i, " ".join([*x, ""]), " ".join([*y, ""])))
    rest.sort()
    while rest:
        longest = rest[-1][0]
        step = max(64, min(1024, 300_000 // longest))
        step = max(min(256, len(rest[-step:])), len(rest[-step:]) - bisect_left(rest[-step:], (int(0.6 * longest),)))  # of about one length, if many
        _, part, x, y = map(list, zip(*rest[-step:], strict=True))
        del rest[-step:]
        if step < 24:
            out[part] = [edit_distance(p, q, k) <= k for p, q, k in zip(x, y, most[part].tolist(), strict=True)]
        else:
            out[part] = banded_distances(x, y, most[part]) <= most[part]
    return out


def banded_distances(a: list[str], b: list[str], most: int | np.ndarray, held: int = 8 << 20) -> np.ndarray:
    """Levenshtein distances of pairs of strings of about one length, where they are at most `most`; else any larger number. Bit-parallel as in edit_distance, 64 places of a
    in a word, all pairs and words at a time. Only words in the band are filled, from where a pair can still come to its end within `most`; beyond it
    values count as growing by one each place, so none comes out too small. held: about how many bytes the places of all signs may take."""
    size, other = (np.fromiter(map(len, s), np.int64, len(s)) for s in (a, b))
    limit = np.broadcast_to(np.asarray(most, np.int64), len(a))
    out = np.where(np.minimum(size, other) == 0, np.maximum(size, other), limit + 1)
    who = np.flatnonzero((np.abs(size - other) <= limit) & (np.minimum(size, other) > 0))
    if not len(who):
        return out
    x, y = (np.frombuffer("".join([s[i] for i in who.tolist()]).encode("utf-32-le", "replace"), np.uint32) for s in (a, b))
    used = np.zeros(int(max(x.max(), y.max())) + 1, bool)
    used[x] = used[y] = True
    kind = np.cumsum(used, dtype=np.int32) - 1
    kinds, words = int(used.sum()) + 1, int(size[who].max() + 63) // 64
    if len(who) > 32 and 8 * words * kinds * len(who) > held:
        for part in np.array_split(who, 2):
            out[part] = banded_distances([a[i] for i in part.tolist()], [b[i] for i in part.tolist()], limit[part], held)
        return out

    def by_place(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Places x pairs: kinds of the signs, and the last kind beyond a string's end."""
        of = np.full((len(n), n.max()), kinds - 1, np.int32)
        of[np.arange(n.max()) < n[:, None]] = kind[codes]
        return np.ascontiguousarray(of.T)

    base = np.arange(len(who)) * kinds
    places = np.zeros((words, len(who) * kinds), np.uint64)  # the places of each sign in a
    for i, k in enumerate(by_place(x, size[who])):
        places[i >> 6][base + k] |= np.uint64(1 << (i & 63))
    y, begin = by_place(y, other[who]) + base, np.arange(words)[:, None] * places.shape[1]
    full, top, one = np.uint64((1 << 64) - 1), np.uint64(63), np.uint64(1)
    up, down, score = (np.zeros((words, len(who)), kind) for kind in (np.uint64, np.uint64, np.int64))  # score: the distance at the last place of each word
    rise, fall = np.ones((words + 1, len(who)), np.uint64), np.zeros((words + 1, len(who)), np.uint64)  # by how much it grew or fell above each word

    def left() -> tuple[np.ndarray, np.ndarray, set[int], list[int], list[int]]:
        """Of the pairs that are left: the word and the step in which each ends, all these steps, and of each step the first word and the one after its last."""
        more = size[who] - other[who]
        under, over = int((-((limit[who] - more) // 2)).min()), int(((limit[who] + more) // 2).max()) + 1
        word, w = (size[who] - 1) >> 6, np.arange(words)
        step = other[who] + word
        steps = np.arange(len(y) + words)
        lows = np.searchsorted(np.minimum(64 * w + 64 - under, len(y)) + w, steps)
        return word, step, set(step.tolist()), lows.tolist(), np.searchsorted(np.maximum(1, 64 * w - over + 1) + w, steps, side="right").tolist()

    # all words at once: in step t word w is at place t - w of b, so what the word above it passed on is from the step before
    word, step, ends, lows, highs = left()
    filled = low = 0
    for t in range(1, len(y) + words):
        before, low = low, lows[t]
        for w in range(filled, highs[t]):
            score[w] = 64 + (score[w - 1] - rise[w].view(np.int64) + fall[w].view(np.int64) if w else 0)
            up[w], down[w] = full, 0
        filled = highs[t]  # fewer, where the band has become narrower: what is left out starts anew
        now = slice(low, filled)
        same, p, q, minus_in = places.take(y[t - filled : t - low][::-1] + begin[now]), up[now], down[now], fall[now]
        vertical = same | q
        same |= minus_in
        diagonal = same & p
        diagonal += p
        diagonal ^= p
        diagonal |= same
        plus = diagonal | p
        np.invert(plus, out=plus)
        plus |= q
        diagonal &= p  # from here on, where the distance falls along b
        plus_out, minus_out = plus >> top, diagonal >> top
        score[now] += plus_out.view(np.int64)
        score[now] -= minus_out.view(np.int64)
        plus <<= one
        plus |= rise[now]
        diagonal <<= one
        diagonal |= minus_in
        np.bitwise_or(vertical, plus, out=p)
        np.invert(p, out=p)
        p |= diagonal
        np.bitwise_and(plus, vertical, out=q)
        rise[low + 1 : filled + 1], fall[low + 1 : filled + 1] = plus_out, minus_out
        if low > before:
            rise[before + 1 : low + 1], fall[before + 1 : low + 1] = 1, 0
        if t in ends:
            end = np.flatnonzero(step == t)
            w, z = word[end], ((size[who[end]] - 1) & 63).astype(np.uint64)
            below = (full << z) << one
            total = score[w, end] - np.bitwise_count(up[w, end] & below) + np.bitwise_count(down[w, end] & below)
            out[who[end]] = np.where((w >= low) & (w < filled), total, out[who[end]])
            ends.discard(t)
            if not ends:  # the words of longer pairs, which were left, may begin only after a gap: there the band holds no word
                break
        if t % 64 == 0:
            # a pair goes on if a word holds a place that is near enough to its end, or the place before it does
            off = 64 * np.arange(low, filled)[:, None] + np.arange(low, filled)[:, None] + 1 - t - (size[who] - other[who])
            least = (score[now] - np.bitwise_count(p) + np.maximum(np.maximum(off, -63 - off), 0)).min(axis=0) - 2
            go = (least <= limit[who]) & (step > t)
            if go.sum() < 0.8 * len(who):
                who = who[go]
                if not len(who):
                    break
                y, up, down, score, rise, fall = (np.ascontiguousarray(z[:, go]) for z in (y, up, down, score, rise, fall))
                word, step, ends, lows, highs = left()
    return out


def _blocks(n: int, differ: int) -> tuple[int, int]:
    """Blocks and how many of them must agree, so that chance agreement stays rare among n hashes."""
    for blocks in range(differ + 1, differ + 6):
        if 64 * (blocks - differ) // blocks >= max(16, n.bit_length() + 3):
            break
    return blocks, blocks - differ


def _masks(blocks: int, keep: int) -> list[int]:
    """The bits of each choice of blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [reduce(lambda x, i: x | (((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]), chosen, 0) for chosen in combinations(range(blocks), keep)]


def _line_rows(rows: DataFrame, threshold: float, masks: list[int] | None) -> DataFrame:
    """rows: doc_id, text, h. Per line with a sign: doc_id, h, line, norm (hash of the normal form), form and keys, its buckets."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h = batch.column("doc_id"), batch.column("h")
            for rows_of, parts, first in runs_of_lines(batch.column("text").to_pylist()):
                x = Lines(parts, first)
                if masks is None:
                    keys, sketch = band_keys(x.words, x.count, x.length)
                    more = {i: d for i in np.flatnonzero(x.size < SHORT).tolist() if (d := deletion_keys(x.forms[i], threshold))}
                else:
                    sim = _simhashes(*word_hashes([f.encode("utf-8", "replace") for f in x.forms]))
                    keys = np.stack([mix((sim & np.uint64(m)) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k, m in enumerate(masks)], axis=1)
                    more, sketch = {}, sim.view(np.uint8).reshape(-1, 8)
                wide = np.full(len(x.norm), keys.shape[1])
                for i, d in more.items():
                    wide[i] += len(d)
                begin = np.concatenate([[0], np.cumsum(wide)])
                flat = np.empty(begin[-1], np.uint64)
                flat[(begin[:-1, None] + np.arange(keys.shape[1])).reshape(-1)] = keys.reshape(-1)
                for i, d in more.items():
                    flat[begin[i] + keys.shape[1] : begin[i + 1]] = d
                at = pa.array(np.array(rows_of, np.int64)[x.row])
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat.view(np.int64)))
                columns = [ids.take(at), h.take(at), pa.array(x.number), pa.array(x.norm.view(np.int64)), pa.array(x.forms, pa.string()), lists]
                edges = pa.py_buffer((np.arange(len(sketch) + 1) * sketch.shape[1]).astype(np.int32))
                columns.append(pa.Array.from_buffers(pa.binary(), len(sketch), [None, edges, pa.py_buffer(np.ascontiguousarray(sketch))]))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "line", "norm", "form", "keys", "sketch"])

    return rows.mapInArrow(run, "doc_id long, h long, line long, norm long, form string, keys array<long>, sketch binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))


def duplicate_lines(docs: DataFrame, threshold: float = 0.8, differ: int | None = 3, id_col: str = "doc_id", text_col: str = "text", lines_a_doc: int = 32) -> DataFrame:
    """Per occurrence that goes: doc_id, h (xxhash64 of the text), line (number from 0), distinct. differ=None: links by edit similarity alone.

    lines_a_doc: for differ only, a guess from which the width of the blocks follows; results don't depend on it."""
    spark = docs.sparkSession
    rows, path = _rows(docs, id_col, text_col), scratch(docs.sparkSession, "lines")
    masks = None if differ is None else _masks(*_blocks(docs.count() * lines_a_doc, differ))
    _line_rows(rows, threshold, masks).write.option("compression", "zstd").parquet(path)
    lines = spark.read.parquet(path)
    n_keys = lines.count() * (BANDS if masks is None else len(masks))
    pairs, crowded = packed_star_pairs(lines.select(F.col("norm").alias("id"), "keys"), n_keys)
    pairs = cut(pairs)
    pairs = thin(pairs, pairs.count())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowded.select("id")).distinct()
    path = scratch(spark, "forms")
    forms = sift(lines.select("norm", "form", "keys", "sketch"), "norm", ids).dropDuplicates(["norm"])
    forms = forms.select(F.col("norm").alias("id"), "form", "keys", "sketch", (F.octet_length("form") + 8 * F.size("keys")).alias("size"))
    forms.write.option("compression", "zstd").parquet(path)
    forms = spark.read.parquet(path)

    def may_link(x: np.ndarray, y: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Rows of sketches; short: for which of them words say nothing."""
        if differ is None:
            return short | ((x == y).sum(axis=1) >= AGREE)
        return np.bitwise_count(x ^ y).sum(axis=1) <= differ

    def by_length(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many edits forms of these lengths may be apart, and whether their lengths allow a link."""
        most = ((1 - threshold) * np.maximum(np.maximum(x, y), 1) + 1e-9).astype(np.int64)
        return most, np.abs(x - y) <= most

    @giving_back
    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for pdf in batches:
            held.append(pdf)
            if len(held) == 8:  # many pairs at a time are cheaper; Arrow batches are small
                yield which(pd.concat(held, ignore_index=True))
                held = []
        if held:
            yield which(pd.concat(held, ignore_index=True))

    def which(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["fa"], pdf["fb"]
        hit = np.zeros(len(a), bool)
        if len(a):
            sketch = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1)
            p, q = a.str.len().to_numpy(), b.str.len().to_numpy()
            most, hit = by_length(p, q)
            hit &= may_link(sketch(pdf["sa"]), sketch(pdf["sb"]), np.minimum(p, q) < SHORT)
            for some in np.array_split(np.flatnonzero(hit), len(a) // 1000 + 1):
                at = np.arange(len(some))
                hit[some] = apart(pair_profile(a.iloc[some].tolist()), at, pair_profile(b.iloc[some].tolist()), at) <= 4 * most[some]
            some = np.flatnonzero(hit)
            hit[some] = alike(a.iloc[some].tolist(), b.iloc[some].tolist(), most[some])
        return pdf.loc[hit, ["a", "b"]]

    def prepare(pdf: pd.DataFrame):
        form, length = pdf["form"].tolist(), pdf["form"].str.len().to_numpy()
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        keys, bucket = [set(k.tolist()) for k in pdf["keys"]], pdf["bucket"].tolist()
        profile: list[np.ndarray] = []

        def may(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            most, hit = by_length(length[i], length[j])
            hit &= may_link(sketch[i], sketch[j], np.minimum(length[i], length[j]) < SHORT)
            some, gap = np.flatnonzero(hit), np.zeros(len(i))
            if len(some):
                if not profile:
                    profile.append(pair_profile(form))
                differ_by = apart(profile[0], i[some], profile[0], j[some])
                hit[some] = differ_by <= 4 * most[some]
                gap[some] = differ_by / (4 * most[some] + 1)
            return hit, gap

        def sure(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            # a pair that shares several buckets is looked at in the first of them
            here = np.array([min(keys[x] & keys[y]) == bucket[x] for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
            i, j = i[here], j[here]
            here[here] = alike([form[x] for x in i], [form[x] for x in j], by_length(length[i], length[j])[0])
            return here

        return may, sure

    one = forms.select(F.col("id").alias("a"), F.col("form").alias("fa"), F.col("sketch").alias("sa"))
    two = forms.select(F.col("id").alias("b"), F.col("form").alias("fb"), F.col("sketch").alias("sb"))
    links = cut(pairs.join(one, "a").join(two, "b").mapInPandas(linked, "a long, b long"))
    groups = components(links)
    more = cut(across_links(crowded, groups, forms, prepare, block=512, in_bulk=True).select("a", "b").distinct())
    if more.limit(1).count():
        groups = components(links.unionByName(more))
    return _removed(lines.select("doc_id", "h", "line", "norm"), groups)


def _removed(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """The lines that aren't the first of their group."""
    often = lines.groupBy("norm").agg(F.count("*").alias("n")).where("n > 1").select("norm")
    groups = groups.select(F.col("node").alias("norm"), "component")
    group = cut(often.unionByName(groups.select("norm")).distinct().join(groups, "norm", "left").select("norm", F.coalesce("component", "norm").alias("component")))
    own = cut(join_hot(cut(sift(lines, "norm", group.select("norm"))), group, "norm").select("doc_id", "h", "line", "component"))
    keep = own.groupBy("component").agg(F.min(F.struct("doc_id", "h", "line")).alias("keep"))
    return join_hot(own, keep, "component").where(~F.struct("doc_id", "h", "line").eqNullSafe(F.col("keep"))).select("doc_id", "h", "line").distinct()


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_lines (with a sign), n_removed and removed_lines, their numbers in order."""
    gone = duplicate_lines(docs, id_col=id_col, text_col=text_col, **options).groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"(?U)\S")))
    rows = _rows(docs, id_col, text_col).select("doc_id", "h", count.cast("long").alias("n_lines"))
    gone = gone.select(F.col("doc_id").alias("d"), F.col("h").alias("gh"), "removed")
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("gh")), "left")
    removed = F.coalesce("removed", F.array().cast("array<long>"))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    """Texts without the lines of these numbers."""

    def left(text: str | None, gone: np.ndarray | None) -> str | None:
        if text is None or gone is None:
            return text
        gone = set(gone.tolist())
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    return pd.Series([left(t, g) for t, g in zip(texts, removed, strict=True)], dtype=object)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with their text less the lines that go; all columns and rows stay."""
    gone = duplicate_lines(docs, id_col=id_col, text_col=text_col, **options).groupBy("doc_id", "h").agg(F.collect_list("line").alias("removed"))
    gone = gone.select(F.col("doc_id").alias("d"), F.col("h").alias("gh"), "removed")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("own"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    gone = cut(gone)
    maybe = sift(rows, "h", gone.select("gh"), keep=True)  # texts that lose nothing stay out of the shuffle
    joined = maybe.where("sifted").join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("gh")), "left").select("own", "text", "removed")
    joined = joined.unionByName(maybe.where("not sifted").select("own", "text", F.lit(None).cast("array<long>").alias("removed")))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(_without("text", "removed"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("own").getField(c).alias(c) for c in docs.columns])
