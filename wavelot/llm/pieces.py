"""Exact tokenising through the tokenizers library with a table of known chunks.

A text is cut where the tokenizer's own pre-tokeniser always cuts, so each chunk's ids don't depend
on its neighbours. The library encodes a chunk when it is first met; after that its ids come from
a table. A text that holds one of the vocabulary's added tokens goes to the library as a whole. The ids are
those of encoding the whole text at once (tests compare them).
"""

from __future__ import annotations

import re

import numpy as np

# The characters with Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters that lower-case one by one and that no normal form changes.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_END = r"(?=[ .,!?;:\n]|\Z)"
#: A plain word; else all up to white space; white space as far as a byte-level pre-tokeniser takes it.
BYTE_LEVEL = re.compile(rf" ?[{LATIN}]+{_END}| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: For tokenizers that drop white space.
BETWEEN_BLANKS = re.compile(rf"[{LATIN}]+{_END}|[^ \t\n\r]+")
PLAIN = re.compile(rf" ?[{LATIN}]+")
CHUNKS = {"byte_level": BYTE_LEVEL, "between_blanks": BETWEEN_BLANKS}


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """chunk -> number; unknown ones get the next number and wait in new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


class ChunkEncoder:
    """Encodes batches of texts to one flat array of ids and the number of ids of each text."""

    added = re.compile(r"(?!)")  # a vocabulary's added tokens

    def __init__(self, path: str, chunks: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if added:
            self.added = re.compile("|".join(map(re.escape, added)))
        self.pattern, self.most = CHUNKS[chunks], most
        self.lower = chunks == "between_blanks"
        # latin-1 text of the UTF-8 bytes -> the byte-level alphabet
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.forget()

    def forget(self) -> None:
        self.known = _Known()
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each chunk's. A plain word is one unit for the model; others go through the whole library."""
        model, whole, letters = self.tokenizer.model.tokenize, self.tokenizer.encode, self.letters
        flat: list[int] = []
        ends = []
        for c in chunks:
            if PLAIN.fullmatch(c):
                if self.lower:
                    c = c.lower()
                flat += [t.id for t in model(c.encode().decode("latin-1").translate(letters))]
            else:
                flat += whole(c, add_special_tokens=False).ids
            ends.append(len(flat))
        return np.array(flat, np.uint32), np.diff(ends, prepend=0)

    def _learn(self) -> None:
        if not self.known.new:
            return
        flat, length = self.encode_chunks(self.known.new)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, flat])
        self.known.new = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Null counts as the empty text."""
        if len(self.known) > self.most:
            self.forget()
        if any(text and self.added.search(text) for text in texts):
            return self._encode_each(texts)
        of, find, get = [], self.pattern.findall, self.known.__getitem__
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                of.append(np.fromiter(map(get, found := find(text)), np.int64, len(found)))
                counts[k] = len(found)
        self._learn()
        if not of:
            return np.zeros(0, np.uint32), counts
        chunk = np.concatenate(of)
        length = self.length[chunk]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(self.start[chunk] - (ends - length), length) + np.arange(int(length.sum()))]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(edges)

    def _encode_each(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, where some texts hold added tokens."""
        whole = [k for k, text in enumerate(texts) if text and self.added.search(text)]
        others = set(whole)
        ids, counts = self.encode([None if k in others else text for k, text in enumerate(texts)])
        own = np.split(ids, np.cumsum(counts)[:-1])
        for k in whole:
            own[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
            counts[k] = len(own[k])
        return np.concatenate(own), counts


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, chunks: str) -> ChunkEncoder:
    """One per Python worker, so that later tasks find the chunks of earlier ones."""
    if (path, chunks) not in _ENCODERS:
        _ENCODERS[path, chunks] = ChunkEncoder(path, chunks)
    return _ENCODERS[path, chunks]


def slices(texts: list[str | None], chars: int = 1_000_000):
    """Runs of texts with about so many characters, so that memory stays bounded: (from, to)."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > chars:
            yield begin, k
            begin, size = k, 0
        size += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)
