"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The vocabulary is a byte-pair model: its pieces merge by rank. For such a model each prefix of
a text has exactly one last piece, the one whose pair with the last piece before it would itself be encoded as
those two pieces. So the Viterbi lattice keeps one backpointer per character boundary, and a path step is allowed
only between compatible pieces. Only a window of boundaries bounded by the longest piece can still be
pointed at; as soon as all backpointers of the window lead to one boundary, the ids before it are committed and forgotten.
Between two committed boundaries that every piece respects (a space mark starts), a chunk's ids depend on nothing else,
so they are kept in a table for the next time the chunk occurs.

Characters without a piece become byte pieces. Decoding joins the pieces, turns byte pieces into bytes and
drops the one space that encoding puts before the text.

Defined results: a null text counts as empty and has no ids. Repeated rows are encoded one by one. An empty
table gives an empty result. A lone surrogate is replaced by '?'. Ids equal those of the sentencepiece library (tests compare).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wavelot.llm.common import texts
from wavelot.llm.pieces import LATIN, ChunkEncoder, slices

MARK = "▁"
#: A run of space marks with the word after it, or a word at the very start.
CHUNK = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: The same, and plain words apart from the signs after them, for vocabularies in which no piece joins the two.
FINE = re.compile(rf"{MARK}*[{LATIN}]+(?=[{MARK}.,!?;:\n]|\Z)|{MARK}+[^{MARK}]*|[^{MARK}]+")
_JOINED = re.compile(rf"[{LATIN}][.,!?;:\n]|[^{MARK}]{MARK}")
ENCODED = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, decoded_sha256 string"


class PieceModel:
    """The vocabulary as plain tables."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        kind = [(model.is_byte(i), model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in range(n) if kind[i][0]}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not any(kind[i])}
        self.score = [model.get_score(i) for i in range(n)]
        self.longest = max(map(len, self.id_of))
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self._merged: dict[str, list[str]] = {}
        self._fits: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Plain byte-pair merging of a short text: the definition that compatibility rests on."""
        if text not in self._merged:
            parts = list(text)
            while True:
                best = None
                for i in range(len(parts) - 1):
                    k = self.id_of.get(parts[i] + parts[i + 1])
                    if k is not None and (best is None or self.score[k] > best[0]):
                        best = (self.score[k], i)
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(self._merged) > 200_000:
                self._merged.clear()
            self._merged[text] = parts
        return self._merged[text]

    def compatible(self, a: str, b: str) -> bool:
        """Whether a then b stays a then b when encoded."""
        if (a, b) not in self._fits:
            if len(self._fits) > 400_000:
                self._fits.clear()
            self._fits[a, b] = self.merge(a + b) == [a, b]
        return self._fits[a, b]


def stream_pieces(model: PieceModel, symbols: Iterator[str]) -> Iterator[str]:
    """Pieces of a stream of characters, yielded once no later character can change them.

    Memory: the characters since the last commit. Once these are more than `longest`, each new
    boundary looks where the backpointers of the window meet and commits all before it.
    """
    text = ""  # characters after the committed boundary
    last = [""]  # last[k]: the last piece of the prefix that ends k characters after it
    longest, id_of, fits = model.longest, model.id_of, model.compatible
    for c in symbols:
        text += c
        n = len(text)
        found = c
        for start in range(n - 1, max(0, n - longest) - 1, -1):
            piece = text[start:]
            if (piece in id_of or start == n - 1) and ((start == 0 and not last[0]) or fits(last[start], piece)):
                found = piece
                break
        last.append(found)
        if n > longest and (meet := _meeting(last, longest)) > 0:
            yield from _path(last, meet)
            text, last = text[meet:], last[meet:]
    yield from _path(last, len(text))


def _meeting(last: list[str], longest: int) -> int:
    """The latest boundary through which the paths of all boundaries in the window go, 0 if only the committed one."""
    n = len(last) - 1
    ends = set(range(max(0, n - longest + 1), n + 1))
    while len(ends) > 1:
        k = max(ends)
        ends.discard(k)
        ends.add(max(0, k - len(last[k])))
    return ends.pop()


def _path(last: list[str], end: int) -> list[str]:
    out = []
    while end > 0:
        out.append(last[end])
        end -= len(last[end])
    return out[::-1]


class PieceEncoder(ChunkEncoder):
    """Ids of texts under a byte-pair SentencePiece model."""

    def __init__(self, path: str, most: int = 200_000):
        self.model, self.most = PieceModel(path), most
        joined = [p for p in self.model.id_of if _JOINED.search(p)]
        if any(MARK in p.lstrip(MARK) for p in joined):
            raise ValueError("pieces of this vocabulary run across spaces")
        self.pattern = CHUNK if joined else FINE
        self.forget()

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        model = self.model
        ids: list[int] = []
        ends = []
        for chunk in chunks:
            for piece in stream_pieces(model, iter(chunk)):
                k = model.id_of.get(piece)
                ids += [k] if k is not None else [model.byte_id[b] for b in piece.encode("utf-8", "replace")]
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(ends, prepend=0)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return super().encode([MARK + t.replace(" ", MARK) if t else None for t in texts])

    def decode(self, ids: np.ndarray) -> str:
        model, out = self.model, bytearray()
        for i in ids.tolist():
            if i in model.byte_of:
                out.append(model.byte_of[i])
            else:
                out += model.pieces[i].encode()
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def decoder_table(model: PieceModel) -> list[bytes]:
    return [bytes([model.byte_of[i]]) if i in model.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(model.pieces)]


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id and ids (array<int>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = piece_encoder(model_path)
        for pdf in batches:
            ids_of, text = pdf["doc_id"].astype("Int64"), pdf["text"].tolist()
            for a, b in slices(text):
                ids, lengths = enc.encode(text[a:b])
                yield pd.DataFrame({"doc_id": ids_of.iloc[a:b].to_numpy(), "ids": np.split(ids.astype(np.int32), np.cumsum(lengths)[:-1])}).astype({"doc_id": "Int64"})

    return texts(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, model_path: str) -> DataFrame:
    """Per row of doc_id and ids: doc_id and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = decoder_table(piece_encoder(model_path).model)
        for pdf in batches:
            joined = [b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace") if ids is not None else "" for ids in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": [t[1:] if t[:1] == " " else t for t in joined]})

    return rows.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def check_round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_ids, ids_crc32, round_trip and the decoded text's sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = piece_encoder(model_path)
        table = np.array(decoder_table(enc.model), dtype=object)
        for pdf in batches:
            ids_of, text = pdf["doc_id"].astype("Int64").tolist(), pdf["text"].tolist()
            for a, b in slices(text):
                ids, lengths = enc.encode(text[a:b])
                at, rows = 0, []
                for doc_id, t, n in zip(ids_of[a:b], text[a:b], lengths.tolist(), strict=True):
                    own, at = ids[at : at + n], at + n
                    back = b"".join(table[own])[1:]
                    rows.append((doc_id, n, zlib.crc32(own.astype("<u4").tobytes()), back == (t or "").encode("utf-8", "replace"), hashlib.sha256(back).hexdigest()))
                yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids_crc32", "round_trip", "decoded_sha256"]).astype({"doc_id": "Int64"})

    return texts(docs).mapInPandas(run, ENCODED)
