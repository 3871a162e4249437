"""Alignment of two tokenizers: which tokens of one overlap which of the other, by a sweep over token ends.

A is a byte-level vocabulary of the tokenizers library, B a SentencePiece vocabulary; A reads a space and the text, B the text, before which it puts
that space itself. Special tokens' strings are plain text for both. A text is cut where both always cut and the ids of a cut piece come from a table once met.

Each document becomes events, its tokens' ends in bytes with their ids, for A and for B; up to `span` events of one side travel as one packed row (a row for each token
would be many times the text). The rows of both sides are united, dealt out by document, sorted by offset in each task and streamed through a sweep whose
state is what is open: the events after the last offset where both sides end, which is a few tokens. Between two ends that follow each other lies one
A and one B token, so every end of either side is one link, and every end of both closes a group.

A pair's count is the number of documents that hold it linked. Finished documents are gathered into blocks of bounded size with each pair's number of documents;
counts are summed over blocks, and each block gets back those of its own pairs. So a pair that nearly all documents hold is one row a block.

Defined results: null and empty texts, and texts whose joined token bytes differ from the space and the text (as with U+2581 in it), have no tokens: all
numbers 0 and an empty groups string. Repeated rows count as documents of their own, a null doc_id stays null, and other columns of
the caller aren't read. Ties of an A id's highest count all count as best. An empty table gives an empty result. Rows are told apart by their place in the
input, so the input must come in a repeatable order, as files do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelot.llm.common import scratch, texts
from wavelot.llm.pieces import BYTE_LEVEL, LATIN, WHITE, ChunkEncoder, _Known, byte_letters, slices
from wavelot.llm.viterbi import MARK, PieceModel, decoder_table

#: White space with two spaces in a row and the word after it stay together: B has pieces of several spaces.
TOGETHER = rf"[{WHITE}]*?  [{WHITE}]*[^{WHITE}]*"
EVENTS = "uid long, doc_id long, side int, at long, ids binary, sizes binary"
BLOCKS = "block long, pairs array<long>, docs array<int>, doc_ids array<long>, numbers binary, entries binary, places binary, times binary, groups array<binary>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"


class TwinEncoder:
    """Ids and byte lengths of both tokenizers' tokens for batches of texts."""

    def __init__(self, a_path: str, b_path: str, most: int = 4 << 20):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b, self.most = ChunkEncoder(a_path, "byte_level"), SentencePieceProcessor(model_file=b_path), most
        model = PieceModel(b_path)
        self.a.tokenizer.encode_special_tokens = True
        byte_of = {c: b for b, c in byte_letters().items()}
        size = self.a.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes = [[b""] * size, decoder_table(model)]
        added = {i: t.content for i, t in self.a.tokenizer.get_added_tokens_decoder().items()}
        for token, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[0][i] = token.encode() if i in added else bytes(byte_of[c] for c in token)
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in self.bytes]
        long = [p for p in model.id_of if len(p) > 1]
        # a character that no piece joins with others: with it in front, a cut piece isn't the start of a text, which would get a space
        self.lead = next((c for c in "\n\t\x01" if not any(c in p for p in long)), None)
        if self.lead is None:
            raise ValueError("the vocabulary has pieces with every control character that could stand before a cut piece")
        joined = re.compile(rf"[{LATIN}][.,!?;:]|[^{MARK}]{MARK}")
        if any(joined.search(p) for p in long):  # pieces over the places where A cuts
            self.patterns = [re.compile(r"(?s:.+)")] * 2
        else:
            self.patterns = [re.compile(f"{TOGETHER}|{BYTE_LEVEL.pattern}")] * 2
        # white space within pieces holds together what stands before and after it
        glue = re.escape("".join(sorted({c for p in long for c in re.findall(rf"[{WHITE}]", p)})))
        self.glue = re.compile(f"[{glue}]" if glue else r"(?!)")
        if glue and not any(joined.search(p) for p in long):
            more = rf"(?:(?=[{WHITE}]*[{glue}])[{WHITE}]++[^{WHITE}]*+)"
            self.patterns[1] = re.compile(f"{TOGETHER}{more}*| ?[^{WHITE}]*+{more}+|{BYTE_LEVEL.pattern}")
        self.id_types = [np.dtype("<u2" if len(x) <= 1 << 16 else "<u4") for x in self.bytes]
        self.size_types = [np.dtype("<u1" if x.max() < 256 else "<u4") for x in self.sizes]
        self.forget()

    def forget(self) -> None:
        self.known, self.held, self.differs = _Known(), 0, np.zeros(0, bool)
        self.flat = [np.zeros(0, np.int64)] * 2
        self.start, self.length = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2

    def _learn(self) -> None:
        new = self.known.new
        if not new:
            return
        lead = len(self.b.encode(self.lead))
        right = [ids[lead:] for ids in self.b.encode([self.lead + c for c in new], num_threads=1)]
        made = self.a.encode_chunks(new), (np.fromiter(chain.from_iterable(right), np.int64), np.fromiter(map(len, right), np.int64, len(right)))
        whole, table = [c.encode("utf-8", "replace") for c in new], self.bytes[1]
        size = np.append(0, np.cumsum(self.sizes[0][made[0][0]]))[np.append(0, np.cumsum(made[0][1]))]
        differs = np.diff(size) != np.fromiter(map(len, whole), np.int64, len(whole))
        differs |= np.fromiter((b"".join(map(table.__getitem__, ids)) != c for ids, c in zip(right, whole, strict=True)), bool, len(whole))
        for side, (ids, length) in enumerate(made):
            end = np.cumsum(length)
            self.start[side] = np.concatenate([self.start[side], len(self.flat[side]) + end - length])
            self.length[side] = np.concatenate([self.length[side], length])
            self.flat[side] = np.concatenate([self.flat[side], ids])
        self.differs = np.concatenate([self.differs, differs])
        self.held += sum(map(len, new))
        self.known.new = []

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B: all ids and the number of each text's."""
        if self.held > self.most:  # characters, so that few long pieces weigh as much as many short ones
            self.forget()
        of, counts = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        find, glue, get = [p.findall for p in self.patterns], self.glue.search, self.known.__getitem__
        for k, text in enumerate(texts):
            if text:
                of.append(np.fromiter(map(get, found := find[glue(text) is not None](" " + text)), np.int64, len(found)))
                counts[k] = len(found)
        self._learn()
        chunk, row = np.concatenate(of), np.repeat(np.arange(len(texts)), counts)
        odd = np.bincount(row[self.differs[chunk]], minlength=len(texts)) > 0
        chunk, row = chunk[~odd[row]], row[~odd[row]]
        out = []
        for side in (0, 1):
            n = self.length[side][chunk]
            ids = self.flat[side][np.repeat(self.start[side][chunk] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            out.append((ids, np.bincount(row, n, len(texts)).astype(np.int64)))
        return out


_ENCODERS: dict[tuple[str, str], TwinEncoder] = {}


def twin_encoder(a_path: str, b_path: str) -> TwinEncoder:
    """One per Python worker."""
    if (a_path, b_path) not in _ENCODERS:
        _ENCODERS[a_path, b_path] = TwinEncoder(a_path, b_path)
    return _ENCODERS[a_path, b_path]


def _binaries(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Rows of bytes that follow each other in one array."""
    offsets = (edges * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data))])


def token_events(docs: DataFrame, a_path: str, b_path: str, span: int = 16384) -> DataFrame:
    """Packed events of both sides: uid (the row), doc_id, side (0: A), at (bytes before the first token), ids and sizes in bytes of up to span tokens. Every
    document has a row of side 0 at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = twin_encoder(a_path, b_path)
        for batch in batches:
            text = batch.column("text").to_pylist()
            for s, e in slices(text):
                for side, (ids, counts) in enumerate(enc.encode(text[s:e])):
                    size, rows = enc.sizes[side][ids], -(-counts // span)
                    if side == 0:
                        rows = np.maximum(rows, 1)
                    of = np.repeat(np.arange(e - s), rows)
                    step = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
                    base, end = np.cumsum(counts) - counts, np.concatenate([[0], np.cumsum(size)])
                    first = base[of] + step * span
                    edges = np.append(first, len(ids))
                    own = pa.array(of + s)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("uid").take(own), batch.column("doc_id").take(own), pa.array(np.full(len(of), side, np.int32)), pa.array(end[first] - end[base[of]]), _binaries(ids.astype(enc.id_types[side]), edges), _binaries(size.astype(enc.size_types[side]), edges)],
                        ["uid", "doc_id", "side", "at", "ids", "sizes"],
                    )

    return texts(docs).withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, EVENTS)


@dataclass
class Tokens:
    """Tokens of several documents, one after the other, for one side."""

    ids: np.ndarray
    size: np.ndarray
    count: np.ndarray  # of each document


@dataclass
class Swept:
    """What the sweep found in pieces of documents that end where both sides end."""

    numbers: np.ndarray  # n_a, n_b, n_groups, n_links of each piece
    text: list[bytes]  # the groups of each
    pairs: list[np.ndarray]  # linked id pairs of each, ascending
    times: list[np.ndarray]  # how often


def sweep(a: Tokens, b: Tokens, names: np.ndarray, width: int) -> Swept:
    """names: the ids' decimals, A's with ',' and '|' after them, then B's with ',' and ';'; a pair's number is A's id * width + B's id."""
    pieces = len(a.count)
    ends_a, ends_b = np.cumsum(a.size), np.cumsum(b.size)
    total = int(ends_a[-1]) if len(ends_a) else 0
    is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    is_a[ends_a], is_b[ends_b] = True, True
    end = np.flatnonzero(is_a | is_b)
    is_a, is_b = is_a[end], is_b[end]
    of_a, of_b = np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b  # the tokens that the stretch before each end lies in
    both = is_a & is_b
    last = np.append(0, ends_a)[np.cumsum(a.count)]  # where each piece ends
    n_links = np.diff(np.searchsorted(end, last, "right"), prepend=0)
    n_groups = np.diff(np.append(0, np.cumsum(both))[np.cumsum(n_links)], prepend=0)

    upto_a, upto_b = of_a[both] + 1, of_b[both] + 1  # tokens up to each group's end
    each_a, each_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    closes_a, closes_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    closes_a[upto_a - 1], closes_b[upto_b - 1] = 1, 1
    order = np.empty(len(a.ids) + len(b.ids), np.int64)
    order[np.arange(len(a.ids)) + np.repeat(upto_b - each_b, each_a)] = 2 * a.ids + closes_a
    order[np.arange(len(b.ids)) + np.repeat(upto_a, each_b)] = len(names) - 2 * width + 2 * b.ids + closes_b
    words, edges = names[order], [0, *np.cumsum(a.count + b.count).tolist()]
    text = [b"".join(words[s:e].tolist())[:-1] for s, e in zip(edges, edges[1:], strict=False)]

    pair = a.ids[of_a] * width + b.ids[of_b]
    most = (len(names) - 2 * width) // 2 * width
    key, times = np.unique(np.repeat(np.arange(pieces, dtype=np.uint64), n_links) * np.uint64(most) + pair.astype(np.uint64), return_counts=True)
    cuts = np.searchsorted(key, np.arange(1, pieces, dtype=np.uint64) * np.uint64(most))
    pairs = np.split((key % np.uint64(most)).astype(np.int64), cuts)
    return Swept(np.stack([a.count, b.count, n_groups, n_links], axis=1), text, pairs, np.split(times, cuts))


@dataclass
class Open:
    """The document whose events may go on: what is settled of it, and its events since both sides last ended together."""

    uid: int
    doc_id: int | None
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    text: object = None
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    left: tuple = ()

    def add(self, found: Swept, k: int, keep_text: bool) -> None:
        if found.numbers[k, 3]:
            self.numbers = self.numbers + found.numbers[k]
            self.pairs.append(found.pairs[k])
            self.times.append(found.times[k])
            if len(self.pairs) > 64:
                self.merge()
            if self.text is None:
                self.text = [] if keep_text else hashlib.sha256()
                more = found.text[k]
            else:
                more = b";" + found.text[k]
            self.text.append(more) if keep_text else self.text.update(more)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) != 1:
            own, at = np.unique(np.concatenate([*self.pairs, np.zeros(0, np.int64)]), return_inverse=True)
            self.times = [np.bincount(at, np.concatenate([*self.times, np.zeros(0, np.int64)]), len(own)).astype(np.int64)]
            self.pairs = [own]
        return self.pairs[0], self.times[0]

    def groups(self, keep_text: bool) -> bytes:
        if self.text is None:
            return b""
        return b"".join(self.text) if keep_text else self.text.hexdigest().encode()


def _last_common(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many tokens of either side, given their sizes, end up to the last end of both."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return (int(np.searchsorted(ends_a, common[-1])) + 1, int(np.searchsorted(ends_b, common[-1])) + 1) if len(common) else (0, 0)


def swept_blocks(events: DataFrame, a_path: str, b_path: str, keep_text: bool, entries: int = 1 << 19, docs: int = 20_000) -> DataFrame:
    """Blocks of documents: their numbers, groups and link pairs, and for each pair of the block how many of its documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = twin_encoder(a_path, b_path)
        width = len(enc.bytes[1])
        names = np.array([b"%d%c" % (i, c) for side, closing in ((0, b"|"), (1, b";")) for i in range(len(enc.bytes[side])) for c in (b",", closing)], object)
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, held, size
            merged = [x.merge() for x in held]
            pairs, place = np.unique(np.concatenate([p for p, _ in merged]), return_inverse=True)
            packed = [np.concatenate(x).astype("<u4").tobytes() for x in ([t for _, t in merged], [x.numbers for x in held])]
            zstd = pa.Codec("zstd", 3)
            row = {
                "block": number, "pairs": pairs, "docs": np.bincount(place, minlength=len(pairs)).astype(np.int32), "doc_ids": [x.doc_id for x in held], "numbers": packed[1],
                "entries": np.array([len(p) for p, _ in merged], "<u4").tobytes(), "places": zstd.compress(place.astype("<u4").view("<u1").reshape(-1, 4).T.tobytes(), asbytes=True), "times": zstd.compress(packed[0], asbytes=True),
                "groups": [x.groups(keep_text) for x in held],
            }
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        now: Open | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            uid, side = batch.column("uid").to_numpy(), batch.column("side").to_numpy()
            ids_of, docs_of = batch.column("ids"), batch.column("doc_id").to_pylist()
            begin = np.flatnonzero(np.diff(uid, prepend=uid[0] - 1))
            going = now is not None and now.uid == uid[0]
            here = [Open(int(uid[i]), docs_of[i]) for i in begin[int(going) :]]
            if now is not None:
                here.insert(0, now)
            doc = np.cumsum(np.diff(uid, prepend=uid[0]) != 0) + (0 if going or now is None else 1)
            both = []
            for s in (0, 1):
                rows = np.flatnonzero(side == s)
                ids = np.frombuffer(b"".join(ids_of.take(pa.array(rows)).to_pylist()), enc.id_types[s]).astype(np.int64)
                sizes = np.frombuffer(b"".join(batch.column("sizes").take(pa.array(rows)).to_pylist()), enc.size_types[s]).astype(np.int64)
                n = np.array([len(x) for x in ids_of.take(pa.array(rows)).to_pylist()], np.int64) // enc.id_types[s].itemsize
                count = np.bincount(doc[rows], n, len(here)).astype(np.int64)
                if now is not None and now.left:
                    ids, sizes = np.concatenate([now.left[s][0], ids]), np.concatenate([now.left[s][1], sizes])
                    count[0] += len(now.left[s][0])
                both.append(Tokens(ids, sizes, count))
            now = here[-1]
            cut = _last_common(*(x.size[len(x.ids) - x.count[-1] :] for x in both))
            left = []
            for x, n in zip(both, cut, strict=True):
                to = len(x.ids) - int(x.count[-1]) + n
                left.append((x.ids[to:].copy(), x.size[to:].copy()))
                x.ids, x.size, x.count[-1] = x.ids[:to], x.size[:to], n
            found = sweep(*both, names, width)
            for k, one in enumerate(here):
                one.add(found, k, keep_text)
                one.left = ()
            now.left = tuple(left)
            for one in here[:-1]:
                held.append(one)
                size += sum(map(len, one.pairs))
                if size >= entries or len(held) >= docs:
                    yield block()
        if now is not None:
            held.append(now)
        if held:
            yield block()

    return events.repartition("uid").sortWithinPartitions("uid", "at", "side").mapInArrow(run, BLOCKS)


_BLOCK = pa.schema([("block", pa.int64()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("numbers", pa.binary()), ("entries", pa.binary()), ("places", pa.binary()), ("times", pa.binary()), ("groups", pa.list_(pa.binary()))])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair and n, the number of documents that hold it."""
    return blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, digest_only: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair's count is the highest of its A id), count_sum (over links) and groups, as
    a1,a2|b1;a3|b2,b3; with digest_only groups_sha256 instead, the lowercase hex of its sha256, empty without tokens."""
    spark = docs.sparkSession
    path = scratch(spark, "aligned")
    swept_blocks(token_events(docs, a_path, b_path), a_path, b_path, not digest_only).write.parquet(path)
    blocks = spark.read.parquet(path)
    counts = scratch(spark, "counts")
    pair_counts(blocks).write.parquet(counts)
    width = _pieces(b_path)
    counts = spark.read.parquet(counts).withColumn("a", F.expr(f"pair div {width}"))
    rated = counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    own = blocks.select("block", F.explode("pairs").alias("pair")).join(rated, "pair")
    own = own.groupBy("block").agg(F.collect_list(F.struct("pair", "n", "top")).alias("rated"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd")
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                numbers = np.frombuffer(row["numbers"].as_py(), "<u4").reshape(-1, 4).astype(np.int64)
                entries = np.frombuffer(row["entries"].as_py(), "<u4").astype(np.int64)
                n = int(entries.sum())
                places = np.frombuffer(zstd.decompress(row["places"].as_py(), 4 * n), "<u1").reshape(4, -1).T.copy().view("<u4").reshape(-1) if n else np.zeros(0, np.uint32)
                times = np.frombuffer(zstd.decompress(row["times"].as_py(), 4 * n), "<u4").astype(np.int64) if n else np.zeros(0, np.int64)
                rated = row["rated"].values
                if rated is None:
                    order, count, top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
                else:
                    order = np.argsort(rated.field("pair").to_numpy())
                    count, top = rated.field("n").to_numpy()[order], rated.field("top").to_numpy(zero_copy_only=False)[order]
                edges = np.append(0, np.cumsum(entries))
                summed = [np.diff(np.append(0, np.cumsum(x))[edges]) for x in (times * top[places], times * count[places])]
                groups = row["groups"].values
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, *(pa.array(np.ascontiguousarray(x)) for x in (*numbers.T, *summed)), groups.cast(pa.string())], names=[*ALIGNED.replace(" long", "").split(", "), name])

    name = "groups_sha256" if digest_only else "groups"
    return blocks.drop("pairs", "docs").join(own, "block", "left").drop("block").mapInArrow(finish, f"{ALIGNED}, {name} string")


def _pieces(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()
